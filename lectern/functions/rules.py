"""Lists and constants that results depend on."""

from __future__ import annotations

# Words that an OR query and a token set leave out.
STOPWORDS = (
    "a an and are as at be but by do for from had has have he her his how i if in is it its just me my no not of on or our "
    "she so than that the them then there these they this to too up us was we were what when where which who why will with "
    "would you your about after also back been before being between both came can come could did does done each even few find "
    "first get got into know let like long look made make many may more most much must need new now off old only other over own "
    "part put right said same say see set should show side since some still such take tell through time under upon very want way "
    "well went"
).split()

# Suffixes of the stemmer in the order in which they are tried.
SUFFIXES = ("ing", "tion", "sion", "ness", "ment", "able", "ible", "ous", "ive", "ful", "less", "ers", "ies", "ed", "es", "ly", "s")

# Words of a query that ask for the most recent state.
RECENCY_WORDS = ("current", "latest", "recent", "now", "today", "new", "newest", "last", "present", "最新", "最近", "目前", "现在", "当前")

# Phrases that announce a correction of an earlier fact.
UPDATE_SIGNAL = (
    r"\b(moved to|changed|switched|updated|no longer|instead of|replaced|now (?:use|live|work|prefer)|"
    r"grew to|new role|started a new|changed it from|switched to|migrated)\b"
)

# An explicit calendar date.
DATE = (
    r"\b(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4}"
    r"|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2},?\s+\d{4})\b"
)

# Ranking constants (BM25, fusion, forgetting curve, supersession).
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
TEXT_WEIGHT, EXPANSION_WEIGHT = 1.0, 0.35
LEXICAL_WEIGHT, RECENCY_WEIGHT, CONFIDENCE_WEIGHT = 1.0, 0.75, 0.3
RECENCY_DAYS, STABILITY_DAYS, LEAST_CONFIDENCE = 30.0, 30.0, 0.3
FORGETTING_FACTOR, FORGETTING_POWER = 19.0 / 81.0, 0.5
SIGNALLED_OVERLAP, PLAIN_OVERLAP = 0.15, 0.65
GATE_SHARE, GATE_SHARED, GATE_TERMS = 0.15, 2, 3
WINDOW, DEEP_WINDOW = 60, 2000

# Document types by file name, by text and by MIME type, in the order in which they are tried.
NAME_TYPES = (
    ("invoice", "invoice"), ("receipt", "receipt"), ("contract", "contract"), ("report", "report"), (r"(resume|cv\b)", "resume"), ("statement", "statement"),
    ("letter", "letter"), ("memo", "memo"), ("proposal", "proposal"), ("agenda", "agenda"), ("minutes", "minutes"),
)
TEXT_TYPES = (
    (r"(INVOICE|Invoice\s+#|Invoice\s+Number|Bill\s+To|Total\s+Due)", "invoice"), (r"(RECEIPT|Payment\s+Received|Transaction\s+ID)", "receipt"),
    (r"(CONTRACT|AGREEMENT|hereby\s+agree|terms\s+and\s+conditions)", "contract"),
)
MIME_TYPES = {
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "spreadsheet", "application/vnd.ms-excel": "spreadsheet", "text/csv": "spreadsheet",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "presentation", "application/vnd.ms-powerpoint": "presentation",
}

# Folders and files that an index leaves out, and those that a grep leaves out.
INDEX_SKIP_DIRS = (".git", "__pycache__", "node_modules", ".venv", "venv", ".idea", ".vscode", ".tox", ".mypy_cache", ".pytest_cache", ".lectern")
INDEX_SKIP_FILES = (".DS_Store", "thumbs.db", "Thumbs.db", "desktop.ini")
GREP_SKIP_DIRS = (".git", "node_modules", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", "dist", "build", ".next", ".nuxt", ".svelte-kit")
GREP_SKIP_SUFFIXES = (
    ".pyc .pyo .so .dll .exe .bin .jpg .jpeg .png .gif .bmp .ico .svg .mp3 .mp4 .avi .mov .wav .zip .tar .gz .bz2 .7z .rar "
    ".woff .woff2 .ttf .eot .pdf .doc .docx .xls .xlsx .pptx .db .sqlite .sqlite3"
).split()
GREP_MOST_BYTES = 10 << 20
CODE_SUFFIXES = (".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")

# Link patterns.
MARKDOWN_LINK = r"\[([^\]]+)\]\(([^)\s]+)\)"
WIKI_LINK = r"\[\[([^|\]#]+)(?:#[^|\]]*)?(?:\|([^\]]+))?\]\]"
CODE_PATH = (
    r"\b((?:src|lib|app|test|tests|docs|scripts|examples)/"
    r"[\w\-./]+\.(?:py|js|ts|tsx|jsx|md|rst|txt|json|yaml|yml|toml|sql|csv))(?::\d+)?\b"
)
EXTERNAL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|#)"

# Sizes of pages, sheets and snippets.
CHUNK_CHARS, SHEET_ROWS, HEADER_EVERY = 3000, 100, 50
HIGHLIGHT_RADIUS, HIGHLIGHT_HEAD = 80, 150
PAGE_MARK = r"^\[(Page|Slide|Sheet|Section)\s+.+\]$"
MEMORY_TYPES = ("episodic", "semantic", "procedural")
MEMORY_SOURCES = ("user_explicit", "ai_inference", "tool_extraction", "unknown")
DEBOUNCE_SECONDS, SETTLE_SECONDS, RATE_SECONDS, MOST_CAPTURE = 2.0, 0.4, 60, 51_200

# Characters that a query term loses at its edges, and a quantified group that holds a quantifier.
TERM_EDGES = "?!.,;:'\"()[]{}"
NESTED_QUANTIFIER = r"\([^)]*[+*][^)]*\)\s*[+*{]"

# Section titles, a Markdown heading or a line in capitals of 3 to 79 characters.
HEADING = r"^#{1,3}\s+(.+)$"
CAPITALS = r"^[A-Z][A-Z0-9\s]{2,78}$"
