"""Full-text search: BM25 over weighted columns, filters, paging, boosts, symbol search and bundles.

A search over plain text reads the column once for its matches and once for the corpus totals (one row, joined to every match); a row's
tokens and counts are made once, inside a generator that also drops rows without a match, so no filter repeats them.  Nothing is
shuffled but the final top-k.  Totals always come from the whole table, filters apply to matches only.  ``operators.index`` answers the
same from stored postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import rules
from lectern.functions import text as T
from lectern.plans.query import Phrase, parse
from lectern.session import materialize


def phrase_hits(tokens: Column, phrase: Phrase) -> Column:
    """Occurrences of a phrase in an array of tokens."""
    if len(phrase.tokens) == 1:
        word = phrase.tokens[0]
        return F.size(F.filter(tokens, (lambda t: t.startswith(word)) if phrase.prefix else (lambda t: t == word)))
    want = F.array(*[F.lit(t) for t in phrase.tokens])
    m = len(phrase.tokens)

    def starts(t: Column) -> Column:
        return F.when(F.size(t) < m, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.size(t) - m + 1), lambda i: F.slice(t, i, F.lit(m)) == want)))

    # A lambda's argument is computed once; the tokens themselves inside the inner lambda would be made anew at every place.
    return F.transform(F.array(tokens), starts)[0]


def idf(docs: Column, matches: Column) -> Column:
    raw = F.ln((docs - matches + 0.5) / (matches + 0.5))
    return F.when(raw > 0, raw).otherwise(rules.LEAST_IDF)


def term_score(weight: Column, f: Column, length: Column, average: Column) -> Column:
    return weight * f * (rules.K1 + 1) / (f + rules.K1 * (1 - rules.B + rules.B * length / average))


def once(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed a single time however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bm25(docs: DataFrame, query: str, columns: list[tuple[Column, float]], *, any_term: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` that match, with ``score``; columns: (token array, weight).  An empty query matches nothing."""
    phrases = parse(query, any_term=any_term)
    keep = keep or docs.columns
    if not phrases:
        return docs.select(*keep).where(F.lit(False)).withColumn("score", F.lit(0.0))
    n = len(phrases)

    def counted(t: Column) -> Column:
        fields = [t[f"t{i}"] for i in range(len(columns))]
        weighted = [sum((phrase_hits(x, p) * w for x, (_, w) in zip(fields, columns)), F.lit(0.0)) for p in phrases]
        return F.struct(sum((F.size(x) for x in fields[1:]), F.size(fields[0])).alias("length"), F.array(*weighted).alias("f"))

    rows = F.transform(F.array(F.struct(*[c.alias(f"t{i}") for i, (c, _) in enumerate(columns)])), counted)
    every = docs.select(F.explode(rows).alias("bm"))
    totals = every.agg(F.count("*").alias("docs"), F.avg("bm.length").alias("average"), F.array(*[F.count_if(F.col("bm.f")[i] > 0) for i in range(n)]).alias("n"))
    s = F.broadcast(totals.select(F.struct("docs", "average", "n").alias("bm_s")))  # one row
    found = (F.exists if any_term else F.forall)
    hits = docs.select(*keep, F.explode(F.filter(rows, lambda x: found(x["f"], lambda f: f > 0))).alias("bm"))
    t = F.col("bm_s")
    score = sum((term_score(idf(t["docs"], t["n"][i]), F.col("bm.f")[i], F.col("bm.length"), t["average"]) for i in range(n)), F.lit(0.0))
    return hits.crossJoin(s).select(*keep, score.alias("score"))


def text_columns(text: str) -> list[tuple[Column, float]]:
    """The text and its camelCase expansion with their weights."""
    return [(T.index_tokens(F.col(text)), rules.TEXT_WEIGHT), (T.words(T.expansion(F.col(text))), rules.EXPANSION_WEIGHT)]


def filtered(df: DataFrame, *, tags: list[str] | None = None, mime: str | None = None, metadata: dict[str, str] | None = None, created_after=None, workspace: str | None = None) -> DataFrame:
    """File filters: all tags, exact MIME type, metadata values, creation time, workspace."""
    if tags:
        df = df.where(F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), "tags")) == 0)
    if mime:
        df = df.where(F.col("mime_type") == mime)
    for key, value in (metadata or {}).items():
        df = df.where(F.get_json_object("metadata", f"$.{key}") == value)
    if created_after is not None:
        df = df.where(F.col("created_at") >= F.lit(created_after))
    if workspace is not None:
        df = df.where(F.col("workspace_id") == workspace)
    return df


def search(docs: DataFrame, query: str, *, id_col: str, text_col: str, any_term: bool = False, two_columns: bool = True, limit: int = 20, offset: int = 0, where: dict | None = None) -> DataFrame:
    """The page of best matches with score, highlight and rank, ties by id."""
    columns = text_columns(text_col) if two_columns else text_columns(text_col)[:1]
    found = filtered(bm25(docs, query, columns, any_term=any_term), **(where or {}))
    return page_of(found, query, id_col=id_col, text_col=text_col, limit=limit, offset=offset)


def page_of(found: DataFrame, query: str, *, id_col: str, text_col: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of scored matches with rank and highlight, ties by id."""
    page = found.orderBy(F.desc("score"), id_col).offset(offset).limit(limit)
    place = F.row_number().over(W.orderBy(F.desc("score"), id_col)) + offset  # of one page
    return page.withColumn("rank", place).withColumn("highlight", T.highlight(F.col(text_col), query))


def match_count(docs: DataFrame, query: str, *, text_col: str, any_term: bool = False, where: dict | None = None) -> DataFrame:
    """Number of matches, whatever a page's limit."""
    columns = text_columns(text_col)
    return filtered(bm25(docs, query, columns, any_term=any_term), **(where or {})).agg(F.count("*").alias("total"))


def backlink_boost(hits: DataFrame, counts: DataFrame, *, id_col: str, weight: float = 0.05) -> DataFrame:
    """A page of hits whose scores grow by ``weight`` for each backlink, sorted anew; counts: (id, backlinks)."""
    met = hits.join(counts, id_col, "left").withColumn("backlinks", F.coalesce("backlinks", F.lit(0)))
    return met.withColumn("score", F.round(F.col("score") * (1 + weight * F.col("backlinks")), 3)).orderBy(F.desc("score"), id_col)


def symbol_search(symbols: DataFrame, query: str, *, kinds: list[str] | None = None, limit: int = 20) -> DataFrame:
    """Symbols by BM25 over name, qualified name, signature and docstring; if none matches, by substring, shortest name first."""
    rows = symbols.where(F.col("kind").isin(kinds)) if kinds else symbols
    columns = [(T.words(F.concat_ws(" ", c, T.expansion(F.col(c)))), 1.0) for c in ("name", "qualified_name", "signature", "docstring")]
    order = [F.desc("score"), F.length("qualified_name"), "start_line", "qualified_name"]
    ranked = materialize(bm25(rows, query, columns, any_term=True, keep=symbols.columns).orderBy(*order).limit(limit), "symbols")  # a page: scored once
    if not ranked.isEmpty():
        return ranked.orderBy(*order)
    like = F.lower("qualified_name").contains(query.lower()) | F.lower("signature").contains(query.lower()) | F.lower("docstring").contains(query.lower())
    return rows.where(like).withColumn("score", F.lit(0.0)).orderBy(*order).limit(limit)


def context_bundle(symbols: DataFrame, files: DataFrame, query: str, *, id_col: str, text_col: str, most: int = 8) -> DataFrame:
    """(kind, file, start, end, body): code of the best symbols with a line on each side, then documents of other files."""
    # Parsed once for totals, matches and substrings; the best are found once for code and for the files left out.
    found = materialize(symbol_search(materialize(symbols, "symbols"), query, limit=most), "found")
    met = found.join(files.select(F.col(id_col).alias("f"), F.col(text_col).alias("t")), F.col("file_id") == F.col("f"))
    first, last = F.greatest(F.lit(1), F.col("start_line") - 1), F.col("end_line") + 1
    code = met.select(F.lit("code").alias("kind"), F.col("file_id").cast("string").alias("file"), first.alias("start"), last.alias("end"), F.array_join(F.slice(F.split("t", "\n"), first, last - first + 1), "\n").alias("body"), F.col("score")).dropDuplicates(["file", "start", "end"])
    docs = bm25(files, query, text_columns(text_col), any_term=True).orderBy(F.desc("score"), id_col).limit(most)
    docs = docs.join(found.select(F.col("file_id").alias("found_id")).distinct(), F.col(id_col) == F.col("found_id"), "left_anti")
    rest = docs.select(F.lit("document").alias("kind"), F.col(id_col).cast("string").alias("file"), F.lit(1).alias("start"), F.lit(None).cast("int").alias("end"), T.highlight(F.col(text_col), query).alias("body"), "score")
    return code.unionByName(rest)


def route(query: str, *, path: str | None = None, glob: str | None = None, mode: str = "auto") -> str:
    """``fts`` or ``grep``: auto greps when a path or glob is given."""
    if mode not in ("auto", "fts", "grep"):
        raise ValueError(f"unknown search mode: {mode}")
    return ("grep" if path or glob else "fts") if mode == "auto" else mode


def grouped_hits(hits: DataFrame, *, file_col: str, page_col: str, most: int = 10) -> DataFrame:
    """Hits by file: its best page and score, up to ``most`` other pages in order of score, best file first.

    Pages are ranked and cut before they are gathered, so a file of many pages is never one row.
    """
    place = F.row_number().over(W.partitionBy(file_col).orderBy(F.desc("score"), page_col))
    top = hits.select(file_col, F.col(page_col).alias("p"), "score", place.alias("k")).where(F.col("k") <= most + 1)
    rest = F.array_sort(F.collect_list(F.when(F.col("k") > 1, F.struct("k", "p"))))
    out = top.groupBy(file_col).agg(F.max("score").alias("best_score"), F.max(F.when(F.col("k") == 1, F.col("p"))).alias("best_page"), F.transform(rest, lambda x: x["p"]).alias("other_pages"))
    return out.orderBy(F.desc("best_score"), file_col)
