"""Behaviour of single rules on small inputs."""

from __future__ import annotations

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import ranking, render
from lectern.functions import text as T
from lectern.operators import evals, lines, links, memory, search, sequential, symbols, workspace
from lectern.plans import query
from lectern.sources import files as sources
from lectern.sources.store import Registry, Store
from lectern.streaming import changes


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_query_forms():
    assert [p.tokens for p in query.parse('what is the "gardening-related" Déjà?')] == [("what",), ("is",), ("the",), ("gardening", "related"), ("deja",)]
    found = query.parse("the indexing of tests", any_term=True)
    assert [(p.tokens, p.prefix) for p in found] == [(("indexing",), False), (("index",), True), (("tests",), False), (("test",), True)]
    assert [p.tokens[0] for p in query.parse("the of", any_term=True)] == ["the", "of"]
    assert query.parse("?!") == []
    assert query.page_spec("3-5") == [3, 4, 5] and query.page_spec("1,4") == [1, 4] and query.page_spec("Revenue") == "Revenue"
    assert query.line_spec("50-") == (50, None) and query.line_spec("7") == (7, 7)
    with pytest.raises(ValueError):
        query.safe_pattern("(a+)+b")


@given(st.text(max_size=60))
def test_or_matches_contain_and_matches(text):
    every, any_ = query.parse(text), {p.tokens for p in query.parse(text, any_term=True) if not p.prefix}
    assert any_ <= {p.tokens for p in every} or not every


def test_fusion(spark):
    def scores(data, **kw):
        df = spark.createDataFrame(data, "id int, fts double, age double, trust double, pinned boolean")
        return {r.id: r.s for r in df.select("id", ranking.fusion(F.col("fts"), F.col("age"), F.col("trust"), F.col("pinned"), **kw)["score"].alias("s")).collect()}

    a = scores([(1, 1.0, 946.8, 1.0, False), (2, 0.4735, 794.8, 1.0, False)])
    assert a[2] > a[1]
    b = scores([(1, 1.0, 946.8, 1.0, False), (2, 0.4735, 794.8, 1.0, False)], weights=(1.0, 0.6, 0.3))
    assert b[1] > b[2]
    c = scores([(1, 9.0, 4.0, 1.0, False), (2, 3.0, 3.0, 1.0, False)])
    assert c[1] > c[2]
    d = scores([(1, 0.01, 5000.0, 1.0, True), (2, 100.0, 0.0, 1.0, False)])
    assert d[1] > d[2]


def test_confidence_and_recency(spark):
    one = spark.range(1)
    got = one.select(ranking.confidence(F.lit(1.0), F.lit(30.0), F.lit(0), F.lit(False)), ranking.confidence(F.lit(0.8), F.lit(99.0), F.lit(0), F.lit(True)), ranking.recency(F.lit(0.0)), ranking.recency(F.lit(30.0)), ranking.significant(F.lit(1234567.0))).first()
    assert math.isclose(got[0], 0.9) and tuple(got[1:4]) == (0.8, 1.0, 0.5) and got[4] == 1234570.0
    assert ranking.recency_intent("the LATEST plan") and not ranking.recency_intent("plans")


def test_tokens(spark):
    df = spark.createDataFrame([(0, "CreateInvoice handles gardening-related Déjà"), (1, "東京タワー x"), (2, None), (3, "")], "id int, s string")
    got = {r.id: (r.t, r.e) for r in df.select("id", T.index_tokens(F.col("s")).alias("t"), T.expansion(F.col("s")).alias("e")).collect()}
    assert got[0] == (["createinvoice", "handles", "gardening", "related", "deja", "gardening", "related"], "create invoice")
    assert got[1][0] == ["東京", "京タ", "タワ", "ワー", "東", "京", "タ", "ワ", "ー", "x"]
    assert got[2][0] == [] and got[3] == ([], "")
    assert rows(df.where("id = 0").select(T.highlight(F.col("s"), "handles", 3))) == [("...ce han...",)]


def test_search_and_paging(spark):
    df = spark.createDataFrame([(i, f"apple banana {'cherry ' * (i % 3)}") for i in range(9)] + [(9, None), (10, "CreateInvoice here")], "id int, t string")
    got = rows(search.search(df, "cherry apple", id_col="id", text_col="t", limit=3, offset=1).select("id", "rank"))
    assert [r for _, r in got] == [2, 3, 4] and {i % 3 for i, _ in got} <= {1, 2}
    assert [r.id for r in search.search(df, "invoice", id_col="id", text_col="t").collect()] == [10]
    assert search.search(df, "...", id_col="id", text_col="t").count() == 0
    assert search.match_count(df, "banana cherry", text_col="t").first().total == 6
    assert search.route("q", glob="*.py") == "grep" and search.route("q") == "fts"


def test_lines_and_grep(spark):
    text = "[Page 1]\na\nb hit x\nc\nd\ne\nf\ng hit x"
    df = spark.createDataFrame([(1, text)], "id int, t string")
    got = lines.grep_text(df, "HIT+x", id_col="id", text_col="t", context=1).first().found
    assert got.split("\n") == ["[[Page 1], Line 2] a", "[[Page 1], Line 3] b hit x", "[[Page 1], Line 4] c", "--", "[[Page 1], Line 7] f", "[[Page 1], Line 8] g hit x"]
    assert rows(df.select(lines.line_slice(F.col("t"), 2, 3), lines.line_index(F.col("t"))[1])) == [("a\nb hit x", 9)]
    assert rows(lines.grep(df, "^g", id_col="id", text_col="t", context=2).select("line", "before", "after")) == [(8, ["e", "f"], [])]
    pages = spark.createDataFrame([(1, 1, None, "x\ny", "text/plain"), (1, 2, "T", "z", "text/plain")], "file_id int, page_number int, section_title string, text string, mime_type string")
    full = lines.assembled(pages).first()
    assert full.full_text == "[Page 1]\n\nx\ny\n\n[Page 2]\n\nz\n" and full.toc == "[Page 1] Page 1 (lines 3-4)\n[Page 2] T (lines 8-8)"
    texts = lines.assembled(pages)
    assert lines.read(texts, pages, 1, page="2", line="1").first().body == "[Page 2]"
    assert lines.read(texts, pages, 1, toc=True).first().body.startswith("[Page 1]")


def test_memory_lifecycle(spark):
    names = "memory_id string, content string, memory_type string, tags array<string>, metadata string, pinned boolean, source string, confidence double, access_count bigint, created_at string, updated_at string, last_accessed string, valid_from string, valid_to string, superseded_id string"
    at = "2026-01-01 00:00:00"
    base = [("a", "rate limit of the gateway is 100 per minute", "semantic", ["api"], "{}", False, "unknown", 1.0, 0, at, at, None, at, None, None), ("b", "the office cat is called Minka", "semantic", ["pets"], "{}", True, "unknown", 1.0, 0, at, at, None, at, None, None)]
    df = spark.createDataFrame(base, names)
    for c in ("created_at", "updated_at", "last_accessed", "valid_from", "valid_to"):
        df = df.withColumn(c, F.col(c).cast("timestamp"))
    new = spark.createDataFrame([("c", "rate limit of the gateway is now 200 per minute, changed last week", "semantic", ["api"], "{}", False, "unknown")], "memory_id string, content string, memory_type string, tags array<string>, metadata string, pinned boolean, source string")
    state, old = memory.superseded(df, new, "2026-02-01")
    assert {r.memory_id: r.superseded_id for r in state.collect()} == {"b": None, "c": "a"}
    assert [(r.memory_id, r.superseded_by) for r in old.collect()] == [("a", "c")]
    assert [r.memory_id for r in memory.recall(state, "gateway rate limit", "2026-02-02").collect()] == ["c"]
    then = memory.recall_as_of(state, old, "gateway rate limit", "2026-01-15").collect()
    assert [(r.memory_id, r.still_current) for r in then] == [("a", False)]
    assert [r.memory_id for r in memory.history(old, "c").collect()] == ["a"]
    assert [r.memory_id for r in memory.pinned(state).collect()] == ["b"]
    log = spark.createDataFrame([("b", "2026-03-01"), ("b", "2026-03-02")], "memory_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r.memory_id: r.access_count for r in memory.reinforced(state, log).collect()} == {"b": 2, "c": 0}
    with pytest.raises(Exception, match="not valid"):
        memory.validated(df.withColumn("content", F.lit(" "))).collect()


def test_supersession_in_order(spark):
    log = [("w", "semantic", 1, "a", "cache keeps forty entries per shard"), ("w", "semantic", 2, "b", "cache keeps sixty entries per shard, changed"), ("w", "semantic", 3, "c", "we switched to tea"), ("w", "semantic", 4, "d", "On 2026-01-10 fixed deadlock in pool"), ("w", "semantic", 5, "e", "On 2026-02-14 fixed deadlock in pool")]
    df = spark.createDataFrame(log, "workspace_id string, memory_type string, seq int, memory_id string, content string")
    got = {r.memory_id: (r.superseded_id, r.closed_by) for r in memory.store_in_order(df).collect()}
    assert got == {"a": (None, "b"), "b": ("a", None), "c": (None, None), "d": (None, None), "e": (None, None)}
    assert sequential.token_set("The über-cache") == {"über", "cache"}


def test_links_and_symbols(spark):
    got = links.links_of("See [x](../b.md#t) [[Note]] `[c](no.md)` src/app/m.py:3 [e](https://x.y)", "docs/g/a.md")
    assert [(x["target"], x["link_type"]) for x in got] == [("docs/b.md", "markdown"), ("docs/g/Note.md", "wikilink"), ("src/app/m.py", "path")]
    files = spark.createDataFrame([(1, "b.md", "r/docs/b.md", "ready"), (2, "b.md", "x/y/docs/b.md", "ready"), (3, "m.py", "app/m.py", "failed"), (4, "n.md", "q/n.md", "ready")], "file_id int, filename string, source_path string, status string")
    edges = spark.createDataFrame([(9, "docs/b.md"), (9, "q/n.md"), (9, "zz/n.md"), (9, "app/m.py")], "from_file_id int, target string")
    out = links.resolved(edges, files)
    assert {r.target: r.to_file_id for r in out.collect()} == {"docs/b.md": 1, "q/n.md": 4, "zz/n.md": 4, "app/m.py": None}
    assert {tuple(r) for r in links.backlinks(out).collect()} == {(1, 1), (4, 2)}
    gone = spark.createDataFrame([(4,)], "file_id int")
    assert {r.target: r.to_file_id for r in links.without_file(out.select("from_file_id", "target", "to_file_id"), gone).collect()}["q/n.md"] is None
    found, targets = symbols.extract("from ..core import z\nclass A:\n    async def f(self, *, k=1): ...\n", "p/q/a.py")
    assert [(s["qualified_name"], s["kind"], s["signature"]) for s in found] == [("A", "class", "A"), ("A.f", "method", "f(self, k)")]
    assert [t["target"] for t in targets] == ["p/core.py", "p/core/__init__.py"]
    assert symbols.extract("def (", "x.py") == ([], [])


def test_names(spark):
    df = spark.createDataFrame([(1, "report.pdf", "r/a/report.pdf", "ready"), (2, "report.pdf", "r/b/report.pdf", "ready"), (3, "budget_2024.xlsx", "c/budget_2024.xlsx", "ready")], "file_id int, filename string, source_path string, status string")
    assert rows(workspace.resolve_name(df, "b/report.pdf")) == [(2, 2, False)]
    assert rows(workspace.resolve_name(df, "budget2024.xlsx")) == [(3, 3, False)]
    assert rows(workspace.resolve_name(df, "3")) == [(3, 1, False)]
    assert workspace.resolve_name(df, "zzzzzz").count() == 0


def test_parsers():
    pages = sources.parse_text("# Title\n\n".encode() + b"para\n\n" * 10, "x.md")
    assert len(pages) == 1 and pages[0][1] == "Title"
    parts = sources.chunks("\n\n".join("x" * 1000 for _ in range(7)))
    assert [len(p) for p in parts] == [2002, 2002, 2002, 1000]
    table = b"a,b\n" + b"".join(b"%d,y\n" % i for i in range(150))
    sheet = sources.parse_csv(table, "s")
    assert [p[1] for p in sheet] == ["Data - rows 2-101", "Data - rows 102-151"] and sheet[0][2].count("a | b") == 2
    assert sources.decoded(b"\xff") == "ÿ" and sources.decoded("\ufeffé".encode()) == "é"
    assert "hidden" not in sources.parse_html(b"<title>T</title><script>hidden</script><p>seen</p>", "x")[0][2]
    with pytest.raises(ValueError):
        sources.parse(b"", "application/x-unknown", "x")


def test_chunk_column_agrees(spark):
    texts = ["short", "\n\n".join("word " * 150 for _ in range(12)), "x" * 9000, "a\n \nb" * 1500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.c for r in df.orderBy("i").select(sources.chunk_column(F.col("t")).alias("c")).collect()] == [sources.chunks(t) for t in texts]


def test_workspace_end_to_end(spark, tmp_path):
    from lectern.api import Workspace

    (tmp_path / "docs").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "docs/a.md").write_text("# Alpha\nThe budget grew. See [b](b.md).\n")
    (tmp_path / "docs/b.md").write_text("# Beta\nAnother budget line here.\n")
    (tmp_path / "code.py").write_text("def budget_total(x):\n    return x\n")
    (tmp_path / "node_modules/x.js").write_text("ignored")
    ws = Workspace(spark, str(tmp_path))
    assert ws.index(as_of="2026-01-01")["ingested"] == 3
    assert ws.index(as_of="2026-01-01")["skipped"] == 3
    assert {r.filename for r in ws.search("budget").collect()} >= {"a.md", "b.md"}
    assert ws.read("a.md", pattern="grew").startswith("[[Page 1], Line")
    assert "budget_total" in {r.name for r in ws.symbols("budget total").collect()}
    assert ws.search("def .*", mode="grep").count() == 1
    assert [r.backlinks for r in links.backlinks(ws.store.table("links")).collect()] == [1]
    assert [r.filename for r in ws.glob("docs/*.md").orderBy("filename").collect()] == ["a.md", "b.md"]
    (tmp_path / "docs/b.md").write_text("# Beta\nChanged text about pears.\n")
    assert ws.index(as_of="2026-01-02")["updated"] == 1
    assert ws.search("pears").count() == 1 and ws.search("another").count() == 0
    first = ws.store_memory("deploys happen on Tuesday mornings each week", "2026-01-03")
    second = ws.store_memory("deploys happen on Friday mornings each week, changed", "2026-01-04")
    assert [r.memory_id for r in ws.recall("deploys mornings", "2026-01-05").collect()] == [second]
    assert [r.memory_id for r in ws.recall_as_of("deploys mornings", "2026-01-03 12:00:00").collect()] == [first]
    assert ws.forget("2026-01-06", query="deploys mornings") == 1
    assert ws.doctor("2026-01-06").where("status <> 'ok'").count() == 0


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.table("t") is None
    store.commit({"t": spark.range(3)})
    with pytest.raises(Exception):
        store.commit({"t": spark.range(2).select(F.raise_error(F.lit("x")))})
    assert store.table("t").count() == 3
    (tmp_path / "s" / "manifest-7.json").write_text('{"vers')  # a writer that died
    assert store.table("t").count() == 3
    assert store.commit({"u": spark.range(1)}) == 8 and store.table("t").count() == 3
    r = Registry(str(tmp_path / "r.json"))
    a, b = r.upsert("/a", "2026-01-01"), r.upsert("/b", "2026-02-01")
    r.use(b)
    assert [x["id"] for x in Registry(str(tmp_path / "r.json")).list()] == [b, a]


def test_change_feeds(spark):
    e = spark.createDataFrame([(i, "p", f"2026-01-01 00:00:{s:06.3f}") for i, s in enumerate([0, 1, 1.9, 2.5, 4.4, 4.5])], "id long, k string, s string").withColumn("ts", F.col("s").cast("timestamp"))
    assert sorted(r.id for r in changes.debounced(e, key="k", time="ts", ident="id").collect()) == [0, 3, 5]
    assert [(r.id, r.accepted) for r in changes.rate_limited(e, key="k", time="ts", ident="id", most=2, seconds=2).orderBy("id").collect()] == [(0, True), (1, True), (2, False), (3, True), (4, True), (5, True)]
    log = spark.createDataFrame([("a", "upsert", None, 1, 1), ("a", "move", "b", 2, 2), ("c", "delete", None, None, 3)], "path string, action string, dest string, value int, seq int")
    view = spark.createDataFrame([("c", 9), ("d", 8)], "path string, value int")
    assert {tuple(r) for r in changes.applied(view, log).collect()} == {("d", 8), ("b", 2)}
    old, new = spark.createDataFrame([("a", "1"), ("b", "1")], "source_path string, checksum string"), spark.createDataFrame([("b", "2"), ("c", "1")], "source_path string, checksum string")
    assert {tuple(r) for r in changes.listing_diff(old, new).collect()} == {("a", "delete"), ("b", "upsert"), ("c", "upsert")}


def test_debounce_stream(spark, tmp_path):
    src = tmp_path / "in"
    e = spark.createDataFrame([(i, "p", f"2026-01-01 00:00:{s:06.3f}") for i, s in enumerate([0, 1, 1.9, 2.5, 4.4, 4.5])], "id long, k string, s string").withColumn("ts", F.col("s").cast("timestamp"))
    e.coalesce(1).write.parquet(str(src))
    stream = changes.debounced_stream(spark.readStream.schema(e.schema).parquet(str(src)), key="k", time="ts")
    q = stream.writeStream.format("memory").queryName("deb").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        assert q.awaitTermination(120)
        assert sorted(r.id for r in spark.table("deb").collect()) == [0, 3, 5]
    finally:
        q.stop()


def test_evaluation(spark, tmp_path):
    low, high = spark.range(1).select(*evals.wilson(F.lit(26.0), F.lit(27.0))).first()
    assert 0.8 < low < 26 / 27 < high <= 1 and evals.needed(0.5, 0.05) == 385
    log = spark.createDataFrame([(1, "search", "x" * 60_000), (2, "memory_recall", "y")], "capture_id int, tool_name string, query string")
    evals.export_captures(evals.capture(log), str(tmp_path / "out"), tool="search")
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 1 and back.select(F.length("query")).first()[0] == 51_200
    assert render.recall_block([{"memory_type": "semantic", "content": "a ``` b", "score": 1.0}], "q").count("```") == 2


def test_rate_stream(spark, tmp_path):
    e = spark.createDataFrame([(i, "p", f"2026-01-01 00:00:{s:06.3f}") for i, s in enumerate([0, 1, 1.9, 2.5, 4.4, 4.5])], "id long, k string, s string").withColumn("ts", F.col("s").cast("timestamp"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = changes.rate_limited_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), key="k", time="ts", most=2, seconds=2)
    q = stream.writeStream.format("memory").queryName("rate").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        assert q.awaitTermination(120)
        assert sorted((r.id, r.accepted) for r in spark.table("rate").collect()) == [(0, True), (1, True), (2, False), (3, True), (4, True), (5, True)]
    finally:
        q.stop()


def test_greedy_folds_by_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [(i, f"k{rng.randrange(6)}" if i % 3 else "hot", rng.randrange(4000)) for i in range(1500)]
    e = spark.createDataFrame(rows, "id long, k string, t long").withColumn("ts", F.timestamp_seconds("t"))
    kept, accepted = set(), {}
    for key in {k for _, k, _ in rows}:
        last, times = None, []
        for t, i in sorted((t, i) for i, k, t in rows if k == key):
            if last is None or t - last >= 30:
                kept.add(i)
                last = t
            times = [x for x in times if x > t - 60]
            accepted[i] = len(times) < 5
            times += [t] * accepted[i]
    assert {r.id for r in changes.debounced(e, key="k", time="ts", ident="id", seconds=30).collect()} == kept
    assert {r.id: r.accepted for r in changes.rate_limited(e, key="k", time="ts", ident="id", most=5, seconds=60).collect()} == accepted


def test_watch(spark, tmp_path):
    import time

    from lectern.streaming.watch import Watches

    root, seen = tmp_path / "w", []
    root.mkdir()
    (root / "a.txt").write_text("one")
    watches = Watches(spark, str(tmp_path / "state"))
    w = watches.start(str(root), lambda df: seen.extend(map(tuple, df.collect())), seconds=0.5)
    try:
        with pytest.raises(ValueError):
            watches.start(str(root), print)
        until = time.time() + 60
        while time.time() < until and ("a.txt", "upsert") not in seen:
            time.sleep(0.3)
        (root / "b.txt").write_text("two")
        (root / "a.txt").unlink()
        while time.time() < until and not {("b.txt", "upsert"), ("a.txt", "delete")} <= set(seen):
            time.sleep(0.3)
        assert set(seen) == {("a.txt", "upsert"), ("b.txt", "upsert"), ("a.txt", "delete")}
        assert watches.get(w.watch_id).counts["delete"] == 1
    finally:
        watches.stop(w.watch_id)
    assert watches.list() == []


def test_local_files(spark, tmp_path):
    from lectern.sources import local

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "n.md").write_text("# Title\n\nalpha beta\ngamma")
    assert "alpha beta" in local.read(spark, str(tmp_path), "d/n.md") and local.read(spark, str(tmp_path), "d/n.md", line="3-3")
    assert [r.source_path for r in local.glob(spark, str(tmp_path), "d/*.md").collect()] == ["d/n.md"]
    assert local.grep(spark, str(tmp_path), "GAMMA").count() == 1
    for bad in ("../x", "/etc/passwd", "d/../../x"):
        with pytest.raises(PermissionError):
            local.confined(str(tmp_path), bad)
    assert local.git_head(str(tmp_path)) is None


def test_tokenizers(spark):
    from lectern.functions.tokenizers import Tokenizers

    t = Tokenizers()
    assert t.fingerprint() == "unicode/builtin/rules2"
    t.register("pairs", "chinese", lambda run: [run[i : i + 2] for i in range(0, len(run), 2)], "3")
    assert t.fingerprint() == "pairs/3/rules2"
    df = spark.createDataFrame([("数据库abc 词", ), ("plain-words", ), (None, )], "s string")
    assert [r.t for r in df.select(t.index_tokens(F.col("s")).alias("t")).collect()] == [["数据", "库", "abc", "词"], ["plain", "words", "plain", "words"], []]
    with pytest.raises(ValueError):
        t.register("x", "klingon", list)


def test_anchors_upsert(spark):
    old = spark.createDataFrame([("m", "a.py", "f", "1"), ("m", "a.py", None, "2")], "memory_id string, file_path string, symbol string, sig_hash string")
    new = spark.createDataFrame([("m", "a.py", "f", "9"), ("n", "a.py", "f", "3")], old.schema)
    assert {tuple(r) for r in memory.anchored(old, new).collect()} == {("m", "a.py", "f", "9"), ("m", "a.py", None, "2"), ("n", "a.py", "f", "3")}


def test_evaluation_extras(spark):
    c = spark.createDataFrame([(1, 1, 1.0, 0.0), (1, 2, 0.5, 1.0), (2, 1, 1.0, 0.0), (2, 2, 0.5, 1.0), (3, 1, 1.0, 0.0), (3, 2, 0.5, 1.0)], "question_id long, id long, lexical double, recency double")
    gold = spark.createDataFrame([(1, 2), (2, 2), (3, 1)], "question_id long, id long")
    cases = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "question_id long, category string")
    assert {tuple(r) for r in evals.leave_one_out(c, gold, cases, [0.0, 1.0]).collect()} == {("a", 0.0, 0.0), ("b", 0.0, 0.0), ("c", 1.0, 0.0)}
    runs = spark.createDataFrame([("t", "success", 10, 1.0, 3), ("t", "success", 20, 2.0, 4), ("t", "failed", 99, 9.0, 9), ("u", "failed", 1, 1.0, 1)], "task string, status string, total_tokens long, wall_seconds double, tool_calls long")
    got = {r.task: r for r in evals.run_metrics(runs, ["task"]).collect()}
    assert (got["t"].median_tokens, got["t"].min_tokens, got["t"].max_tokens, got["t"].median_time, got["t"].success_rate, got["t"].median_tool_calls) == (15, 10, 20, 1.5, 0.67, 3)
    assert (got["u"].median_tokens, got["u"].success_rate) == (0, 0.0)
    picks = spark.range(4000).select(evals.weighted_choice(F.col("id"), {"x": 1, "y": 3, "z": 0}, 7).alias("c")).groupBy("c").count().collect()
    share = {r.c: r["count"] / 4000 for r in picks}
    assert set(share) == {"x", "y"} and abs(share["x"] - 0.25) < 0.03


def test_sheet_rows_are_numbered(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a,b\n" + "\n".join(f"{i},x" for i in range(1, 351)))
    got = sources.sheets(spark, str(tmp_path / "s.csv")).collect()
    assert sorted((r.row_number, r.page_number) for r in got) == [(i, (i - 1) // 100 + 1) for i in range(1, 351)] and all(r["values"].a == str(r.row_number) for r in got)
