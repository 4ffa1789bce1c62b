"""Whole texts are read, and small files with much work are dealt to all cores."""

from __future__ import annotations

from lectern.operators import lines, search, symbols
from lectern.plans import catalog


def test_grep_reads_lines_to_their_end(spark):
    df = spark.createDataFrame([(1, "no\n" + "x" * 25_000 + " ELLE"), (2, "elle"), (3, None)], "doc_id bigint, text string")
    got = lines.grep(df, "elle", id_col="doc_id", text_col="text", ignore_case=True)
    assert sorted((r.doc_id, r.line) for r in got.collect()) == [(1, 2), (2, 1)]


def test_code_of_one_part_is_parsed_by_many(spark):
    rows = [(i, f"pkg/p{i}.py", f"import os\ndef f{i}(x):\n    return x\n") for i in range(100)] + [(200, "x.txt", "import os"), (201, "a.py", None), (202, "b.ts", "import q from './q'\nclass W {}")]
    files = spark.createDataFrame(rows, "file_id bigint, source_path string, text string").coalesce(1)
    for found, n in ((symbols.symbols(files), 101), (symbols.imports(files), 208)):
        assert found.count() == n
        assert found.rdd.getNumPartitions() >= 4


def test_bundle_parses_its_symbols_once(spark):
    parsed = spark.sparkContext.accumulator(0)
    rows = [(i, f"pkg/p{i}.py", f"import os\ndef f{i}(x):\n    return x\n") for i in range(20)]
    files = spark.createDataFrame(rows, "file_id bigint, source_path string, text string")
    found = symbols.symbols(files)

    def counted(batches):
        for batch in batches:
            parsed.add(batch.num_rows)
            yield batch

    got = search.context_bundle(found.mapInArrow(counted, found.schema), files, "f4", id_col="file_id", text_col="text").collect()
    assert [(r.kind, r.file) for r in got if r.kind == "code"] == [("code", "4")]
    assert parsed.value == 20


def test_one_search_builds_no_index(spark, small, monkeypatch):
    def no_index(*_):
        raise AssertionError("an index of all terms was built for one search")

    monkeypatch.setattr(catalog, "document_index", no_index)
    for name, n in (("search_page_offset", 15), ("bm25_two_column", 20)):
        assert catalog.QUERIES[name](spark, small).count() == n
