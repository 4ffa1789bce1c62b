"""Every operator and stage on awkward rows: nulls in any column, repeated rows, texts of megabytes, ties, clashing columns, no rows."""

from __future__ import annotations

import random
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import DOCS, corpus, frame, prose, query

from lectern.llm import registry

LONG = prose(random.Random(3), "en", 60_000) + " " + "x" * 1_000_000 + " api_key: abcdefgh " * 500
ROWS = corpus(40, seed=6)
AWKWARD = ROWS + [ROWS[5], ROWS[5], ROWS[20]] + [(None, ROWS[6][1], None, None, None), (None, None, None, None, None), (700, LONG, "en", "src1", None), (700, LONG, "en", "src1", None), (0, "", None, None, None)]
NAMES = [n for n in registry.QUERIES if not n.startswith(("op3_", "op10_"))]


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_every_row(spark, tmp_path, name):
    """Results keep every row, and rows that repeat another have its result."""
    extra = DOCS + ", n string, key string, block string, word string, scan_base string, arc string"
    got = query(spark, tmp_path, registry.QUERIES[name], [(*r, *"abcdef") for r in AWKWARD], schema=extra)
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in AWKWARD)
    if name.startswith("op8_"):  # rows of one key have slots of their own
        return
    for i in (5, 20, 700):
        own = [repr(sorted(r.items())) for r in got if r["doc_id"] == i]
        assert len(set(own)) == 1, own


def test_mixture_of_awkward_rows(spark, tmp_path):
    got = query(spark, tmp_path, registry.QUERIES["op10_mixing"], AWKWARD)
    mine = Counter((r["doc_id"], r["copies"]) for r in got)
    assert set(i for i, _ in mine) <= {r[0] for r in AWKWARD}
    assert all(n == 1 or i in (None, 0, 5, 20, 700) for (i, _), n in mine.items())


def test_stages_keep_columns_and_take_no_rows(spark, tmp_path):
    import corpus_pipeline

    clash = "lectern_quality lectern_base lectern_random kept_id lectern_at lectern_near c0 c1 mix_tokens block kept codes band_lang"
    for rows in ([], AWKWARD[:60] + AWKWARD[-8:]):
        docs = frame(spark, rows, clash)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.mode("overwrite").parquet(str(tmp_path / f"{len(rows)}-{k}"))
            out = spark.read.parquet(str(tmp_path / f"{len(rows)}-{k}"))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
                assert not rows or out.where("mix_tokens <> 'clash' or lectern_base <> 'clash'").count() == 0
            docs = out
        assert (docs.count() > 0) == bool(rows)
