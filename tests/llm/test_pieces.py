"""Memory of op9's blocks while they are coded."""

from __future__ import annotations

import random

import pyarrow as pa

from lectern.llm import pieces


def test_blocks_hold_no_texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(14)) for _ in range(2000)]
    base, held, size = pa.total_allocated_bytes(), [], 0

    def batches():
        nonlocal size
        for _ in range(16):
            texts = [" ".join(rng.choices(words, k=500)) + rng.choice(["", "  two"]) for _ in range(140)]
            size += sum(map(len, texts))
            yield pa.RecordBatch.from_arrays([pa.array([{"doc_id": i} for i in range(len(texts))]), pa.array(texts)], names=["kept", "text"])
            del texts
            held.append(pa.total_allocated_bytes() - base)

    out = list(pieces.code_blocks(1 << 30)(batches()))
    assert len(out) == 1 and len(out[0].column("kept")[0]) == 16 * 140
    assert max(held) < size / 2
    codes, found = pieces.spread(out[0].column("codes")[0].as_py()), out[0].column("words")[0].as_py()
    assert sum(len(found[c]) for c in codes.tolist()) < size and len(set(found)) == len(found)
