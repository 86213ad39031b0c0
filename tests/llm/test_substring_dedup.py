import random
from collections import Counter

import numpy as np
import pytest

from codestrata.llm import substring_dedup as S


def brute(rows, width):
    words = [(r[1] or "").encode().split() for r in rows]
    seen = Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    out = []
    for r, w in zip(rows, words):
        gone = {k + j for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for j in range(width)}
        out.append((r[0] is None, r[0] or 0, b" ".join(x for k, x in enumerate(w) if k not in gone).decode(), len(w), len(gone)))
    return sorted(out)


def found(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text, r.n_words, r.n_removed) for r in df.collect())


def test_odd_rows_equal_brute_force(odd_docs, odd_rows, no_docs):
    assert found(S.cleaned(odd_docs)) == brute(odd_rows, 35)
    assert S.cleaned(no_docs).count() == 0


@pytest.mark.parametrize("block", [3_000, 10_000_000])
def test_any_block_size_finds_the_same(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "BUCKETS", block)
    rng = random.Random(3)
    passage = [f"p{rng.randrange(40)}" for _ in range(90)]
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(9)}" for _ in range(rng.randrange(120))]
        a, b = sorted(rng.randrange(91) for _ in range(2))
        at = rng.randrange(len(words) + 1)
        rows.append((k, " ".join(words[:at] + passage[a:b] + words[at:])))
    assert found(S.cleaned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width=12, seed=4)) == brute(rows, 12)


def test_minima():
    h = np.random.default_rng(2).integers(0, 2**64, 200, dtype=np.uint64)
    for width in (1, 2, 3, 7, 8, 28, 31):
        assert (S.window_minima(h, width) == np.lib.stride_tricks.sliding_window_view(h, width).min(1)).all()
