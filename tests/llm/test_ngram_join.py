import numpy as np
import pytest

from codestrata.llm import ngram_join as J


def shingles(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return set()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    ids = [r[0] for r in rows]
    lowest = list(ids)
    named = [k for k in range(len(rows)) if ids[k] is not None]
    changed = True
    while changed:
        changed = False
        for a in named:
            for b in named:
                common = len(sets[a] & sets[b])
                if (common and 100 * common >= 75 * len(sets[a] | sets[b])) and lowest[a] != lowest[b]:
                    lowest[a] = lowest[b] = min(lowest[a], lowest[b])
                    changed = True
    return sorted((i is None, i or 0, len(s), c or 0) for i, s, c in zip(ids, sets, lowest))


def test_components_equal_brute_force(odd_docs, odd_rows):
    got = J.components(odd_docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == brute(odd_rows)


def test_empty_table(no_docs):
    assert J.components(no_docs).count() == 0


def test_large_groups_of_near_copies_and_common_passages(spark):
    """More sharers of a block than are compared outright, with strays that only share a passage."""
    common = [f"c{k}" for k in range(60)]
    rows = [(k, " ".join([*common, f"own{k}", f"more{k}"])) for k in range(300)]
    rows += [(1000 + k, " ".join([*common[:30], *[f"s{k}_{j}" for j in range(25 + k % 9)]])) for k in range(120)]
    rows += [(2000 + 2 * k + j, " ".join([*common[20:50], *[f"p{k}_{i}" for i in range(60)], f"end{j}"])) for k in range(40) for j in range(2)]
    got = {r.doc_id: r.component_id for r in J.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = {r[0]: r[0] for r in rows} | {k: 0 for k in range(300)} | {2001 + 2 * k: 2000 + 2 * k for k in range(40)}
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_sent_blocks_meet_and_sketches_bound_the_difference(seed):
    rng = np.random.default_rng(seed)
    for n in [*range(1, 40), 47, 48, 63, 64, 255, 256, 300, 1023, 1024, 3000]:
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for gone in {0, n // 20, n // 8, n // 7, n // 4}:
            for new in {0, n // 20, n // 8, n // 7, n // 4, n // 3}:
                b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**64, new, dtype=np.uint64)]))
                assert J.hamming(J.sketch(a), J.sketch(b)) <= np.setxor1d(a, b).size
                if b.size and J.links(a, b):
                    assert np.intersect1d(J.tokens(a), J.tokens(b)).size
                    assert np.setxor1d(a, b).size <= J.most_differing(a.size, b.size)
