import numpy as np

from codestrata.llm import near_vectors

KIND = "vec_id long, embedding array<float>, a long, v string, node string, component_id string"


def plain(rows, dims):
    """All pairs by cosine, and groups by repeated merging."""
    good = [k for k, (_, v) in enumerate(rows) if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    u = np.array([np.float32(rows[k][1]).astype(float) for k in good]).reshape(-1, dims)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    for _ in range(len(rows)):
        fresh = label.copy()
        for i, k in enumerate(good):
            fresh[k] = min([label[k], *(label[good[j]] for j in np.flatnonzero(near[i]))])
        if (fresh == label).all():
            break
        label = fresh
    links = dict.fromkeys(range(len(rows)), 0) | {k: int(near[i].sum()) for i, k in enumerate(good)}
    names = {g: min((rows[k][0] for k in range(len(rows)) if label[k] == g and rows[k][0] is not None), default=None) for g in set(label.tolist())}
    return sorted(((r[0], links[k], names[label[k]], r[0] is not None and r[0] == names[label[k]]) for k, r in enumerate(rows)), key=str)


def groups(seed, sizes, dims=64, spread=(0.05, 0.22)):
    rng = np.random.default_rng(seed)
    out = []
    for size in sizes:
        centre = rng.normal(size=dims)
        for k in range(size):
            noise = rng.normal(size=dims)
            far = rng.uniform(*spread) if size > 1 and k else 0.0
            out.append((centre / np.linalg.norm(centre) + far * noise / np.linalg.norm(noise)).tolist())
    return [np.float32(v).tolist() for v in out]


def run(spark, rows):
    table = spark.createDataFrame([(i, v, 1, "x", "y", "z") for i, v in rows], KIND).repartition(5)
    return sorted((tuple(r) for r in near_vectors.components(table).collect()), key=str)


def test_groups_copies_and_odd_rows(spark):
    vs = groups(1, [1] * 200 + [2] * 30 + [7, 60])
    rows = [(3 * k, v) for k, v in enumerate(vs)]
    rows += [(5001, None), (5002, []), (5003, [0.0] * 64), (5004, [float("nan")] + [1.0] * 63), (5005, [None] + [1.0] * 63), (5006, [1.0, 2.0]), (None, [0.0] * 64)]
    rows += [(6000 + k, vs[210]) for k in range(40)] + [(9, vs[3]), (9, vs[3]), (0, vs[9]), (None, vs[12]), (7000, [3 * x for x in vs[20]]), (7001, [-x for x in vs[20]])]
    assert run(spark, rows) == plain(rows, 64)


def test_long_list_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "CHUNK", 16)
    monkeypatch.setattr(near_vectors, "MEMBERS_AT_ONCE", 50)
    rows = list(enumerate(groups(2, [150, 40, 1, 1, 1], spread=(0.01, 0.1))))
    assert run(spark, rows) == plain(rows, 64)


def test_few_vectors_and_none(spark):
    assert run(spark, []) == []
    for rows in ([(1, [1.0, 0.0])], [(2, None)], [(4, [1.0, 0.0]), (3, [1.0, 0.1]), (2, [0.0, 1e-30]), (5, [0.0, 1.0])]):
        assert run(spark, rows) == plain(rows, 2)
    rows = [(k, [1.0, 0.02 * k]) for k in range(60)]  # a chain of links between ends that are none
    assert run(spark, rows) == plain(rows, 2)


def test_recall_of_pairs_at_the_bound(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.normal(size=a.shape)
    z -= (z * a).sum(1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * z
    rows = list(enumerate(np.float32(np.vstack([a, b])).tolist()))
    found = sum(r[1] for r in run(spark, rows)) / 3000
    assert found >= 0.97
