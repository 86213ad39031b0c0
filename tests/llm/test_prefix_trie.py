import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from codestrata.llm import prefix_trie, queries
from codestrata.session import Scratch

KIND = "conv_id long, turn long, role string, text string, depth long, key string, shard string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:]
    return out


def plain(conversations):
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in conversations.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        saved[node] = sum(saved[c] for c in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    digest = lambda node: hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
    rows = [(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], digest(n)) for n, m in members.items()]
    return sorted(rows, key=str)


def talk(seed, count, hot=0):
    rng = random.Random(seed)
    rows = []
    for c in range(count):
        size = rng.choice([0, 1, 2, 3, 5, 8])
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hello", "é 日本", "", "again and again"]) if t < 3 else f"{rng.random()}", 1, "k", "s") for t in range(size)]
    return rows + [(1000 + c, t, "user", f"same {t}", 1, "k", "s") for c in range(hot) for t in range(4)]


def got(spark, rows, tmp_path):
    spark.createDataFrame(rows, KIND).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    return sorted((tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op12_conversation_trie"](spark, str(tmp_path)).collect()), key=str)


def test_query_against_plain(spark, tmp_path):
    rows = talk(1, 250, hot=120)
    rows += [(7, None, "user", "null turn first", 1, "", ""), (8, 0, None, None, 1, "", ""), (8, 0, None, None, 1, "", ""), (None, 1, "user", "nobody", 1, "", "")]
    rows += [(-5, 0, "user", "hello", 1, "", ""), (3, 1, "user", "x" * 200_000, 1, "", "")]
    rows += [(c, t, "user", f"deep {t}", 1, "", "") for c in (300, 555, 777) for t in range(500)]
    assert got(spark, rows, tmp_path) == plain(rebuilt(rows))


def test_empty_table(spark, tmp_path):
    assert got(spark, [], tmp_path) == []


@pytest.mark.parametrize("most,limit", [(10, 32_000_000), (40, 200), (10**6, 32_000_000)])
def test_any_number_of_shards(spark, monkeypatch, most, limit):
    """Copies and common prefixes over many shards, turnless conversations, merged shards."""
    monkeypatch.setattr(prefix_trie, "SKELETON", limit)
    monkeypatch.setattr(prefix_trie, "IDS_AT_ONCE", 3)
    given = {c: [(r, x) for _, _, r, x, *_ in ts] for c, ts in ((c, [row for row in talk(4, 60, hot=40) if row[0] == c]) for c in [*range(60), *range(1000, 1040)])}
    rows = [(c, [(hashlib.sha256(repr(t).encode()).hexdigest()[:32], len(t[1])) for t in ts]) for c, ts in given.items()]
    table = spark.createDataFrame(rows, "conv_id long, turns array<struct<digest: string, length: int>>")
    with Scratch(spark) as scratch:
        nodes = sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(scratch, table, most).collect()), key=str)
    assert nodes == plain(given)


def test_shared_turns():
    rng = random.Random(2)
    for _ in range(300):
        words = [bytes([rng.randrange(2)]) * prefix_trie.WIDTH for _ in range(60)]
        a, b = (words[: rng.randrange(40)] + [bytes([rng.randrange(3)]) * prefix_trie.WIDTH for _ in range(rng.randrange(20))] for _ in range(2))
        want = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert prefix_trie.shared(b"".join(a), b"".join(b)) == want
