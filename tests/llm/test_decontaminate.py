import random

from codestrata.llm import decontaminate as D


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(docs, items):
    out = set()
    for d in docs:
        for i in items:
            want, have = shingles(i[1]), shingles(d[1])
            if d[0] is not None and i[0] is not None and want and 100 * len(want & have) >= 75 * len(want):
                out.add((i[0], d[0], len(want), len(want & have)))
    return out


def test_matches_equal_brute_force(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(4)
    long = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    items = [(k, " ".join(long[k * 700 : k * 700 + 8 + 2 * k])) for k in range(25)]
    items += [(100, odd_rows[10][1]), (101, "one"), (102, ""), (103, None), (None, "one"), (104, "not anywhere at all in here")]
    edited = list(long)
    for k in range(25):
        edited[k * 700 + 4 + k] = "changed"
    rows = [(500, " ".join(long)), (501, " ".join(edited)), (502, " ".join(long[9000:9100]).upper())]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in D.matches(docs, table).select("item_id", "doc_id", "n_item", "n_shared").collect()}
    want = brute([*odd_rows, *rows], items)
    best = {(w[0], w[1]): w for w in sorted(want, key=lambda w: (w[3], w[2]))}
    assert got == set(best.values()) and len(got) > 30
    clean = D.keep_clean(docs, table)
    dirty = {w[1] for w in want}
    assert clean.columns == ["doc_id", "text"]
    assert clean.count() == sum(r[0] not in dirty for r in [*odd_rows, *rows])
    assert D.matches(no_docs, table).count() == 0 == D.matches(docs, table.limit(0)).count()


def test_short_items_in_long_documents(spark):
    rng = random.Random(11)
    docs = [(d, " ".join(f"w{rng.randrange(50_000)}" for _ in range(n))) for d, n in enumerate((9_000, 16_000, 20_000))]
    items = []
    for d, text in docs:
        words = text.split()
        for k in range(60):
            part = words[k * 140 : k * 140 + 5 + k % 6]
            if len(part) >= 9:
                part[-1] = "changed"
            items.append((100 * d + k, " ".join(part)))
    got = D.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    assert {tuple(r) for r in got.select("item_id", "doc_id", "n_item", "n_shared").collect()} == want and len(want) == 180


def test_clean_rows_whatever_their_ids(spark):
    leak, other = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(None, f"so {leak} it goes"), (None, "nothing of it in here at all"), (1, f"and {other} again"), (2, "free of it"), (2, leak), (3, None)]
    items = [(7, leak), (None, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = D.keep_clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(repr, map(tuple, clean.collect()))) == sorted(map(repr, [rows[1], rows[3], rows[5]]))
