import duckdb
import pyarrow.parquet as pq
import pytest
import sentencepiece
import test_decontaminate
import test_line_dedup
import test_ngram_join
import test_quality

import __spark_entry__ as contract
import corpus_pipeline
from codestrata.llm import models, queries

ROOT = "/root/testdata/sf0.001"


def plain(spark):
    """The five stages over Python lists."""
    model = sentencepiece.SentencePieceProcessor(model_file=models.MODEL)
    rows = pq.read_table(f"{ROOT}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    docs = {r["doc_id"]: r["text"] for r in rows if test_quality.brute(r["text"], r["lang"], model)[0][-1]}
    places, group = test_line_dedup.brute(spark, sorted(docs.items()))
    first = {}
    for _, doc, _, at, line in sorted(places, key=lambda p: (p[1], p[3])):
        first.setdefault(group[line], (doc, at))
    kept = set(first.values())
    norm = test_line_dedup.norm
    docs = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if not norm(x) or (d, k) in kept) for d, t in docs.items()}
    docs = {r[1]: docs[r[1]] for r in test_ngram_join.brute(sorted(docs.items())) if r[1] == r[3] or not docs[r[1]].split()}
    items = pq.read_table(f"{ROOT}/benchmark.parquet").to_pylist()
    dirty = {m[1] for m in test_decontaminate.brute(sorted(docs.items()), [(i["item_id"], i["text"]) for i in items])}
    return {d: (t, model.encode(t)) for d, t in docs.items() if d not in dirty}


def test_run_equals_the_plain_version(spark):
    out = corpus_pipeline.run(spark, ROOT)
    assert out.columns == [*spark.read.parquet(f"{ROOT}/documents.parquet").columns, "ids"]
    rows = out.collect()
    assert {r.doc_id: (r.text, r.ids) for r in rows} == plain(spark)
    assert all(r.n_chars == len(r.text) for r in rows)


def test_one_row_of_each_group_of_near_copies(spark):
    one, two, three = (" ".join(f"{c}{k}" for k in range(40)) for c in "abc")
    rows = [(1, one, "x"), (1, one, "y"), (1, one, "x"), (2, one + " end", "x"), (2, two, "x"), (None, two, "x"), (None, three, "x"), (None, three, "y"), (None, three + " end", "x")]
    rows += [(4, "", "x"), (4, "", "x"), (None, None, "x"), (5, None, "x"), (None, "5", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    left = corpus_pipeline.one_of_near_copies(spark, docs, ROOT)
    got = sorted(map(repr, map(tuple, left.collect())))
    unnamed = [r for r in got if r.startswith("(None, 'c0 ")]
    assert left.columns == docs.columns and len(unnamed) == 1 and unnamed[0].endswith("'x')")
    assert sorted(set(got) - set(unnamed)) == sorted({repr(r) for r in [rows[0], rows[4], *rows[9:]]}) and len(got) == 8


def test_every_operator_is_registered():
    names = contract.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in queries.QUERIES}
    assert set(queries.QUERIES) <= set(names) and set(queries.ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_equal_the_oracle(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{ROOT}/{table}.parquet'")
    df = queries.QUERIES[name](spark, ROOT)
    columns = sorted(df.columns)
    relation = db.sql(queries.ORACLES[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in relation.fetchall())
