import base64

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from codestrata.llm import models, token_files
from codestrata.session import Scratch


def test_counts_equal_the_public_library(odd_docs, odd_rows, no_docs):
    ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in open(models.RANKS, "rb").read().splitlines())}
    library = tiktoken.Encoding("own", pat_str=token_files.SPLIT, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r[0] is None, r[0] or 0, len(library.encode_ordinary(r[1] or ""))) for r in odd_rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in token_files.counts(odd_docs).collect()) == want
    assert token_files.counts(no_docs).count() == 0


@pytest.mark.parametrize("block", [2, 6, 10, 64, 4096])
def test_documents_over_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(5)
    files, want = [], set()
    for k in range(6):
        tokens = rng.integers(0, 4, 60 * k).astype("<u2")
        if k == 2:
            tokens[:] = 1  # no separator
        path = f"file://{tmp_path}/{k}.tokens"
        (tmp_path / f"{k}.tokens").write_bytes(tokens.tobytes())
        files.append((path,))
        start = 0
        for ordinal, at in enumerate([*np.flatnonzero(tokens == 0).tolist(), None]):
            if at is not None or start < tokens.size:
                want.add((path, ordinal, (tokens.size if at is None else at) - start, at is not None))
            start = tokens.size if at is None else at + 1
    with Scratch(spark) as scratch:
        scanned = scratch.keep(token_files.blocks(spark.createDataFrame(files, "path string"), separator=0, size=block))
        assert {(r.path, r.ordinal, r.n_tokens, r.closed) for r in token_files.documents(scanned).collect()} == want


def test_torn_file(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    with pytest.raises(Exception, match="not a multiple"):
        token_files.blocks(spark.createDataFrame([(f"{tmp_path}/x",)], "path string")).collect()


def test_ids_that_do_not_fit(spark, no_docs, tmp_path):
    with pytest.raises(ValueError, match="differ"):
        token_files.write(no_docs, f"file://{tmp_path}", separator=7)
    (tmp_path / "wide.tiktoken").write_bytes(base64.b64encode(b"a") + b" 70000\n")
    with pytest.raises(ValueError, match="at most 65535"):
        token_files.write(no_docs, f"file://{tmp_path}", ranks=str(tmp_path / "wide.tiktoken"))


def test_many_tasks_read_one_file(spark, tmp_path):
    (tmp_path / "x").write_bytes(np.arange(4000, dtype="<u2").tobytes())
    scanned = token_files.blocks(spark.createDataFrame([(f"file://{tmp_path}/x",)], "path string"), separator=0, size=64)
    assert scanned.select(F.spark_partition_id()).distinct().count() > 1


def test_no_join_collects_rows_on_the_driver(spark, odd_docs, monkeypatch):
    plans = []

    def seen(self, df, then):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return then(self, df)

    for name in ("keep", "result"):
        monkeypatch.setattr(Scratch, name, lambda self, df, then=getattr(Scratch, name): seen(self, df, then))
    assert token_files.counts(odd_docs).count() == odd_docs.count()
    assert any("SortMergeJoin" in plan for plan in plans) and not any("Broadcast" in plan for plan in plans)
