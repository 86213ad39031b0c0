"""Which review calls the token budget lets through, with a cache in front."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.operators.answers import completion, http_class
from codestrata.operators.ordered import running_total
from codestrata.session import cut_lineage
from codestrata.sources.provider import Transport, send_all

_LEVELS = ["_p", "_hi", "_mid"]


def _ranked(requests: DataFrame) -> DataFrame:
    """Slices of the order (priority descending, ``seq`` ascending), from coarse to fine."""
    return (
        requests.withColumn("_p", -F.col("priority"))
        .withColumn("_hi", F.shiftright("seq", 32))
        .withColumn("_mid", F.shiftright("seq", 16))
    )


def _first_by_key(requests: DataFrame) -> DataFrame:
    place = F.struct((-F.col("priority")).alias("p"), "seq")
    return requests.groupBy("key").agg(F.min(place)["seq"].alias("_first"))


def split_cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Add ``is_cache_hit`` and the cached answer. Cache rows without content, tokens or model count as misses."""
    usable = cache.where("content is not null and tokens_used is not null and model is not null").groupBy("key").agg(
        F.max(F.struct("content", "tokens_used", "model")).alias("cached")
    )
    return requests.join(usable, "key", "left").withColumn("is_cache_hit", F.col("cached").isNotNull())


def replay(requests: DataFrame, limit: int) -> DataFrame:
    """Outcome of each request when its token cost is known.

    ``requests(key, priority, seq, tokens)``. The first request of a key pays; a
    call goes out while the tokens used before it are below ``limit``; a limit of
    zero or less means no limit. Later requests of a paid key are cached. Once a
    call is denied every later one is, so the sum over all payers decides.
    """
    payer = F.min(F.struct((-F.col("priority")).alias("p"), "seq", "tokens")).alias("f")
    firsts = requests.groupBy("key").agg(payer).select("key", (-F.col("f.p")).alias("priority"), "f.seq", "f.tokens", F.col("f.seq").alias("_first"))
    if limit <= 0:
        decided = firsts.select("key", "_first", F.lit(True).alias("_go"))
    else:
        # One row a key, written: the requests are read once for it and once for their outcomes.
        paid = running_total(_ranked(cut_lineage(firsts)), _LEVELS, ["seq"], "tokens", "_before")
        decided = paid.select("key", "_first", (F.col("_before") < limit).alias("_go"))
    outcome = F.when(~F.col("_go"), "denied").when(F.col("seq") == F.col("_first"), "called").otherwise("cached")
    return requests.join(decided, "key").withColumn("outcome", outcome).drop("_first", "_go")


def run_reviews(
    requests: DataFrame, transport: Transport, limit: int, cache: DataFrame | None = None, bound: Column | None = None,
    waits: tuple[float, ...] = (2.0, 5.0),
) -> tuple[DataFrame, DataFrame]:
    """Send requests under a token budget; returns (outcomes, cache with the new answers).

    ``requests(key, priority, seq, payload)``. Costs are known only afterwards,
    so calls go out in waves. A wave holds the first pending request of each key
    that stays inside the budget even if everything before it cost its upper
    bound. Each decision therefore equals that of calling one by one, while a
    wave runs in parallel. The default bound is one token per payload byte plus
    the longest answer.
    """
    top = bound if bound is not None else F.octet_length("payload") + 4096
    pending = cut_lineage(requests.withColumn("_bound", top.cast("long")))
    known = cache
    used, done = 0, []
    columns = ["key", "priority", "seq", "outcome", "content", "tokens_used", "model", "error"]
    while True:
        if known is not None:
            looked = cut_lineage(split_cached(pending, known))
            hits = looked.where("is_cache_hit").select("key", "priority", "seq", F.lit("cached").alias("outcome"), "cached.*", F.lit(None).cast("string").alias("error"))
            done.append(hits.select(*columns))
            pending = looked.where("not is_cache_hit").drop("cached", "is_cache_hit")
        if pending.isEmpty():
            break
        if 0 < limit <= used:
            none = F.lit(None).cast("string")
            done.append(pending.select("key", "priority", "seq", F.lit("denied").alias("outcome"), none.alias("content"), F.lit(0).cast("long").alias("tokens_used"), none.alias("model"), none.alias("error")))
            break
        safe = pending
        if limit > 0:
            safe = running_total(_ranked(pending), _LEVELS, ["seq"], "_bound", "_before").where(F.col("_before") + used < limit).drop(*_LEVELS, "_before")
        wave = cut_lineage(safe.join(_first_by_key(pending), "key").where(F.col("seq") == F.col("_first")).drop("_first"))
        spread = wave.repartition(wave.sparkSession.sparkContext.defaultParallelism, "key")
        answers = send_all(spread, transport, waits).withColumn("c", completion(F.col("body")))
        state = http_class(F.col("http_status"))
        error = F.when(state == "retryable", F.coalesce("failure", F.lit("unavailable"))).when(state == "non_retryable", F.lit("rejected")).otherwise(F.col("c.error"))
        sent = cut_lineage(answers.select("key", error.alias("error"), "c.content", "c.tokens_used", "c.model"))
        ok = F.col("error").isNull()
        called = wave.select("key", "priority", "seq").join(sent, "key")
        done.append(called.withColumn("outcome", F.when(ok, "called").otherwise("failed")).withColumn("tokens_used", F.when(ok, F.col("tokens_used")).otherwise(0)).select(*columns))
        used += sent.where(ok).agg(F.coalesce(F.sum(F.greatest("tokens_used", F.lit(0))), F.lit(0))).first()[0]
        fresh = sent.where(ok).select("key", "content", "tokens_used", "model")
        known = fresh if known is None else known.select("key", "content", "tokens_used", "model").unionByName(fresh)
        pending = cut_lineage(pending.join(wave.select("key", "seq"), ["key", "seq"], "left_anti"))
    outcomes = done[0]
    for more in done[1:]:
        outcomes = outcomes.unionByName(more)
    return outcomes, known
