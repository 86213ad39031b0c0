import json
import random

import pytest
from pyspark.sql import functions as F

from codestrata.operators import budget
from codestrata.sources.provider import checked_transport, send


def _service():
    """A service whose cost and failure are written into the payload."""

    def answer(payload):
        given = json.loads(payload)
        if given["fail"]:
            return 400, "bad"
        return 200, json.dumps({"choices": [{"finish_reason": "stop", "message": {"content": given["key"]}}], "usage": {"total_tokens": given["cost"]}})

    return answer


def _one_by_one(rows, limit, cached):
    cache, used, got = set(cached), 0, {}
    for r in sorted(rows, key=lambda r: (-r["priority"], r["seq"])):
        given = json.loads(r["payload"])
        if r["key"] in cache:
            got[r["seq"]] = "cached"
        elif 0 < limit <= used:
            got[r["seq"]] = "denied"
        elif given["fail"]:
            got[r["seq"]] = "failed"
        else:
            used += given["cost"]
            cache.add(r["key"])
            got[r["seq"]] = "called"
    return got


@pytest.mark.parametrize("seed, limit", [(1, 150), (2, 0), (3, 10_000)])
def test_waves_decide_like_one_by_one(spark, seed, limit):
    rng = random.Random(seed)
    kinds = {f"k{i}": {"key": f"k{i}", "cost": rng.randrange(1, 40), "fail": rng.random() < 0.2} for i in range(12)}
    rows = []
    for seq in range(30):
        key = rng.choice(list(kinds))
        rows.append({"key": key, "priority": rng.randrange(4), "seq": seq, "payload": json.dumps(kinds[key])})
    cached = spark.createDataFrame([("k3", "old", 5, "m"), ("k4", None, 5, "m")], "key string, content string, tokens_used long, model string")
    outcomes, cache = budget.run_reviews(spark.createDataFrame(rows), _service(), limit, cached, bound=F.lit(40), waits=())
    assert {r.seq: r.outcome for r in outcomes.collect()} == _one_by_one(rows, limit, {"k3"})
    assert {r.key for r in cache.collect()} >= {r.key for r in outcomes.where("outcome = 'called'").collect()}


def test_replay_overshoots_by_one_call(spark):
    rows = spark.createDataFrame([("a", 9, 0, 70), ("b", 5, 1, 70), ("a", 4, 2, 70), ("c", 3, 3, 1), ("c", 2, 4, 1)], "key string, priority long, seq long, tokens long")
    assert [r.outcome for r in budget.replay(rows, 100).orderBy("seq").collect()] == ["called", "called", "cached", "denied", "denied"]


def test_retry_stops_at_the_first_lasting_answer():
    codes = iter([429, 503, 200])
    assert send("x", lambda p: (next(codes), "b"), (0, 0))[:3] == (200, "b", 3)
    assert send("x", lambda p: (404, "b"), (0, 0))[:3] == (404, "b", 1)
    assert send("x", lambda p: (500, "b"), (0, 0))[:3] == (500, "b", 3)

    def down(payload):
        raise TimeoutError("slow")

    assert send("x", down, (0, 0)) == (None, None, 3, "TimeoutError: slow")


def test_transport_settings():
    with pytest.raises(ValueError):
        checked_transport({"provider": "other", "api_key": "k"}, {})
    with pytest.raises(ValueError):
        checked_transport({}, {})
    assert checked_transport({"endpoint": "http://x"}, {"OPENROUTER_API_KEY": "k"}).endpoint == "http://x"
