import re

from codestrata.llm import url_filter as U

RULES = [U.Rule.of("allow", "org/"), U.Rule.of("block", "example.org/es/"), U.Rule.of("block", "example.org/en/1"), U.Rule.of("allow", "com/fr/"), U.Rule.of("block", "com/de/")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.partition("://")[2]).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def ruled(url):
    host, path = split(url)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1?x", "https://example.org/en/1", "https://example.org/en/2#a", "https://notexample.org/es/", "https://org", "https://x.com/fr/1", "https://x.com/de", "https://x.com/de/", "a://b://c/d", "https://ÄB.net/É?q=/de/", "https://é.org\n/x\ny?z", "https://x.net/" + "a/" * 20000, "https://x.com/fr/", "https://x.com/fr/"]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: r for r in U.judge(pages, RULES, [0.0] * (U.BUCKETS + 1)).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        rule = ruled(u)
        assert (got[k].host, got[k].path) == split(u)
        assert (got[k].rule, got[k].verdict) == ((rule.text, rule.verdict) if rule else (None, "allow"))
    assert U.judge(pages.limit(0), RULES, [0.0] * (U.BUCKETS + 1)).count() == 0


def test_held_out_accuracy_and_repeatable_weights(spark):
    rows = [(f"https://{w}{k}.example.net/{p}/{k}", b) for k in range(300) for w, p, b in (("casino", "win", True), ("news", "article", False))]
    rows += [(None, True), (rows[0][0], None)]
    table = spark.createDataFrame(rows, "url string, blocked boolean")
    weights = U.train(table.repartition(5))
    assert weights == U.train(table.repartition(2)) and len(weights) == U.BUCKETS + 1
    unseen = [(k, f"https://{w}{k}.other.net/{p}/{k}", v) for k in range(1000, 1100) for w, p, v in (("casino", "win", "block"), ("news", "article", "allow"))]
    got = U.judge(spark.createDataFrame(unseen, "page_id long, url string, want string"), [], weights).collect()
    want = {(r[0], "/" + r[1].split("/", 3)[3]): r[2] for r in unseen}
    assert sum(want[r.page_id, r.path] == r.verdict for r in got) >= 190
    assert U.train(table.where("blocked")) == [0.0] * (U.BUCKETS + 1)
