"""The production runs: each operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import decontaminate, line_dedup, near_vectors, ngram_join, pieces, prefix_trie, quality, sharding, substring_dedup, token_files, url_filter, warc, whitening
from codestrata.session import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents"))


@query("op5_sharding", sharding.oracle(40, ["lang", "source"]))
def shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), 40, ["lang", "source"])


RULES = [
    url_filter.Rule.of("allow", "org/"), url_filter.Rule.of("block", "example.org/es/"), url_filter.Rule.of("block", "example.org/en/1"),
    url_filter.Rule.of("allow", "com/fr/"), url_filter.Rule.of("block", "com/de/"),
]


@query("op8_url_filters")
def filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, RULES, url_filter.train(url_filter.labelled_by_rules(pages, RULES)))


NGRAM_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""


@query("op1_ngram_jaccard_join", NGRAM_SQL)
def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS pos, ws FROM w WHERE len(ws) >= 35),
v AS (SELECT doc_id, pos, sha256(array_to_string(ws[pos : pos + 34], ' ')) AS win FROM p),
r AS (SELECT win FROM v GROUP BY 1 HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS i FROM v JOIN r USING (win)),
g AS (SELECT doc_id, count(*) AS n, list(i) AS gone FROM c GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN g.n IS NULL THEN array_to_string(ws, ' ') WHEN g.n = len(ws) THEN ''
    ELSE array_to_string(list_transform(list_sort(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i))), lambda i: ws[i]), ' ') END) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""


@query("op6_substring_dedup", SUBSTRING_SQL)
def repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.cleaned(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, octet_length(encode(t)) AS n, sha1(t) AS h FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || h[5 * i // 4 + 1 : 5 * i // 4 + 2])::INT >> (3 - 5 * i % 4)::INT) & 31) + 1]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM m
"""


@query("op7_warc", WARC_SQL)
def archived_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        records = warc.with_originals(scratch, table(spark, sf_dir, "pages"), "page_id", "url", "html")
        packages = scratch.keep(warc.write_packages(records, scratch.path("packages")))
        read = warc.read_records(scratch.keep(warc.record_places(packages)), payloads=False)
        return scratch.result(read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"))


@query("op4_line_dedup")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


CONTAINED_SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
gi AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k : k + 4], ' ')) END) AS g FROM i),
gd AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k : k + 4], ' ')) END) AS g FROM d),
n AS (SELECT item_id, count(*) AS n FROM gi GROUP BY 1),
s AS (SELECT item_id, doc_id, count(*) AS s FROM gi JOIN gd USING (g) GROUP BY 1, 2)
SELECT item_id, doc_id, n::BIGINT AS n_item, s::BIGINT AS n_shared FROM s JOIN n USING (item_id) WHERE 100 * s >= 75 * n
"""


@query("op3_benchmark_decontamination", CONTAINED_SQL)
def contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_sentencepiece")
def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("given")), "given")
    back = pieces.decode(encoded)
    same = F.col("text").eqNullSafe(F.col("given"))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), same.alias("round_trip"))


@query("op2_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.counts(table(spark, sf_dir, "documents"))


@query("op11_embedding_whitening")
def whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors, "embedding", 8)
    if model is None:
        kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], kind)
    explained = F.array(*[F.lit(float(e)) for e in model.explained]).cast("array<double>")
    placed = whitening.whiten(vectors, model, "vec_id", "embedding").select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return placed.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), F.lit(whitening.identity_error(vectors, model, "embedding")).alias("identity_error"),
    )


TRIE_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS txt, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {sharding.crc_sql("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, i, role, txt FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND i <= h
  UNION ALL SELECT conv_id, 1, i, role, txt FROM c JOIN t USING (conv_id) WHERE i > h),
s AS (SELECT conv_id, row_number() OVER w AS d, length(txt) AS len,
  sha256(array_to_string(list(sha256(length(role) || ':' || role || txt)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ',')) AS k FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)),
m AS (SELECT conv_id, d, len, k FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY d) AS up, d = max(d) OVER (PARTITION BY conv_id) AS last FROM m),
n AS (SELECT k, any_value(up) AS up, any_value(d) AS d, any_value(len) AS len, min(conv_id) AS conv_id, count(*) AS n,
  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends FROM l GROUP BY k),
x AS (SELECT n.*, (SELECT count(*) FROM n AS y WHERE y.up = n.k) AS kids FROM n),
b AS (SELECT DISTINCT p.k AS top, q.k AS k FROM m p JOIN m q ON q.conv_id = p.conv_id AND q.d >= p.d),
z AS (SELECT b.top, sum((x.kids = 0)::INT) AS leaves, sum((x.n - 1) * x.len) AS saved FROM b JOIN x USING (k) GROUP BY 1)
SELECT x.conv_id, x.d::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n::BIGINT AS n_convs, x.kids::BIGINT AS n_children, z.leaves::BIGINT AS n_leaves,
  z.saved::BIGINT AS saved_tokens, sha256(x.ends) AS ends_sha256 FROM x JOIN z ON z.top = x.k LEFT JOIN x p ON p.k = x.up
"""


@query("op12_conversation_trie", TRIE_SQL)
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        rebuilt = scratch.keep(prefix_trie.grafted(scratch.keep(prefix_trie.paths(table(spark, sf_dir, "conversations")))))
        return scratch.result(prefix_trie.trie(scratch, rebuilt))


NEAR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


@query("op13_embedding_near_dedup", NEAR_SQL)
def near_vectors_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.components(table(spark, sf_dir, "embeddings"))
