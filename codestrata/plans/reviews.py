"""Queries over review requests and answers: documents are candidates, events are answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.json import extracted, kind
from codestrata.operators import answers, budget, heuristics, requests
from codestrata.plans.registry import part, query
from codestrata.plans.tables import Facts
from codestrata.sources import tool_reports
from codestrata.sources.provider import echo_transport
from codestrata.sources.sinks import as_json

LIMIT = 1_000_000
PROMPTS = requests.Prompts(
    "system", "{class_name}|{file_path}|{candidate_type}\n{source_code}\n{findings}{{}}", "ocp part", "lsp part", "instruction"
)


def candidates(f: Facts) -> DataFrame:
    """Documents with a priority from their labels and their text as the source under review."""
    rated = f.table("documents").join(f.table("labels"), "doc_id", "left")
    lang = F.col("lang")
    return rated.select(
        "doc_id", F.concat(F.lit("D"), F.col("doc_id")).alias("class_name"), F.col("source").alias("file_path"), F.col("text").alias("source_code"),
        F.when(lang == "en", "ocp").when(lang == "fr", "lsp").otherwise("both").alias("candidate_type"),
        (F.coalesce("quality", F.lit(0)) * 2 + F.coalesce("toxic", F.lit(0))).cast("long").alias("priority"),
        F.col("doc_id").alias("seq"), F.col("n_chars").alias("tokens"),
    )


part("rq", """SELECT d.doc_id, d.text, d.source, d.lang, d.n_chars, sha256(d.text) AS key, (coalesce(quality, 0) * 2 + coalesce(toxic, 0))::BIGINT AS priority
  FROM documents d LEFT JOIN labels l USING (doc_id)""")
part("rf", "SELECT *, row_number() OVER (PARTITION BY key ORDER BY priority DESC, doc_id) = 1 AS first FROM rq")
part("rb", f"""SELECT *, coalesce(sum(n_chars) OVER (ORDER BY priority DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {LIMIT} AS go FROM rf WHERE first""")
part("ro", """SELECT f.doc_id, CASE WHEN NOT b.go THEN 'denied' WHEN f.first THEN 'called' ELSE 'cached' END AS outcome, f.n_chars FROM rf f JOIN rb b USING (key)""")


@query("q_budget_gate", "SELECT doc_id, outcome FROM ro")
def _(f):
    rows = candidates(f).withColumn("key", F.sha2("source_code", 256))
    return budget.replay(rows, LIMIT).select("doc_id", "outcome")


@query("q_budget_unlimited", "SELECT doc_id, CASE WHEN first THEN 'called' ELSE 'cached' END AS outcome FROM rf")
def _(f):
    return budget.replay(candidates(f).withColumn("key", F.sha2("source_code", 256)), 0).select("doc_id", "outcome")


@query("q_cache_hits", """SELECT doc_id, key IN (SELECT key FROM rq WHERE source IN ('src0', 'src1', 'src2') AND lang <> 'de') AS is_cache_hit FROM rq""")
def _(f):
    rows = candidates(f).withColumn("key", F.sha2("source_code", 256))
    cache = rows.where(F.col("file_path").isin("src0", "src1", "src2")).join(f.table("documents").select("doc_id", "lang"), "doc_id").select(
        "key", F.when(F.col("lang") != "de", F.lit("{}")).alias("content"), "tokens", F.lit("m").alias("model")
    ).withColumnRenamed("tokens", "tokens_used")
    return budget.split_cached(rows, cache).select("doc_id", "is_cache_hit")


def prompted(f: Facts) -> DataFrame:
    """Candidates with a finding for each labelled document, and the prompt built from both."""
    found = f.table("labels").select(
        F.concat(F.lit("D"), F.col("doc_id")).alias("class_name"), F.lit("OCP").alias("principle"), F.concat(F.lit("quality "), F.col("quality")).alias("message"),
        F.lit("R1").alias("rule"), F.struct(F.lit(0).alias("rule"), F.lit(0).alias("meth")).alias("emit"),
    )
    toxic = f.table("labels").where("toxic = 1").select(
        F.concat(F.lit("D"), F.col("doc_id")).alias("class_name"), F.lit("LSP").alias("principle"), F.lit("toxic").alias("message"),
        F.lit("R2").alias("rule"), F.struct(F.lit(1).alias("rule"), F.lit(0).alias("meth")).alias("emit"),
    )
    return requests.with_prompt(requests.findings_text(candidates(f), found.unionByName(toxic)), PROMPTS)


_TYPE_SQL = "CASE WHEN lang = 'en' THEN 'ocp' WHEN lang = 'fr' THEN 'lsp' ELSE 'both' END"
part("ft", """SELECT r.*, CASE WHEN l.doc_id IS NULL THEN 'No static heuristic signals found for this class.' ELSE '- [OCP] quality ' || l.quality || ' (rule: R1)' ||
  CASE WHEN l.toxic = 1 THEN chr(10) || '- [LSP] toxic (rule: R2)' ELSE '' END END AS findings FROM rq r LEFT JOIN labels l USING (doc_id)""")
part("pr", f"""SELECT *, 'D' || doc_id || '|' || source || '|' || {_TYPE_SQL} || chr(10) || text || chr(10) || findings || '{{}}' ||
  CASE WHEN {_TYPE_SQL} IN ('ocp', 'both') THEN chr(10) || chr(10) || 'ocp part' ELSE '' END || CASE WHEN {_TYPE_SQL} IN ('lsp', 'both') THEN chr(10) || chr(10) || 'lsp part' ELSE '' END
  || chr(10) || chr(10) || 'instruction' AS user_text FROM ft""")


@query("q_findings_text", "SELECT doc_id, findings FROM ft")
def _(f):
    return prompted(f).select("doc_id", "findings")


@query("q_prompt_build", "SELECT doc_id, sha256(user_text) AS digest, length(user_text) AS chars FROM pr")
def _(f):
    return prompted(f).select("doc_id", F.sha2("user_text", 256).alias("digest"), F.length("user_text").cast("long").alias("chars"))


@query("q_cache_key", """SELECT doc_id, sha256('{"messages": [{"content": "system", "role": "system"}, {"content": ' || to_json(user_text)::VARCHAR ||
  ', "role": "user"}], "options": {"max_tokens": 4096, "model": "openai/gpt-4o-mini", "response_format": null, "temperature": 0.2}}') AS key FROM pr""")
def _(f):
    return prompted(f).select("doc_id", requests.cache_key(requests.Options()).alias("key"))


@query("q_payload_build", """SELECT doc_id, sha256('{"model": "m", "messages": [{"role": "system", "content": "system"}, {"role": "user", "content": ' || to_json(user_text)::VARCHAR ||
  '}], "temperature": 0.2, "max_tokens": 4096, "response_format": {"type": "json_object"}}') AS digest FROM pr""")
def _(f):
    options = requests.Options(model="m", response_format="json_object")
    return prompted(f).select("doc_id", F.sha2(requests.payload(options), 256).alias("digest"))


def reviewed(f: Facts) -> DataFrame:
    """All documents sent through the stand-in service under the budget."""
    rows = candidates(f).withColumn("system_text", F.lit("s")).withColumnRenamed("source_code", "user_text")
    rows = rows.withColumn("key", requests.cache_key(requests.Options())).withColumn("payload", requests.payload(requests.Options()))
    outcomes, _ = budget.run_reviews(rows.select("key", "priority", "seq", "payload", "tokens"), echo_transport, LIMIT, bound=F.col("tokens"), waits=())
    return outcomes


@query("q_review_outcomes", "SELECT doc_id, outcome FROM ro")
def _(f):
    return reviewed(f).select(F.col("seq").alias("doc_id"), "outcome")


@query("q_review_summary", """SELECT count(*) FILTER (outcome <> 'denied') AS candidates_processed, count(*) FILTER (outcome = 'denied') AS candidates_skipped,
  coalesce(sum(n_chars) FILTER (outcome = 'called'), 0)::BIGINT AS tokens_used, count(*) FILTER (outcome = 'cached') AS cache_hits, 0::BIGINT AS parse_failures, 0::BIGINT AS parse_partials,
  0::BIGINT AS parse_warnings FROM ro""")
def _(f):
    return answers.review_summary(answers.parsed(reviewed(f).withColumn("candidate_type", F.lit("ocp"))))


# ---------------------------------------------------------------------- answers


@query("q_json_extract", """SELECT event_id, CASE WHEN event_type = 'signup' THEN NULL ELSE json_extract(props, '$.k')::BIGINT END AS k,
  CASE event_type WHEN 'signup' THEN NULL WHEN 'error' THEN 'ARRAY' ELSE 'OBJECT' END AS shape FROM events""")
def _(f):
    p, kind_of = F.col("props"), F.col("event_type")
    text = (
        F.when(kind_of == "view", F.concat(F.lit(" \n"), p, F.lit("\t"))).when(kind_of == "click", F.concat(F.lit("Sure:\n```json\n"), p, F.lit("\n```\nDone {x")))
        .when(kind_of == "purchase", F.concat(F.lit("The answer is "), p, F.lit(" as asked."))).when(kind_of == "error", F.concat(F.lit("["), p, F.lit("]")))
        .otherwise(F.concat(F.lit("{"), p))
    )
    v = extracted(text)
    number = F.coalesce(F.try_variant_get(v, "$.k", "bigint"), F.try_variant_get(v, "$[0].k", "bigint"))
    return f.table("events").select("event_id", number.alias("k"), kind(v).alias("shape"))


def answered(f: Facts) -> DataFrame:
    """Answers of five shapes: none, two good findings, one good of two, one bad, no JSON at all."""
    item = F.concat(F.lit('{"message": " m'), F.col("event_id"), F.lit(' ", "severity": "ERROR", "details": "d"}'))
    blank = F.lit('{"message": "  ", "principle": "OCP"}')
    stated = F.lit('{"message": "x", "principle": "lsp", "severity": "odd", "explanation": "e", "details": "d", "analyzed_with": ["a", 1, " "]}')
    kind_of = F.col("event_type")
    body = (
        F.when(kind_of == "view", "").when(kind_of == "click", F.concat(item, F.lit(", "), stated))
        .when(kind_of == "purchase", F.concat(stated, F.lit(", "), blank)).when(kind_of == "error", blank)
    )
    content = F.when(kind_of == "signup", "no findings here").otherwise(F.concat(F.lit('{"findings": ['), body, F.lit("]}")))
    return answers.parsed(
        f.table("events").select(
            "event_id", content.alias("content"), F.when(F.col("value") < 5, "ocp").otherwise("both").alias("candidate_type"),
            F.concat(F.lit("u"), F.col("user_id")).alias("class_name"), F.lit("p").alias("file_path"),
        )
    )


@query("q_parse_status", """SELECT event_id, CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN CASE WHEN value < 5 THEN 'success' ELSE 'partial' END WHEN 'purchase' THEN 'partial' ELSE 'failure' END AS status,
  CASE event_type WHEN 'click' THEN CASE WHEN value < 5 THEN 2 ELSE 1 END WHEN 'purchase' THEN 1 ELSE 0 END AS kept, CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 0 END::BIGINT AS warnings FROM events""")
def _(f):
    return answered(f).select("event_id", "status", F.size("findings").alias("kept"), "warnings")


@query("q_validate_items", """SELECT event_id, 'u' || user_id AS class_name, 'OCP-LLM-001' AS rule, 'error' AS severity, 'm' || event_id AS message, 'd' AS explanation, NULL::VARCHAR AS analyzed_with FROM events WHERE event_type = 'click' AND value < 5
  UNION ALL SELECT event_id, 'u' || user_id, 'LSP-LLM-001', 'warning', 'x', 'e', 'a' FROM events WHERE event_type IN ('click', 'purchase')""")
def _(f):
    rows = answered(f).select("event_id", "class_name", F.explode_outer("findings").alias("f")).where("f is not null")
    return rows.select("event_id", "class_name", "f.rule", "f.severity", "f.message", "f.explanation", F.array_join("f.analyzed_with", ",").alias("analyzed_with"))


@query("q_http_class", """SELECT event_id, CASE WHEN event_type = 'view' THEN 'ok' WHEN c IN (408, 429, 500, 502, 503, 504) THEN 'retryable' ELSE 'non_retryable' END AS outcome
  FROM (SELECT *, CASE WHEN event_type = 'error' THEN 500 ELSE 400 END + json_extract(props, '$.k')::INT AS c FROM events)""")
def _(f):
    k = F.get_json_object("props", "$.k").cast("int")
    code = F.when(F.col("event_type") == "view", 200).when(F.col("event_type") == "error", k + 500).otherwise(k + 400)
    return f.table("events").select("event_id", answers.http_class(code).alias("outcome"))


@query("q_completion", """SELECT event_id, CASE event_type WHEN 'click' THEN 't' || event_id WHEN 'purchase' THEN 'partial' ELSE '' END AS content,
  CASE event_type WHEN 'click' THEN json_extract(props, '$.k')::BIGINT ELSE 0 END AS tokens_used, CASE event_type WHEN 'click' THEN 'm' ELSE 'unknown' END AS model,
  CASE event_type WHEN 'view' THEN 'no choices' WHEN 'error' THEN 'api error: e' || user_id WHEN 'signup' THEN 'content filtered' END AS error FROM events""")
def _(f):
    e, kind_of = F.col("event_id"), F.col("event_type")
    body = (
        F.when(kind_of == "click", F.concat(F.lit('{"choices": [{"finish_reason": "stop", "message": {"content": "t'), e, F.lit('"}}], "usage": {"total_tokens": '), F.get_json_object("props", "$.k"), F.lit('}, "model": "m"}')))
        .when(kind_of == "purchase", F.lit('{"choices": [{"finish_reason": "length", "message": {"content": "partial"}}], "usage": {"total_tokens": "7"}, "model": 3}'))
        .when(kind_of == "error", F.concat(F.lit('{"error": {"message": "e'), F.col("user_id"), F.lit('"}}')))
        .when(kind_of == "signup", F.lit('{"choices": [{"finish_reason": "content_filter", "message": {"content": ""}}]}'))
        .otherwise(F.lit('{"choices": {}}'))
    )
    return f.table("events").select("event_id", answers.completion(body).alias("c")).select("event_id", "c.*")


# ------------------------------------------------------------ tool JSON, merges


@query("q_src_complexity", """SELECT 'f' || o_orderkey || '.py' AS filepath, 'g' || o_orderkey AS name, 'function' AS type, o_custkey AS complexity, 'A' AS rank, o_orderkey AS lineno FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT 'f' || o_orderkey || '.py', 'm', 'method', 3, 'B', 0 FROM orders WHERE o_orderstatus = 'O'""")
def _(f):
    o = F.col("o_orderkey")
    blocks = F.concat(
        F.lit('[{"name": "g'), o, F.lit('", "type": "function", "complexity": '), F.col("o_custkey"), F.lit(', "rank": "A", "lineno": '), o,
        F.lit('}, {"name": "m", "type": "method", "complexity": 3, "rank": "B"}, {"name": "C", "type": "class", "complexity": 9, "rank": "C", "lineno": 1}]'),
    )
    value = F.when(F.col("o_orderstatus") == "O", blocks).otherwise(F.lit('"SyntaxError: bad input"'))
    return tool_reports.complexity_blocks(f.table("orders").select(F.concat(F.lit('{"f'), o, F.lit('.py": '), value, F.lit("}")).alias("json")))


@query("q_src_maintainability", """SELECT 'f' || c_custkey || '.py' AS filepath, c_nationkey::DOUBLE + 0.25 AS mi, 'B' AS rank FROM customer WHERE c_acctbal >= 0""")
def _(f):
    c = F.col("c_custkey")
    value = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit('{"mi": '), F.col("c_nationkey"), F.lit('.251, "rank": "B"}'))).otherwise(F.lit('"unreadable"'))
    return tool_reports.maintainability_files(f.table("customer").select(F.concat(F.lit('{"f'), c, F.lit('.py": '), value, F.lit("}")).alias("json")))


@query("q_src_parameters", """SELECT 'f' || o_orderkey || '.py' AS filepath, o_custkey AS lineno, 2::BIGINT AS parameter_count, 0 AS seq FROM orders UNION ALL SELECT 'f' || o_orderkey || '.py', o_orderkey, 5, 1 FROM orders""")
def _(f):
    o = F.col("o_orderkey")
    text = F.concat(F.lit('{"filename": "f'), o, F.lit('.py", "function_list": [{"start_line": '), F.col("o_custkey"), F.lit(', "parameter_count": 2}, {"start_line": '), o, F.lit(', "parameter_count": 5}]}'))
    return tool_reports.parameter_counts(f.table("orders").select(text.alias("json")))


@query("q_source_status", """SELECT 's' || event_id AS source, event_type IN ('view', 'purchase') AS ok, CASE WHEN event_type = 'error' THEN 'e' || user_id END AS error FROM events""")
def _(f):
    kind_of = F.col("event_type")
    text = (
        F.when(kind_of == "view", F.col("props")).when(kind_of == "purchase", '{"is_success": false}').when(kind_of == "click", "[1]")
        .when(kind_of == "error", F.concat(F.lit('{"error": "e'), F.col("user_id"), F.lit('"}'))).otherwise("broken {")
    )
    return tool_reports.source_status(f.table("events").select(F.concat(F.lit("s"), F.col("event_id")).alias("source"), text.alias("json")))


@query("q_candidate_dedup", """SELECT 'c' || o_custkey AS path, 'K' AS class_name, max(CAST(floor(o_totalprice / 1000.0::DOUBLE) AS BIGINT)) AS priority,
  CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'both' ELSE min(o_orderstatus) END AS candidate_type, CASE WHEN count(*) > 1 THEN string_agg(DISTINCT substr(o_orderpriority, 1, 1), ',' ORDER BY substr(o_orderpriority, 1, 1))
  ELSE min(substr(o_orderpriority, 1, 1)) END AS reasons FROM orders GROUP BY o_custkey""")
def _(f):
    rows = f.table("orders").select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("path"), F.lit("K").alias("class_name"), F.col("o_orderstatus").alias("candidate_type"),
        F.array(F.substring("o_orderpriority", 1, 1)).alias("reasons"), F.floor(F.col("o_totalprice") / 1000.0).alias("priority"),
    )
    return heuristics.merge_candidates(rows).select("path", "class_name", "priority", "candidate_type", F.array_join("reasons", ",").alias("reasons"))


@query("q_candidate_type", """SELECT doc_id, CASE WHEN o AND l THEN 'both' WHEN l THEN 'lsp' WHEN o THEN 'ocp' WHEN h THEN 'both' ELSE 'ocp' END AS candidate_type, (2 * q + t + 1)::BIGINT AS priority FROM
  (SELECT doc_id, coalesce(quality, 0) = 1 AS o, coalesce(toxic, 0) = 1 AS l, lang = 'en' AS h, coalesce(quality, 0) AS q, coalesce(toxic, 0) AS t FROM documents LEFT JOIN labels USING (doc_id))""")
def _(f):
    rows = f.table("documents").join(f.table("labels"), "doc_id", "left").na.fill(0, ["quality", "toxic"])
    kind_of = heuristics.candidate_type(F.col("quality") == 1, F.col("toxic") == 1, F.col("lang") == "en")
    return rows.select("doc_id", kind_of.alias("candidate_type"), heuristics.candidate_priority(F.col("quality"), F.col("toxic"), F.lit(1)).alias("priority"))


@query("q_json_report", """SELECT c_custkey, '{"filepath":"' || 'c' || c_custkey || '","mi_rank":' || CASE WHEN c_acctbal < 0 THEN 'null' ELSE '"A"' END || ',"lines":' || c_nationkey || '}' AS json FROM customer""")
def _(f):
    rows = f.table("customer").select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("filepath"), F.when(F.col("c_acctbal") >= 0, "A").alias("mi_rank"), F.col("c_nationkey").alias("lines")
    )
    return as_json(rows).select(F.regexp_extract("json", r'"c(\d+)"', 1).cast("long").alias("c_custkey"), "json")
