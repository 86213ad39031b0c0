"""Answers of a review service: transport outcome, content, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.json import extracted, kind, stripped, text_at

# HTTP codes worth another try.
RETRYABLE = (408, 429, 500, 502, 503, 504)
_ITEM = "struct<rule:string,principle:string,severity:string,message:string,explanation:string,suggestion:string,method_name:string,analyzed_with:array<string>>"


def http_class(status: Column) -> Column:
    """``retryable``, ``non_retryable`` or ``ok``; a missing status is a network failure and worth a retry."""
    return (
        F.when(status.isNull() | status.isin(*RETRYABLE), "retryable").when(status >= 400, "non_retryable").otherwise("ok")
    )


def completion(body: Column) -> Column:
    """``struct(content, tokens_used, model, error)`` of a chat-completion body.

    ``error`` is null for a usable answer. Nothing in a malformed body raises.
    """
    v = F.try_parse_json(body)
    get = lambda path, to="variant": F.try_variant_get(v, path, to)
    has = lambda path, k: F.coalesce(kind(get(path)) == k, F.lit(False))
    finish = F.when(has("$.choices[0].finish_reason", "STRING"), get("$.choices[0].finish_reason", "string"))
    no_finish = get("$.choices[0].finish_reason").isNull() | has("$.choices[0].finish_reason", "VOID")
    content = F.when(has("$.choices[0].message.content", "STRING"), get("$.choices[0].message.content", "string")).otherwise("")
    known_finish = F.coalesce(finish.isin("stop", "length"), F.lit(False))
    error = (
        F.when(v.isNull(), "invalid json")
        .when(F.coalesce(kind(v), F.lit("")) != "OBJECT", "not an object")
        .when(get("$.error").isNotNull(), F.concat(F.lit("api error: "), F.coalesce(get("$.error.message", "string"), F.lit("unknown"))))
        .when(~has("$.choices", "ARRAY"), "no choices")
        .when(get("$.choices[0]").isNull(), "empty choices")
        .when(~has("$.choices[0]", "OBJECT"), "invalid choice")
        .when(F.coalesce(finish == "content_filter", F.lit(False)), "content filtered")
        .when(F.coalesce(finish == "tool_calls", F.lit(False)), "unexpected tool calls")
        .when(~has("$.choices[0].message", "OBJECT"), "invalid message")
        .when(no_finish & (content == ""), "empty answer")
        .when(~no_finish & ~known_finish & (content == ""), "empty answer")
    )
    tokens = F.when(has("$.usage.total_tokens", "BIGINT"), get("$.usage.total_tokens", "bigint")).otherwise(0).cast("long")
    model = F.when(has("$.model", "STRING"), get("$.model", "string")).otherwise("unknown")
    return F.struct(content.alias("content"), tokens.alias("tokens_used"), model.alias("model"), error.alias("error"))


def _finding(item: Column, candidate_type: Column) -> Column:
    """One stated finding as a struct, or null where it cannot be used."""
    severity = F.lower(F.try_variant_get(item, "$.severity", "string"))
    stated = F.upper(F.try_variant_get(item, "$.principle", "string"))
    principle = F.when(stated.isin("OCP", "LSP"), stated).when(candidate_type == "ocp", "OCP").when(candidate_type == "lsp", "LSP")
    message = text_at(item, "$.message")
    listed = F.when(
        kind(F.try_variant_get(item, "$.analyzed_with", "variant")) == "ARRAY", F.try_variant_get(item, "$.analyzed_with", "array<variant>")
    )
    names = F.transform(F.filter(listed, lambda x: kind(x) == "STRING"), lambda x: stripped(F.try_variant_get(x, "$", "string")))
    names = F.filter(names, lambda x: x != "")
    usable = (F.coalesce(kind(item), F.lit("")) == "OBJECT") & message.isNotNull() & principle.isNotNull()
    return F.when(
        usable,
        F.struct(
            F.concat(principle, F.lit("-LLM-001")).alias("rule"), principle.alias("principle"),
            F.when(severity.isin("error", "warning", "info"), severity).otherwise("warning").alias("severity"), message.alias("message"),
            F.coalesce(text_at(item, "$.explanation"), text_at(item, "$.details")).alias("explanation"), text_at(item, "$.suggestion").alias("suggestion"),
            text_at(item, "$.method_name").alias("method_name"), F.when(F.size(names) > 0, names).alias("analyzed_with"),
        ),
    )


def parsed(answers: DataFrame) -> DataFrame:
    """Add ``findings``, ``status`` and ``warnings`` to rows with ``content`` and ``candidate_type``.

    Each item is judged on its own: all kept is a success, some a partial one,
    none of several a failure. An answer that is no object with a ``findings``
    list is a failure.
    """
    value = answers.withColumn("_v", extracted(F.col("content")))
    listed = F.when(
        (kind(F.col("_v")) == "OBJECT") & (kind(F.try_variant_get("_v", "$.findings", "variant")) == "ARRAY"),
        F.try_variant_get("_v", "$.findings", "array<variant>"),
    )
    rows = value.withColumn("_items", listed).withColumn(
        "findings", F.filter(F.transform("_items", lambda x: _finding(x, F.col("candidate_type"))), lambda x: x.isNotNull())
    )
    given, kept = F.size("_items"), F.size("findings")
    status = (
        F.when(F.col("_items").isNull(), "failure").when(given == kept, "success").when(kept > 0, "partial").otherwise("failure")
    )
    warned = F.col("_items").isNull() | ((given > 0) & (kept == 0))
    empty = F.array().cast(f"array<{_ITEM}>")
    return rows.withColumn("status", status).withColumn("warnings", warned.cast("long")).withColumn(
        "findings", F.coalesce(F.col("findings").cast(f"array<{_ITEM}>"), empty)
    ).drop("_v", "_items")


def stated_findings(answers: DataFrame) -> DataFrame:
    """One row per usable finding; file and class always come from the candidate, corroboration is always true."""
    # The outer form keeps the planner from pushing a copy of the whole parse below itself as a filter.
    rows = answers.select("file_path", "class_name", F.posexplode_outer("findings").alias("at", "f")).where("f is not null")
    return rows.select(
        F.col("file_path").alias("path"), "class_name", "at", "f.*", F.lit("llm").alias("source"), F.lit(True).alias("heuristic_corroboration")
    )


def review_summary(results: DataFrame) -> DataFrame:
    """Counts over ``(outcome, status, tokens_used, warnings)``; only real cache hits count as hits."""
    answered = F.col("outcome").isin("called", "cached")
    usable = answered & F.col("status").isin("success", "partial")
    return results.agg(
        F.count_if(usable).alias("candidates_processed"),
        F.count_if(~F.coalesce(usable, F.lit(False))).alias("candidates_skipped"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "called", F.col("tokens_used"))), F.lit(0)).alias("tokens_used"),
        F.count_if(F.col("outcome") == "cached").alias("cache_hits"),
        F.count_if(answered & (F.col("status") == "failure")).alias("parse_failures"),
        F.count_if(answered & (F.col("status") == "partial")).alias("parse_partials"),
        F.coalesce(F.sum(F.when(answered, F.col("warnings"))), F.lit(0)).alias("parse_warnings"),
    )
