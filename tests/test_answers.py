import hashlib
import json

import pytest
from pyspark.sql import functions as F

from codestrata.functions.json import extracted, kind, quoted
from codestrata.operators import answers, requests


def test_strings_are_quoted_like_python(spark):
    texts = ['plain', 'q"uote\\', "tab\t nl\n cr\r bs\b ff\f", "bell\x07 esc\x1b unit\x1f", "žluť 日本 \u2028 / \x7f", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", quoted(F.col("t")).alias("q")).collect():
        assert row.q == json.dumps(row.t, ensure_ascii=False)


def test_cache_key_and_payload_match_python(spark):
    options = requests.Options(model="m/1", response_format="json_object")
    df = spark.createDataFrame([("sys \"x\"", "user\n\x1b ž")], "system_text string, user_text string")
    row = df.select(requests.cache_key(options).alias("k"), requests.payload(options).alias("p")).first()
    messages = [{"role": "system", "content": "sys \"x\""}, {"role": "user", "content": "user\n\x1b ž"}]
    whole = {"messages": messages, "options": {"model": "m/1", "temperature": 0.2, "max_tokens": 4096, "response_format": "json_object"}}
    assert row.k == hashlib.sha256(json.dumps(whole, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    assert json.loads(row.p) == {"model": "m/1", "messages": messages, "temperature": 0.2, "max_tokens": 4096, "response_format": {"type": "json_object"}}


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"a": 1}', "OBJECT"), ("  [1]\n", "ARRAY"), ("text ```json\n{\"a\": 1}\n``` more", "OBJECT"), ("```\n[1]\n```", "ARRAY"), ('so {"a": {"b": 2}} it is', "OBJECT"),
        ("{broken", None), ("} {", None), ("", None), ("nothing", None), ('"s"', "STRING"), ("null", "VOID"),
    ],
)
def test_extraction(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(kind(extracted(F.col("t")))).first()[0] == want


GOOD = {"message": " m ", "severity": "ERROR", "principle": "lsp", "details": "d", "suggestion": " ", "method_name": "f", "analyzed_with": ["a ", 1, ""]}


@pytest.mark.parametrize(
    "content, kind_of, status, kept, warnings",
    [
        ({"findings": []}, "ocp", "success", 0, 0),
        ({"findings": [GOOD]}, "both", "success", 1, 0),
        ({"findings": [GOOD, 3]}, "both", "partial", 1, 0),
        ({"findings": [{"message": "x"}]}, "ocp", "success", 1, 0),
        ({"findings": [{"message": "x"}]}, "both", "failure", 0, 1),
        ({"findings": [{"message": 5, "principle": "OCP"}]}, "ocp", "failure", 0, 1),
        ({"findings": {"OCP": []}}, "ocp", "failure", 0, 1),
        ({"other": 1}, "ocp", "failure", 0, 1),
        ({}, "ocp", "failure", 0, 1),
        ([1, 2], "ocp", "failure", 0, 1),
    ],
)
def test_parsing(spark, content, kind_of, status, kept, warnings):
    row = answers.parsed(spark.createDataFrame([(json.dumps(content), kind_of)], "content string, candidate_type string")).first()
    assert (row.status, len(row.findings), row.warnings) == (status, kept, warnings)


def test_finding_fields(spark):
    df = spark.createDataFrame([(json.dumps({"findings": [GOOD, {"message": "n", "severity": "odd"}]}), "ocp", "p.py", "C")], "content string, candidate_type string, file_path string, class_name string")
    first, second = answers.stated_findings(answers.parsed(df)).orderBy("at").collect()
    assert (first.rule, first.severity, first.message, first.explanation, first.suggestion, first.method_name, first.analyzed_with) == ("LSP-LLM-001", "error", "m", "d", None, "f", ["a"])
    assert (second.rule, second.severity, second.explanation, second.analyzed_with, second.heuristic_corroboration) == ("OCP-LLM-001", "warning", None, None, True)


def _body(finish="stop", content="x", **more):
    return {"choices": [{"finish_reason": finish, "message": {"content": content}}], **more}


@pytest.mark.parametrize(
    "body, content, tokens, error",
    [
        (_body(usage={"total_tokens": 7}, model="m"), "x", 7, None), (_body("length", ""), "", 0, None), (_body("stop", ""), "", 0, None), (_body("stop", None), "", 0, None),
        (_body(None), "x", 0, None), (_body(None, ""), "", 0, "empty answer"), (_body("odd"), "x", 0, None), (_body("odd", ""), "", 0, "empty answer"),
        (_body("content_filter"), "x", 0, "content filtered"), (_body("tool_calls"), "x", 0, "unexpected tool calls"), ({"choices": []}, "", 0, "empty choices"),
        ({"choices": {}}, "", 0, "no choices"), ({}, "", 0, "no choices"), ({"choices": [1]}, "", 0, "invalid choice"), ({"choices": [{"message": "x"}]}, "", 0, "invalid message"),
        ({"error": {"message": "no"}}, "", 0, "api error: no"), ({"error": "no"}, "", 0, "api error: unknown"), ([1], "", 0, "not an object"),
        (_body(usage={"total_tokens": "7"}), "x", 0, None), (_body(usage=None), "x", 0, None),
    ],
)
def test_completion(spark, body, content, tokens, error):
    row = spark.createDataFrame([(json.dumps(body),)], "b string").select(answers.completion(F.col("b")).alias("c")).first().c
    assert (row.content, row.tokens_used, row.error) == (content, tokens, error)


def test_broken_body(spark):
    assert spark.createDataFrame([("<html>",)], "b string").select(answers.completion(F.col("b")).alias("c")).first().c.error == "invalid json"


def test_http_classes(spark):
    codes = {200: "ok", 408: "retryable", 429: "retryable", 503: "retryable", 400: "non_retryable", 404: "non_retryable", 418: "non_retryable", 501: "non_retryable", None: "retryable"}
    df = spark.createDataFrame([(c,) for c in codes], "c int")
    assert {r.c: r.k for r in df.select("c", answers.http_class(F.col("c")).alias("k")).collect()} == codes


def test_prompt_puts_text_in_once(spark, tmp_path):
    (tmp_path / "user_base.md").write_text("{class_name} {source_code} {{x}}")
    (tmp_path / "user_lsp_section.md").write_text(" lsp \n")
    (tmp_path / "response_schema.json").write_text('{"instruction": " obey "}')
    prompts = requests.Prompts.read(str(tmp_path))
    row = {"class_name": "C", "file_path": "p", "source_code": "{class_name}{findings}", "findings": "F"}
    df = spark.createDataFrame([{**row, "candidate_type": t} for t in ("ocp", "lsp")])
    got = {r.candidate_type: r.user_text for r in requests.with_prompt(df, prompts).collect()}
    assert got == {"ocp": "C {class_name}{findings} {x}\n\nobey", "lsp": "C {class_name}{findings} {x}\n\nlsp\n\nobey"}


def test_unknown_field_falls_back(spark):
    df = spark.createDataFrame([{"class_name": "C", "file_path": "p", "source_code": "s", "findings": "F", "candidate_type": "ocp"}])
    text = requests.with_prompt(df, requests.Prompts(user="{nope}")).first().user_text
    assert text.startswith("C is defined in p:") and "\n\ns\n\n" in text and "F" in text
