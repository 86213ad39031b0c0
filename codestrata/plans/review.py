"""Candidates to reviewed findings."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.config import ProjectConfig
from codestrata.operators import answers, budget, requests
from codestrata.operators.ordered import numbered
from codestrata.sources.provider import Transport, checked_transport

# Settings a configuration may leave out.
DEFAULT_LIMIT = 1000
DEFAULT_CACHE = ".review-cache"
DEFAULT_PROMPTS = "prompts"
CACHE_SCHEMA = "key string, content string, tokens_used bigint, model string"


def review_settings(config: ProjectConfig, config_path: str) -> dict:
    """The configuration's review section with defaults filled in and paths relative to its file resolved."""
    given, base = config.enrichment, Path(config_path).resolve().parent

    def place(value: str) -> str:
        if not isinstance(value, str) or not value.strip():
            raise ValueError("a path in the configuration must be non-empty text")
        return str((base / value).resolve())

    return {
        **given,
        "model": given.get("model", requests.Options.model),
        "limit": int(given.get("max_tokens_per_run", DEFAULT_LIMIT)),
        "cache_dir": place(given.get("cache_dir", DEFAULT_CACHE)),
        "prompts_dir": place(given.get("prompts_dir", DEFAULT_PROMPTS)),
    }


def read_cache(df: DataFrame, folder: str) -> DataFrame | None:
    """Cached answers, or None for a cache that does not exist yet."""
    spark = df.sparkSession
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(folder)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise  # an unreadable cache would be paid for a second time
        return None


def store_answers(answers_found: DataFrame, known: DataFrame | None, folder: str) -> None:
    """Append answers whose key the cache does not hold yet."""
    fresh = answers_found.select("key", "content", "tokens_used", "model").dropDuplicates(["key"])
    if known is not None:
        fresh = fresh.join(known.select("key"), "key", "left_anti")
    fresh.write.mode("append").parquet(folder)


def review(
    candidates: DataFrame, sources: DataFrame, findings: DataFrame, settings: dict, transport: Transport | None = None, waits: tuple[float, ...] = (2.0, 5.0)
) -> dict[str, DataFrame]:
    """Review candidates by priority under the token budget.

    ``sources(path, cls, text)`` holds the class texts, ``findings`` the rule
    findings that go into the prompts. Returns the stated findings, one row of
    totals and the outcome of every candidate.
    """
    sender = transport or checked_transport(settings, dict(os.environ))
    options = requests.Options(model=settings["model"])
    listed = numbered(candidates.select("path", "cls", "class_name", "candidate_type", "priority", "place"), ["place"])
    placed = listed.join(sources, ["path", "cls"]).withColumnsRenamed({"path": "file_path", "text": "source_code"})
    prompted = requests.with_prompt(requests.findings_text(placed, findings), requests.Prompts.read(settings["prompts_dir"]))
    rows = prompted.withColumn("key", requests.cache_key(options)).withColumn("payload", requests.payload(options))
    known = read_cache(rows, settings["cache_dir"])
    outcomes, answered = budget.run_reviews(rows.select("key", "priority", "seq", "payload"), sender, settings["limit"], known, waits=waits)
    if answered is not None:
        store_answers(answered, known, settings["cache_dir"])
    about = rows.select("seq", "file_path", "class_name", "candidate_type")
    judged = answers.parsed(outcomes.join(about, "seq"))
    return {
        "review_findings": answers.stated_findings(judged.where(F.col("outcome").isin("called", "cached"))),
        "review_summary": answers.review_summary(judged),
        "review_outcomes": judged.select("file_path", "class_name", "priority", "outcome", "status", "error"),
    }


def review_status(config: ProjectConfig, candidates: DataFrame | None) -> tuple[str, str | None]:
    """Whether a review should run: ``ready``, or ``disabled`` / ``skipped`` with the reason."""
    if not config.enrichment.get("enabled", False):
        return "disabled", None
    if candidates is None:
        return "skipped", "the class rules gave no candidates table"
    if candidates.isEmpty():
        return "skipped", "no class needs a review"
    return "ready", None
