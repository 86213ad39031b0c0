"""Review requests: prompt text, request payload and cache key."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.json import quoted

# Fixed value: stands in for the findings of a class without any.
NO_FINDINGS = "No static heuristic signals found for this class."


@dataclass(frozen=True)
class Options:
    model: str = "openai/gpt-4o-mini"
    temperature: float = 0.2
    max_tokens: int = 4096
    response_format: str | None = None


@dataclass(frozen=True)
class Prompts:
    """Prompt texts. Each has a plain stand-in, so a missing file never stops a run."""

    system: str = "You review Python classes for open/closed and substitution problems."
    user: str = "{class_name} is defined in {file_path}:\n\n{source_code}\n\nWhat static rules say of it:\n{findings}\n\nName what speaks for and against a {candidate_type} problem."
    ocp: str = ""
    lsp: str = ""
    instruction: str = ""

    @classmethod
    def read(cls, folder: str) -> Prompts:
        given = {}
        for name, file in (("system", "system.md"), ("user", "user_base.md"), ("ocp", "user_ocp_section.md"), ("lsp", "user_lsp_section.md")):
            path = Path(folder) / file
            if path.is_file():
                given[name] = path.read_text(encoding="utf-8")
        schema = Path(folder) / "response_schema.json"
        try:
            text = json.loads(schema.read_text(encoding="utf-8")).get("instruction")
        except (OSError, ValueError):
            text = None
        if isinstance(text, str):
            given["instruction"] = text.strip()
        return cls(**given)


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template's text with its fields replaced once; text put in is never read as a field."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if name not in values:
                return filled(Prompts.user, values)
            parts.append(F.coalesce(values[name], F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def findings_text(candidates: DataFrame, findings: DataFrame) -> DataFrame:
    """Add ``findings``: one line per finding of the class, by name alone, in emission order.

    The project map holds one class per name, so a name's lines are those of one class.
    """
    line = F.concat(F.lit("- ["), F.coalesce("principle", F.lit("?")), F.lit("] "), "message", F.lit(" (rule: "), "rule", F.lit(")"))
    lines = findings.groupBy("class_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("emit", line.alias("line")))), lambda x: x["line"]), "\n").alias("findings")
    )
    return candidates.join(lines, "class_name", "left").withColumn("findings", F.coalesce("findings", F.lit(NO_FINDINGS)))


def with_prompt(candidates: DataFrame, prompts: Prompts) -> DataFrame:
    """Add ``system_text`` and ``user_text``; the type decides which sections follow the base text."""
    names = ("candidate_type", "class_name", "file_path", "source_code", "findings")
    kind = F.col("candidate_type")
    parts = [filled(prompts.user, {n: F.col(n) for n in names})]
    for section, types in ((prompts.ocp, ("ocp", "both")), (prompts.lsp, ("lsp", "both"))):
        if section:
            parts.append(F.when(kind.isin(*types), F.lit("\n\n" + section.strip())).otherwise(""))
    if prompts.instruction:
        parts.append(F.lit("\n\n" + prompts.instruction))
    return candidates.withColumn("system_text", F.lit(prompts.system)).withColumn("user_text", F.concat(*parts))


def _messages(order: tuple[str, str]) -> Column:
    def one(role: str, text: str) -> list[Column]:
        fields = {"role": F.lit(f'"role": "{role}"'), "content": F.concat(F.lit('"content": '), quoted(F.col(text)))}
        return [F.lit("{"), fields[order[0]], F.lit(", "), fields[order[1]], F.lit("}")]

    return F.concat(F.lit("["), *one("system", "system_text"), F.lit(", "), *one("user", "user_text"), F.lit("]"))


def cache_key(options: Options) -> Column:
    """SHA-256 of messages and options as JSON with sorted keys, over ``system_text`` and ``user_text``."""
    tail = json.dumps(
        {"max_tokens": options.max_tokens, "model": options.model, "response_format": options.response_format, "temperature": options.temperature},
        ensure_ascii=False,
    )
    return F.sha2(F.concat(F.lit('{"messages": '), _messages(("content", "role")), F.lit(f', "options": {tail}}}')), 256)


def payload(options: Options) -> Column:
    """The body of a chat-completion request."""
    tail = f', "temperature": {json.dumps(options.temperature)}, "max_tokens": {options.max_tokens}'
    if options.response_format == "json_object":
        tail += ', "response_format": {"type": "json_object"}'
    return F.concat(F.lit(f'{{"model": {json.dumps(options.model, ensure_ascii=False)}, "messages": '), _messages(("role", "content")), F.lit(tail + "}"))
