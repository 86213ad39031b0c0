"""JSON text: escaping as Python writes it, and tolerant reading as variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAMED = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))
_OTHER = [chr(c) for c in range(32) if chr(c) not in "\n\r\t\b\f"]


def quoted(text: Column) -> Column:
    """A JSON string literal with non-ASCII text kept, byte for byte as ``json.dumps`` writes it.

    The rare control characters cost their replacements only where one occurs.
    """
    escaped = text
    for raw, code in _NAMED:
        escaped = F.replace(escaped, F.lit(raw), F.lit(code))
    rare = escaped
    for c in _OTHER:
        rare = F.replace(rare, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    has_rare = text.rlike("[\\x00-\\x07\\x0b\\x0e-\\x1f]")
    return F.concat(F.lit('"'), F.when(has_rare, rare).otherwise(escaped), F.lit('"'))


def stripped(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def kind(value: Column) -> Column:
    """``OBJECT``, ``ARRAY``, ``STRING``, ``BIGINT``, ``BOOLEAN``, ``VOID`` ...; null for a missing value."""
    return F.when(value.isNotNull(), F.regexp_extract(F.schema_of_variant(value), r"^([A-Z]+)", 1))


def extracted(text: Column) -> Column:
    """The JSON value inside an answer: the whole text, else a fenced block, else first ``{`` to last ``}``."""
    clean = stripped(text)
    fenced = F.regexp_extract(clean, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(clean, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(clean), F.try_parse_json(stripped(fenced)), F.try_parse_json(braces))


def text_at(value: Column, path: str) -> Column:
    """The text at a path if it is a string with anything but white space in it, stripped."""
    found = F.try_variant_get(value, path, "variant")
    text = F.when(kind(found) == "STRING", stripped(F.try_variant_get(value, path, "string")))
    return F.when(text != "", text)
