"""Column expressions over paths, module names and ids."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path fragments whose files never yield rule findings.
EXCLUDED_PATH_FRAGMENTS = (
    "tests/", "test_", "_test.py", "conftest.py", "migrations/", "__pycache__/", ".venv/", "venv/",
    "node_modules/", "setup.py", "manage.py", "config.py", "settings.py", "conf.py",
)

# Fixed value: a dotted name made of identifiers, with Unicode word characters.
QUALIFIED_NAME = r"(?U)^[A-Za-z_]\w*(\.[A-Za-z_]\w*)*$"

# Fixed value: tool chatter that may be mixed into a text report.
DIAGNOSTIC_LINE = r"(?i)^(warning|error|info|critical):"


def joined_id(*parts: Column | str) -> Column:
    """``a::b::c``; a null part counts as empty text instead of vanishing."""
    columns = [F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts]
    return F.concat_ws("::", *columns)


def event_id(kind: str, *parts: Column | str) -> Column:
    return joined_id(F.lit(kind), *parts)


def posix_path(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def path_to_module(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "/", "."), r"\.py$", "")


def module_to_path(module: Column) -> Column:
    return F.concat(F.translate(module, ".", "/"), F.lit(".py"))


def parent_name(name: Column, levels: int = 1) -> Column:
    """Drop the last ``levels`` dotted parts; null when nothing would be left."""
    kept = dotted_size(name) - levels
    return F.when(kept > 0, F.regexp_replace(name, rf"(\.[^.]*){{{levels}}}$", ""))


def last_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def leading_parts(name: Column, count: int) -> Column:
    """The first ``count`` dotted parts; a shorter name stays whole."""
    return F.substring_index(name, ".", count)


def dotted_size(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) + 1


def is_excluded_path(path: Column, fragments: Iterable[str] | None = None) -> Column:
    """True where the normalised path contains any of the fragments anywhere."""
    wanted = EXCLUDED_PATH_FRAGMENTS if fragments is None else tuple(fragments)
    normal = posix_path(path)
    test = F.lit(False)
    for fragment in wanted:
        text = fragment.replace("\\", "/").lower()
        if text:
            test = test | F.contains(normal, F.lit(text))
    return test


def is_ignored_module(module: Column, package: str, ignored: Iterable[str]) -> Column:
    """True where a part below the package root is an ignored folder name."""
    names = [n.strip() for n in ignored if n and n.strip() and "." not in n]
    test = F.lit(False)
    for name in names:
        test = test | F.contains(F.concat(module, F.lit(".")), F.lit(f".{name}."))
    return F.startswith(module, F.lit(f"{package}.")) & test if names else F.lit(False)


def is_qualified_name(name: Column) -> Column:
    return F.coalesce(name.rlike(QUALIFIED_NAME), F.lit(False))


def is_diagnostic(line: Column) -> Column:
    return F.trim(line).rlike(DIAGNOSTIC_LINE)


def _col(part: Column | str) -> Column:
    return F.col(part) if isinstance(part, str) else part
