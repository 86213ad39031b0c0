"""Project configuration: JSON in, small relations and checked values out."""

from __future__ import annotations

import configparser
import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def config_table(spark: SparkSession, columns: str, rows: Sequence[Sequence[Any]]) -> DataFrame:
    """A relation of configuration rows whose size the planner knows.

    ``columns`` is a DDL list such as ``layer string, tier int``.
    """
    names = [c.strip().split()[0] for c in columns.split(",")]
    if not rows:
        return spark.createDataFrame([], columns)
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    casts = ", ".join("cast({0} as {1}) as {0}".format(*c.strip().split()) for c in columns.split(","))
    return spark.sql(f"select {casts} from values {body} as t({', '.join(names)})")


def _literal(value: Any) -> str:
    if value is None or isinstance(value, (bool, int, float)):
        return "null" if value is None else str(value).lower()
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _texts(value: Any) -> list[str]:
    if isinstance(value, str):
        value = [value]
    return [v.strip() for v in value if isinstance(v, str) and v.strip()] if isinstance(value, list) else []


@dataclass(frozen=True)
class Contract:
    """Groups of modules and the ordered pairs of groups that must not be linked."""

    name: str
    groups: tuple[tuple[str, str], ...]
    pairs: tuple[tuple[str, str], ...]
    through: bool = False
    direct_only: bool = False
    ignored: tuple[tuple[str, str], ...] = ()

    @classmethod
    def of(cls, data: dict[str, Any]) -> Contract:
        """A contract of type ``layers``, ``forbidden`` or ``independence``."""
        kind, name = str(data.get("type", "")).strip().lower(), str(data.get("name") or data.get("type"))
        ignored = tuple(tuple(x.strip() for x in line.split("->")) for line in _texts(data.get("ignore_imports") or []) if "->" in line)
        if kind == "layers":
            return cls.layered(name, _tiers(data.get("layers") or []), _texts(data.get("containers") or []) or [""], ignored)
        if kind == "independence":
            modules = _texts(data.get("modules") or [])
            return cls(name, tuple((m, m) for m in modules), tuple((a, b) for a in modules for b in modules if a != b), ignored=ignored)
        if kind == "forbidden":
            sources, targets = _texts(data.get("source_modules") or []), _texts(data.get("forbidden_modules") or [])
            indirect = str(data.get("allow_indirect_imports", "false")).strip().lower() in ("true", "1")
            groups = tuple((m, m) for m in dict.fromkeys([*sources, *targets]))
            return cls(name, groups, tuple((a, b) for a in sources for b in targets if a != b), True, indirect, ignored)
        raise ValueError(f"contract {name!r}: unknown type {kind!r}")

    @classmethod
    def layered(cls, name: str, tiers: list[tuple[list[str], bool]], containers: list[str], ignored: tuple = ()) -> Contract:
        """Highest tier first; no layer may reach a higher one, and independent siblings not each other."""
        groups, pairs = [], []
        for container in containers:
            full = lambda layer: f"{container}.{layer}" if container else layer  # noqa: B023, E731
            groups += [(full(x), full(x)) for tier, _ in tiers for x in tier]
            for at, (tier, apart) in enumerate(tiers):
                above = [x for higher, _ in tiers[:at] for x in higher]
                pairs += [(full(a), full(b)) for a in tier for b in above + [c for c in tier if apart and c != a]]
        return cls(name, tuple(groups), tuple(pairs), ignored=ignored)


def _tiers(lines: Any) -> list[tuple[list[str], bool]]:
    """Layers by tier, and whether those of a tier are independent: ``a | b``; ``a : b`` and lists are not."""
    out = []
    for line in lines.splitlines() if isinstance(lines, str) else lines:
        apart = isinstance(line, str) and "|" in line
        names = _texts(line) if isinstance(line, list) else str(line).replace("|", ":").split(":")
        tier = [n.strip().strip("()").strip() for n in names if n.strip()]
        out += [(tier, apart)] if tier else []
    return out


def read_contracts(text: str) -> list[Contract]:
    """The contracts of an INI file with sections ``importlinter:contract:<id>``, in their order."""
    parser = configparser.RawConfigParser()
    parser.optionxform = str
    parser.read_string(text)
    out = []
    for section in parser.sections():
        if section.startswith("importlinter:contract:"):
            lists = ("layers", "containers", "modules", "source_modules", "forbidden_modules", "ignore_imports")
            data = {k: [x for x in v.splitlines() if x.strip()] if k in lists else v for k, v in parser.items(section)}
            out.append(Contract.of({"name": section.rpartition(":")[2]} | data))
    return out


@dataclass(frozen=True)
class ProjectConfig:
    package_root: str = ""
    layers: dict[str, Any] = field(default_factory=dict)
    utility_layers: dict[str, Any] = field(default_factory=dict)
    external_layers: dict[str, Any] = field(default_factory=dict)
    layer_order: list | None = None
    interface_layers: tuple[str, ...] = ()
    ignore_dirs: tuple[str, ...] = ()
    sdp_tolerance: float = 0.0
    exceptions: tuple[tuple[str, str], ...] = ()
    cohesion_threshold: int = 1
    collision_limit: float = 0.35
    abort_on_collision: bool = False
    enrichment: dict[str, Any] = field(default_factory=dict)
    is_default: bool = False
    given_contracts: tuple[Contract, ...] = ()

    @classmethod
    def read(cls, path: str) -> ProjectConfig:
        """Read and check a JSON file; both flat and grouped ``layer_order`` are accepted."""
        data = json.loads(Path(path).read_text(encoding="utf-8"))
        if "package_root" not in data:
            raise ValueError("the configuration needs 'package_root'")
        if not isinstance(data.get("layers"), dict):
            raise ValueError("the configuration needs a 'layers' object")
        if not isinstance(data.get("ignore_dirs"), list):
            raise ValueError("the configuration needs an 'ignore_dirs' list")
        order = data.get("layer_order")
        if order is not None:
            if not isinstance(order, list):
                raise ValueError("'layer_order' must be a list")
            named = {n for group in order for n in (group if isinstance(group, list) else [group])}
            if named != set(data["layers"]):
                raise ValueError(f"'layer_order' and 'layers' differ: {sorted(named ^ set(data['layers']))}")
        return cls.of(data)

    @classmethod
    def of(cls, data: dict[str, Any] | None) -> ProjectConfig:
        given = data or {}
        text = _texts
        pairs = tuple(
            (e["source"], e["target"]) for e in given.get("allowed_dependency_exceptions") or [] if e.get("source") and e.get("target")
        )
        calls = given.get("pyan3") or {}
        return cls(
            package_root=given.get("package_root", ""),
            layers=given.get("layers") or {},
            utility_layers=given.get("utility_layers") or {},
            external_layers=given.get("external_layers") or {},
            layer_order=given.get("layer_order"),
            interface_layers=tuple(text(given.get("interface_layers") or [])),
            ignore_dirs=tuple(text(given.get("ignore_dirs") or [])),
            sdp_tolerance=float(given.get("sdp_tolerance") or 0.0),
            exceptions=pairs,
            cohesion_threshold=int(given.get("cohesion_threshold", 1)),
            collision_limit=float(calls.get("collision_rate_threshold", 0.35)),
            abort_on_collision=bool(calls.get("abort_on_high_collision", False)),
            enrichment=given.get("llm") or {},
            is_default=not given,
            given_contracts=tuple(map(Contract.of, given.get("contracts") or [])),
        )

    def contracts(self) -> list[Contract]:
        """The contracts of the configuration, else that of its layer order."""
        tiers: dict[int, list[str]] = {}
        for layer, tier in self.tier_rows():
            tiers.setdefault(tier, []).append(layer)
        if self.given_contracts or not tiers:
            return list(self.given_contracts)
        order = Contract.layered("layer order", [(tiers[t], False) for t in sorted(tiers)], [""])
        named = {layer for layer, _ in order.groups}
        return [Contract(order.name, tuple((layer, prefix) for layer, prefix, _ in self.prefix_rows() if layer in named), order.pairs)]

    def prefix_rows(self) -> list[tuple[str, str, int]]:
        """``(layer, prefix, ord)`` over layers, then utility layers, rooted in the package."""
        root, rows = self.package_root, []
        for section in (self.layers, self.utility_layers):
            for layer, value in section.items():
                for path in _texts(value):
                    rooted = not root or path == root or path.startswith(root + ".")
                    rows.append((layer, path if rooted else f"{root}.{path}", len(rows)))
        return rows

    def external_rows(self) -> list[tuple[str, str, int]]:
        rows = []
        for layer, value in self.external_layers.items():
            for path in _texts(value):
                rows.append((layer, path, len(rows)))
        return rows

    def tier_rows(self) -> list[tuple[str, int]]:
        order = self.layer_order
        if not isinstance(order, list) or not order:
            return []
        grouped = isinstance(order[0], list)
        tiers: dict[str, int] = {}
        for tier, entry in enumerate(order):
            if grouped == isinstance(entry, list):
                for name in _texts(entry):
                    tiers[name] = tier
        return list(tiers.items())

    def prefixes(self, spark: SparkSession) -> DataFrame:
        return config_table(spark, "layer string, prefix string, ord int", self.prefix_rows())

    def externals(self, spark: SparkSession) -> DataFrame:
        return config_table(spark, "layer string, prefix string, ord int", self.external_rows())

    def tiers(self, spark: SparkSession) -> DataFrame:
        return config_table(spark, "layer string, tier int", self.tier_rows())

    def names(self, spark: SparkSession, values: Sequence[str]) -> DataFrame:
        return config_table(spark, "layer string", [(v,) for v in values])
