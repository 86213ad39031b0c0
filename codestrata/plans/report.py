"""From facts to the full report: entities, events, summaries."""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.config import Contract, ProjectConfig, config_table
from codestrata.operators import callgraph, classfacts, contracts, events, heuristics, import_contracts, layers, native_metrics, relations, summaries, symbols
from codestrata.session import cut_lineage
from codestrata.sources import files as source_files
from codestrata.sources import json_parts, tool_reports
from codestrata.sources.python_metrics import metric_rows
from codestrata.sources.python_scopes import scope_rows
from codestrata.sources.python_syntax import stored_syntax_rows

SOURCES = ("radon", "cohesion", "import_graph", "import_linter", "pyan3")


@dataclass
class Layering:
    """Layer knowledge as small relations, from a configuration or from a dimension table."""

    layers: DataFrame
    prefixes: DataFrame
    tiers: DataFrame
    interfaces: DataFrame
    utility: DataFrame
    exceptions: DataFrame | None = None
    tolerance: float = 0.0

    @classmethod
    def of(cls, spark: SparkSession, config: ProjectConfig) -> Layering:
        names = [*config.layers, *config.utility_layers, *config.external_layers]
        tiers = config.tiers(spark)
        if config.external_layers and config.tier_rows():
            tiers = layers.with_external_tier(tiers, config.names(spark, list(config.external_layers)))
        return cls(
            config.names(spark, names), config.prefixes(spark), tiers, config.names(spark, config.interface_layers),
            config.names(spark, list(config.utility_layers)), config_table(spark, "source string, target string", config.exceptions), config.sdp_tolerance,
        )


@dataclass
class Sources:
    """The facts of one run; a source that is absent or failed stays ``None``."""

    blocks: DataFrame | None = None
    mi_files: DataFrame | None = None
    cohesion: DataFrame | None = None
    edges: DataFrame | None = None
    broken_imports: DataFrame | None = None
    contract_totals: DataFrame | None = None
    call_nodes: DataFrame | None = None
    call_edges: DataFrame | None = None
    suspicious: DataFrame | None = None
    contract_chains: DataFrame | None = None
    errors: dict[str, str] = field(default_factory=dict)

    def present(self) -> list[str]:
        given = (self.blocks, self.cohesion, self.edges, self.broken_imports, self.call_nodes)
        return [name for name, df in zip(SOURCES, given) if df is not None and name not in self.errors]


_EMPTY = {
    "blocks": "filepath string, name string, type string, complexity bigint, rank string, lineno bigint",
    "mi_files": "filepath string, mi double, rank string",
    "cohesion": "name string, filepath string, lineno bigint, class_kind string, cohesion_score double, cohesion_score_norm double, methods_count bigint, excluded_from_aggregation boolean",
    "edges": "source string, target string",
    "broken_imports": "importer string, imported string, contract_name string, seq bigint",
    "contract_totals": "kept bigint, broken bigint",
    "call_nodes": "name string",
    "call_edges": "source string, target string",
    "suspicious": "block string",
}


def build(spark: SparkSession, given: Sources, around: Layering, limit: int = 1, sections: Collection[str] | None = None) -> dict[str, DataFrame]:
    """All report sections by name. What several sections read is written once.

    A caller that needs only some ``sections`` names them; ``layers`` come from imports and contracts alone.
    """

    def use(name: str) -> DataFrame:
        df = getattr(given, name)
        return df if df is not None else spark.createDataFrame([], _EMPTY[name])

    edges = cut_lineage(use("edges"))
    rated = layers.stability(around.layers, edges)
    rules = _rule_rows(edges, rated, around)
    broken = layers.resolve_broken_imports(use("broken_imports"), around.prefixes)
    pairs = cut_lineage(layers.broken_pairs(broken))
    counted = cut_lineage(layers.attach_tier(layers.layer_counters(rated, rules, pairs), around.tiers, around.utility))
    if sections is not None and set(sections) <= {"layers"}:
        return {"layers": counted.orderBy("layer")}

    all_functions, all_classes = cut_lineage(relations.normal_functions(use("blocks"))), cut_lineage(relations.normal_classes(use("cohesion")))
    # Repeated ids: the simplest function and the lowest class of the file stand; file counts take every row.
    functions = cut_lineage(relations.last_per_key(all_functions.withColumn("_at", -F.col("cc")), ["function_id"], "_at").drop("_at"))
    classes = cut_lineage(relations.last_per_key(all_classes.withColumn("_at", F.col("lineno")), ["class_id"], "_at").drop("_at"))
    index = cut_lineage(events.with_layer(relations.file_index(all_functions, use("mi_files"), all_classes), around.prefixes))
    bound = cut_lineage(relations.bind_methods(functions, classes))
    full_functions = relations.cross_functions(functions, bound, classes, index)
    full_classes = cut_lineage(
        events.with_layer(relations.cross_classes(classes, relations.method_stats(functions, bound), index), around.prefixes)
    )

    nodes, bad = cut_lineage(use("call_nodes")), cut_lineage(use("suspicious"))
    calls = callgraph.rate_edges(use("call_edges"), bad)
    kinds = callgraph.classify_nodes(nodes, calls)
    rate = F.lit(round(callgraph.collision_rate(nodes, bad), 4))
    placed = relations.place_dead(relations.normal_dead(kinds.where("node_class = 'dead'").select("name"), rate), classes)
    dead = cut_lineage(layers.resolve(placed, "module", around.prefixes, "longest").drop("module"))

    cycles = cut_lineage(layers.layer_cycles(edges))
    streams = [
        events.high_cc(full_functions), events.low_mi(index), events.low_cohesion_events(full_classes, limit), events.dead_code(dead),
        events.import_cycles(cycles), events.merge_layer_violations(rules, pairs), events.overloaded(full_classes, limit),
        events.dead_risk(dead, functions), events.dead_layer(dead, counted), events.unstable_layer(counted, full_classes, limit),
        events.low_mi_layer(index, counted), events.low_cohesion_layer(full_classes, counted, limit),
    ]
    violations = events.merge_shared(events.concat_events(streams))
    present = given.present()
    return {
        "meta": config_table(
            spark, "source string, succeeded boolean, error string", [(s, s in present, given.errors.get(s)) for s in SOURCES]
        ),
        "files": index.drop("layer").orderBy("filepath"),
        "classes": full_classes.drop("layer", "high_cc_methods", "top_method").orderBy("class_id"),
        "functions": full_functions.orderBy("function_id"),
        "layers": counted.orderBy("layer"),
        "violations": events.in_report_order(violations),
        "violation_imports": broken.select("from_layer", "to_layer", "contract_name", "importer", "imported"),
        "dead_code": dead.orderBy("qualified_name"),
        "call_edges": calls.orderBy("source", "target"),
        "summary_complexity": summaries.complexity_summary(functions),
        "summary_maintainability": summaries.maintainability_summary(index.withColumnRenamed("mi_rank", "rank")),
        "summary_ranks": summaries.rank_distribution(functions).withColumn("metric", F.lit("cc")).unionByName(
            summaries.rank_distribution(index.where("mi is not null"), "mi_rank").withColumn("metric", F.lit("mi"))
        ),
        "summary_cohesion": summaries.cohesion_summary(classes, limit),
        "summary_imports": summaries.imports_summary(counted, use("contract_totals"), cycles),
        "summary_dead_code": summaries.dead_summary(dead, rate),
        "summary_violations": summaries.strength_counts(violations),
    }


def _rule_rows(edges: DataFrame, rated: DataFrame, around: Layering) -> DataFrame:
    """SDP rows, then SLP rows, in one shape with their emission order."""
    return as_rule_rows(
        layers.sdp_violations(edges, rated, around.tiers, around.exceptions, around.tolerance),
        layers.slp_violations(edges, around.tiers, around.interfaces),
    )


def as_rule_rows(sdp: DataFrame, slp: DataFrame) -> DataFrame:
    shape = {"tier": "bigint", "dep_tier": "bigint", "skip_distance": "bigint", "instability": "double", "dep_instability": "double"}
    parts = []
    for at, rows in enumerate((sdp, slp)):
        missing = {n: F.lit(None).cast(t) for n, t in shape.items() if n not in rows.columns}
        parts.append(rows.withColumns(missing).select("rule", "layer", "dependency", "severity", *shape, F.lit(at).cast("long").alias("seq")))
    return parts[0].unionByName(parts[1])


# ------------------------------------------------------------- running a project

Analyzer = Callable[["Project"], None]
ANALYZERS: dict[str, Analyzer] = {}


def analyzer(name: str) -> Callable[[Analyzer], Analyzer]:
    """Register a step that reads a project's inputs and fills in its sources."""

    def keep(fn: Analyzer) -> Analyzer:
        ANALYZERS[name] = fn
        return fn

    return keep


@dataclass
class Project:
    """One source tree with the saved reports of the tools that ran over it.

    ``reports`` maps a tool's name to the path of its output. ``root`` is the
    package folder; every path becomes relative to the folder that holds it.
    ``native`` takes complexity, maintainability, contracts and calls from the source where their report is missing.
    """

    spark: SparkSession
    root: str
    config: ProjectConfig
    reports: dict[str, str] = field(default_factory=dict)
    contracts_passed: bool = True
    native: bool = False
    sources: Sources = field(default_factory=Sources)
    findings: DataFrame | None = None
    candidates: DataFrame | None = None
    _rows: DataFrame | None = None
    _methods: DataFrame | None = None

    @property
    def package(self) -> str:
        return self.root.rstrip("/").rsplit("/", 1)[-1]

    def files(self) -> DataFrame:
        return source_files.scan_python(self.spark, self.root, self.config.ignore_dirs, self.package)

    def rows(self) -> DataFrame:
        if self._rows is None:
            self._rows = stored_syntax_rows(self.files())
        return self._rows

    def methods(self) -> DataFrame:
        if self._methods is None:
            self._methods = cut_lineage(classfacts.method_facts(self.rows()))
        return self._methods

    def json(self, name: str) -> DataFrame | None:
        """The entries of a tool's saved report. One that only says what went wrong is an error of its source."""
        path = self.reports.get(name)
        if path is None:
            return None
        report = cut_lineage(json_parts.entries(self.spark, path))
        broken = tool_reports.entries_error(report, lists=name == "parameters")
        if broken is not None:
            raise ValueError(f"the {name} report is no result: {broken}")
        return report

    def relative(self, df: DataFrame) -> DataFrame:
        """Tool paths cut down to start at the package folder, with forward slashes."""
        slashed = F.replace("filepath", F.lit("\\"), F.lit("/"))
        base = self.root.rstrip("/")
        inside = F.when(F.startswith(slashed, F.lit(base + "/")), F.concat(F.lit(self.package), F.substr(slashed, F.lit(len(base) + 1))))
        return df.withColumn("filepath", F.coalesce(inside, F.regexp_replace(slashed, r"^\./", "")))


@analyzer("radon")
def _complexity(p: Project) -> None:
    report = p.json("complexity")
    if report is None and p.native:
        rows = cut_lineage(metric_rows(p.files()))
        p.sources.blocks, p.sources.mi_files = native_metrics.complexity_blocks(rows), native_metrics.maintainability_files(rows)
        return
    if report is None:
        raise FileNotFoundError("no complexity report")
    blocks = p.relative(tool_reports.complexity_entries(report))
    counts = p.json("parameters")
    if counts is not None:
        blocks = relations.attach_parameter_counts(blocks.withColumn("parameter_count", F.lit(None).cast("long")), p.relative(tool_reports.parameter_entries(counts)))
    p.sources.blocks = blocks
    mi = p.json("maintainability")
    p.sources.mi_files = p.relative(tool_reports.maintainability_entries(mi)) if mi is not None else None


@analyzer("cohesion")
def _cohesion(p: Project) -> None:
    methods = p.methods()
    p.sources.cohesion = cut_lineage(classfacts.cohesion_rows(p.rows(), methods, classfacts.class_facts(p.rows(), methods)))


@analyzer("import_graph")
def _import_graph(p: Project) -> None:
    if not p.config.layers:
        raise ValueError("the configuration has no layers")
    external = p.config.externals(p.spark) if p.config.external_rows() else None
    p.sources.edges = cut_lineage(
        layers.layer_edges(
            classfacts.import_graph(p.rows(), p.files()), p.config.prefixes(p.spark), external,
            p.package, p.config.ignore_dirs,
        )
    )


@analyzer("import_linter")
def _contracts(p: Project) -> None:
    path = p.reports.get("contracts")
    if path is None and p.native:
        return _check_contracts(p)
    if path is None:
        raise FileNotFoundError("no contract report")
    lines = cut_lineage(source_files.read_lines(p.spark, path))
    p.sources.broken_imports = contracts.broken_imports(lines).withColumnRenamed("pos", "seq")
    passed = lines.select("file").distinct().withColumn("passed", F.lit(p.contracts_passed))
    p.sources.contract_totals = contracts.contract_totals(lines, passed)


def _check_contracts(p: Project) -> None:
    """The contracts checked on the imports of the source."""
    given = p.config.contracts()
    if not given:
        raise FileNotFoundError("no contract report and no contracts to check")
    imports = cut_lineage(classfacts.import_graph(p.rows(), p.files()))
    groups, pairs, modes, order = contract_relations(p.spark, given)
    ignored = import_contracts.ignored_imports(imports, [(c.name, *pattern) for c in given for pattern in c.ignored])
    found = cut_lineage(import_contracts.breaches(imports, groups, pairs, modes, ignored))
    direct = import_contracts.direct_breaches(imports, import_contracts.members(imports, groups), pairs, ignored)
    p.sources.contract_chains = found
    p.sources.broken_imports = cut_lineage(import_contracts.broken_imports(found, direct, order))
    p.sources.contract_totals = cut_lineage(import_contracts.totals(found, order))


def contract_relations(spark: SparkSession, given: list[Contract]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Groups, pairs, modes and order of contracts as the relations that the check joins."""
    return (
        config_table(spark, "contract string, grp string, prefix string", [(c.name, g, m) for c in given for g, m in c.groups]),
        config_table(spark, "contract string, origin string, target string", [(c.name, a, b) for c in given for a, b in c.pairs]),
        config_table(spark, "contract string, through boolean, direct_only boolean", [(c.name, c.through, c.direct_only) for c in given]),
        config_table(spark, "contract string, seq int", [(c.name, k) for k, c in enumerate(given)]),
    )


@analyzer("pyan3")
def _calls(p: Project) -> None:
    path = p.reports.get("calls")
    if path is None and not p.native:
        raise FileNotFoundError("no call-graph report")
    if path is None:
        nodes, edges, bad = symbols.call_graph(cut_lineage(scope_rows(p.files())))
    else:
        parsed = cut_lineage(callgraph.parse_blocks(cut_lineage(source_files.read_lines(p.spark, path))))
        nodes, edges, bad = callgraph.nodes(parsed), callgraph.raw_edges(parsed), callgraph.suspicious_blocks(parsed)
    if p.config.abort_on_collision:
        rate = callgraph.collision_rate(nodes, bad)
        if rate > p.config.collision_limit:
            raise ValueError(f"name collisions at {rate:.0%}, the limit is {p.config.collision_limit:.0%}")
    p.sources.call_nodes, p.sources.call_edges, p.sources.suspicious = nodes, edges.select("source", "target"), bad


@analyzer("heuristics")
def _rules(p: Project) -> None:
    rows, methods = p.rows(), p.methods()
    project = cut_lineage(classfacts.project_classes(classfacts.class_facts(rows, methods)))
    found = cut_lineage(heuristics.findings(rows, project, methods))
    p.findings = heuristics.merge_findings(found)
    p.candidates = heuristics.merge_candidates(heuristics.candidates(project, found))


def run(project: Project, generated_at: str | None = None) -> dict[str, DataFrame]:
    """Run every analyzer, keep the failures apart, and build the report.

    ``generated_at`` is the caller's time, so that equal inputs give equal reports.
    """
    for name, step in ANALYZERS.items():
        try:
            step(project)
        except Exception as exc:  # noqa: BLE001  one broken source must not stop the others
            project.sources.errors[name] = f"{type(exc).__name__}: {exc}"
    report = build(project.spark, project.sources, Layering.of(project.spark, project.config), project.config.cohesion_threshold)
    if project.findings is not None:
        report["findings"] = project.findings
        report["candidates"] = project.candidates.orderBy(F.col("priority").desc(), *[c for c in ("path", "class_name") if c in project.candidates.columns])
    return report | _notes(project, report, generated_at)


def _notes(project: Project, report: dict[str, DataFrame], generated_at: str | None) -> dict[str, DataFrame]:
    """Facts about the run, orders that readers start from, and what went wrong inside a source."""
    spark, given = project.spark, project.sources
    facts = (generated_at, given.blocks is not None and ("parameters" in project.reports or "parameter_count" in given.blocks.columns), project.config == ProjectConfig())
    notes = {
        "run": config_table(spark, "generated_at string, parameters_used boolean, config_defaults_used boolean", [facts]),
        "functions_by_complexity": report["functions"].select("function_id", "cc").orderBy(F.col("cc").desc(), "function_id"),
        "files_by_maintainability": report["files"].where("mi is not null").select("filepath", "mi").orderBy("mi", "filepath"),
    }
    if given.contract_chains is not None:
        chains = given.contract_chains.withColumn("chain", F.array_join("chain", " -> "))
        notes["contract_chains"] = chains.orderBy("contract", "origin", "target")
    if given.call_nodes is not None and given.call_edges is not None:
        roles = callgraph.classify_nodes(given.call_nodes, given.call_edges)
        rate = callgraph.collisions(given.call_nodes, given.suspicious)
        warned = callgraph.collision_status(F.col("rate"), project.config.collision_limit)
        notes["call_roots"] = roles.where("node_class = 'root'").select("name").orderBy("name")
        notes["suspicious_blocks"] = given.suspicious.orderBy(given.suspicious.columns[0])
        notes["call_warnings"] = rate.select(warned.alias("collision_status"), callgraph.parse_warning(given.call_nodes, given.call_edges).alias("nodes_without_edges"))
    if project._rows is not None:
        broken = project.rows().where("kind = 'error'").select("path", F.concat_ws(": ", "name", "text").alias("error"))
        unread = project.files().where("error is not null").select("path", "error")
        notes["file_errors"] = broken.unionByName(unread).orderBy("path")
        notes["name_collisions"] = classfacts.name_collisions(classfacts.class_facts(project.rows(), project.methods())).orderBy("class_name")
    return notes
