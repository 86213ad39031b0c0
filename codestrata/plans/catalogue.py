"""Queries over files, functions, classes, layers, calls and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.config import config_table
from codestrata.functions.names import is_excluded_path, is_ignored_module, path_to_module
from codestrata.functions.numbers import round_binary
from codestrata.operators import callgraph, cohesion, contracts, events, graph, layers, relations, summaries
from codestrata.plans.report import Layering, Sources, as_rule_rows, build
from codestrata.plans.registry import RAW, part, query, ratio_sql, rounded
from codestrata.plans.tables import Facts

TOLERANCE = 0.1

# ---------------------------------------------------------------- shared parts

part("cust", """SELECT *, 'app/n' || c_nationkey || '/c' || c_custkey || '.py' AS filepath,
  'app.n' || c_nationkey || '.c' || c_custkey AS module, 'n' || c_nationkey AS layer FROM customer""")
part("ord", "SELECT * FROM orders JOIN cust ON o_custkey = c_custkey")
part("fn0", """SELECT filepath, 'f' || o_orderkey AS name, CASE WHEN o_orderpriority = '5-LOW' THEN 'function' ELSE 'method' END AS type,
  CAST(floor(o_totalprice / 25000.0::DOUBLE) AS BIGINT) + 1 AS cc, o_orderkey AS lineno, layer FROM ord WHERE o_orderstatus IN ('O', 'F')""")
part("fn", """SELECT *, filepath || '::' || lineno || '::' || name AS function_id,
  CASE WHEN cc <= 5 THEN 'A' WHEN cc <= 10 THEN 'B' WHEN cc <= 20 THEN 'C' WHEN cc <= 30 THEN 'D' WHEN cc <= 40 THEN 'E' ELSE 'F' END AS rank FROM fn0""")
part("cls", """SELECT filepath, 'K' || o_orderkey AS class_name, filepath || '::K' || o_orderkey AS class_id, o_orderkey AS lineno,
  CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS digit, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS lcom4,
  substr(o_orderpriority, 1, 1) = '4' AS excluded, layer FROM ord WHERE o_orderstatus = 'P'""")
part("mi0", "SELECT filepath, layer, CAST(floor((c_acctbal + 1000.0::DOUBLE) / 1.1::DOUBLE) AS DOUBLE) / 100.0::DOUBLE AS mi FROM cust")
part("mif", "SELECT *, CASE WHEN mi > 19 THEN 'A' WHEN mi > 9 THEN 'B' ELSE 'C' END AS rank FROM mi0")
part("items", """SELECT li.l_orderkey, li.l_partkey, li.l_suppkey, li.l_linenumber, li.l_returnflag, o.o_orderpriority, c.c_nationkey, c.c_custkey, s.s_nationkey, s.s_acctbal, s.s_suppkey,
  nc.n_regionkey AS c_region, ns.n_regionkey AS s_region
  FROM lineitem li JOIN orders o ON li.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON li.l_suppkey = s.s_suppkey
  JOIN nation nc ON nc.n_nationkey = c.c_nationkey JOIN nation ns ON ns.n_nationkey = s.s_nationkey""")
part("pairs", "SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n FROM items WHERE c_nationkey <> s_nationkey GROUP BY ALL")
part("edges", """SELECT 'n' || a AS source, 'n' || b AS target FROM
  (SELECT p.a, p.b FROM pairs p LEFT JOIN pairs q ON q.a = p.b AND q.b = p.a WHERE p.n > coalesce(q.n, 0))""")
part("lay", "SELECT 'n' || n_nationkey AS layer, n_regionkey AS tier FROM nation")
part("deg", """SELECT layer, (SELECT count(*) FROM edges WHERE target = layer) AS ca, (SELECT count(*) FROM edges WHERE source = layer) AS ce FROM lay""")
part("stab", f"SELECT layer, ca, ce, {ratio_sql('ce', 'ca + ce', 2)} AS instability FROM deg")
part("placed", """SELECT e.source, e.target, a.tier AS ts, b.tier AS tt, x.instability AS i, y.instability AS d FROM edges e
  JOIN lay a ON a.layer = e.source JOIN lay b ON b.layer = e.target JOIN stab x ON x.layer = e.source JOIN stab y ON y.layer = e.target""")
part("sdp", f"SELECT * FROM placed WHERE target <> 'n0' AND i > d + {TOLERANCE}::DOUBLE")
part("slp", """SELECT *, tt - ts - 1 AS skip, CASE WHEN tt = 2 THEN 'warning' WHEN ts < 2 AND tt > 2 THEN 'error' WHEN tt - ts - 1 >= 2 THEN 'error'
  ELSE 'warning' END AS severity FROM placed WHERE tt - ts - 1 >= 1""")
part("broken", """SELECT 'n' || c_nationkey AS from_layer, 'n' || s_nationkey AS to_layer, o_orderpriority AS contract_name, l_orderkey AS seq FROM items
  WHERE l_returnflag = 'R' AND c_region = s_region AND c_nationkey <> s_nationkey""")
part("cnt", """SELECT s.*, (SELECT count(*) FROM sdp WHERE source = s.layer) AS sdp_n, (SELECT count(*) FROM slp WHERE source = s.layer) AS slp_n,
  coalesce(b.n, 0) AS broken_n FROM stab s LEFT JOIN (SELECT from_layer, count(*) AS n FROM broken GROUP BY 1) b ON b.from_layer = s.layer""")
part("bnd", """SELECT f.function_id, c.class_id FROM (SELECT * FROM fn WHERE type = 'method') f ASOF JOIN cls c
  ON f.filepath = c.filepath AND f.lineno >= c.lineno""")
part("dead0", """SELECT CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'f' || o_orderkey WHEN '2' THEN 'app.f' || o_orderkey
  WHEN '3' THEN module || '.K' || o_orderkey || '.run' ELSE module || '.f' || o_orderkey END AS qn, filepath, layer, module, o_orderkey AS k,
  substr(o_orderpriority, 1, 1) AS p, o_orderstatus AS st FROM ord o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey)""")
part("dead", """SELECT qn, k, p, CASE WHEN p = '1' THEN 'f' || k || '.py' WHEN p = '2' THEN 'app.py' WHEN p = '3' AND st <> 'P'
  THEN replace(module, '.', '/') || '/K' || k || '.py' ELSE filepath END AS fp, CASE WHEN p IN ('1', '2') THEN NULL ELSE layer END AS ly FROM dead0""")
part("susp", "SELECT DISTINCT 'o' || l_orderkey AS block FROM (SELECT l_orderkey, l_suppkey FROM lineitem GROUP BY ALL HAVING count(*) > 1)")
part("call_n", "SELECT 'o' || o_orderkey AS name FROM orders UNION SELECT 's' || s_suppkey FROM supplier")
part("rate", "SELECT (SELECT count(*) FROM susp)::DOUBLE / (SELECT count(*) FROM call_n)::DOUBLE AS r")
part("conf", f"SELECT CASE WHEN {rounded('r', 4)} >= 0.35 THEN 'low' ELSE 'high' END AS confidence FROM rate")

_FLAT = (
    ("filepath", "VARCHAR"), ("lineno", "BIGINT"), ("name", "VARCHAR"), ("class_name", "VARCHAR"), ("layer", "VARCHAR"),
    ("from_layer", "VARCHAR"), ("to_layer", "VARCHAR"), ("cc", "BIGINT"), ("rank", "VARCHAR"), ("parameter_count", "BIGINT"),
    ("mi", "DOUBLE"), ("lcom4", "DOUBLE"), ("instability", "DOUBLE"), ("dep_instability", "DOUBLE"), ("skip_distance", "BIGINT"),
)


def flat(found: DataFrame) -> DataFrame:
    """Event columns side by side, the evidence as its list of sources."""
    return found.select(
        "id", "type", "severity", "strength", "location.*", "metrics.*",
        F.array_join(F.transform("evidence", lambda e: e["source"]), "+").alias("sources"),
    )


def event_sql(kind: str, key: str, severity: str, strength: str, sources: str, source: str, **given: str) -> str:
    strength = strength if "CASE" in strength else f"'{strength}'"
    sources = sources if "||" in sources else f"'{sources}'"
    columns = ", ".join(f"CAST({given.get(n, 'NULL')} AS {t}) AS {n}" for n, t in _FLAT)
    return f"SELECT '{kind}::' || {key} AS id, '{kind}' AS type, {severity} AS severity, {strength} AS strength, {columns}, {sources} AS sources FROM {source}"


# ------------------------------------------------------------ facts and rollups


def functions(f: Facts) -> DataFrame:
    return relations.normal_functions(f.blocks())


def classes(f: Facts) -> DataFrame:
    rows = relations.normal_classes(f.cohesion_rows())
    return rows.withColumn("lcom4_norm", relations.lcom4_normalised(F.col("lcom4")))


def files(f: Facts) -> DataFrame:
    return relations.file_index(functions(f), f.mi_files(), classes(f))


def bound(f: Facts) -> DataFrame:
    return relations.bind_methods(functions(f), classes(f))


@query("q_norm_functions", "SELECT function_id, filepath, name, type, lineno, cc, rank, CAST(NULL AS BIGINT) AS parameter_count FROM fn")
def _(f):
    return functions(f)


@query("q_norm_classes", f"""SELECT class_id, filepath, class_name, lineno, CASE WHEN digit = 4 THEN 'interface' ELSE 'concrete' END AS class_kind,
  lcom4, CASE WHEN lcom4 > 1 THEN {rounded('1.0::DOUBLE / lcom4', 4)} ELSE 1.0 END AS lcom4_norm, digit AS methods_count, excluded FROM cls""")
def _(f):
    return classes(f)


@query("q_file_full_outer", f"""SELECT filepath, max(mi) AS mi, max(mi_rank) AS mi_rank, count(cc) AS function_count,
  {ratio_sql('sum(cc)', 'count(cc)', 2)} AS mean_cc, coalesce(max(cc), 0) AS max_cc,
  count(*) FILTER (cc > 10) AS high_cc_count, CAST(sum(k) AS BIGINT) AS class_count FROM (
  SELECT filepath, cc, NULL AS mi, NULL AS mi_rank, 0 AS k FROM fn UNION ALL SELECT filepath, NULL, mi, rank, 0 FROM mif
  UNION ALL SELECT filepath, NULL, NULL, NULL, 1 FROM cls) GROUP BY filepath""")
def _(f):
    return files(f)


@query("q_file_rollup", f"""SELECT filepath, count(*) AS function_count, {ratio_sql('sum(cc)', 'count(*)', 2)} AS mean_cc, max(cc) AS max_cc,
  count(*) FILTER (cc > 10) AS high_cc_count FROM fn GROUP BY filepath""")
def _(f):
    return relations.file_index(functions(f), f.mi_files(), classes(f)).where("function_count > 0").select(
        "filepath", "function_count", "mean_cc", "max_cc", "high_cc_count"
    )


@query("q_rank_distribution", "SELECT 'cc' AS metric, rank, count(*) AS n FROM fn GROUP BY rank UNION ALL SELECT 'mi', rank, count(*) FROM mif GROUP BY rank")
def _(f):
    cc = summaries.rank_distribution(functions(f)).select(F.lit("cc").alias("metric"), "rank", "n")
    return cc.unionByName(summaries.rank_distribution(f.mi_files()).select(F.lit("mi").alias("metric"), "rank", "n"))


@query("q_cc_summary", f"SELECT count(*) AS total_items, {ratio_sql('sum(cc)', 'count(*)', 2)} AS mean_cc, count(*) FILTER (cc > 10) AS high_complexity_count FROM fn")
def _(f):
    return summaries.complexity_summary(functions(f))


@query("q_mi_summary", f"""SELECT count(*) AS total_files, {ratio_sql('sum(CAST(mi AS DECIMAL(20,2)))', 'count(*)', 2)} AS mean_mi,
  count(*) FILTER (rank = 'C') AS low_mi_count FROM mif""")
def _(f):
    return summaries.maintainability_summary(f.mi_files())


@query("q_cohesion_summary", f"""SELECT count(*) AS total_classes_analyzed, count(*) FILTER (NOT excluded) AS concrete_classes_count,
  {ratio_sql('sum(digit) FILTER (NOT excluded)', 'count(*) FILTER (NOT excluded)', 2)} AS mean_lcom4_all,
  {ratio_sql('sum(digit) FILTER (NOT excluded AND digit >= 2)', 'count(*) FILTER (NOT excluded AND digit >= 2)', 2)} AS mean_lcom4_multi_method,
  count(*) FILTER (NOT excluded AND digit >= 2) AS analyzed_classes_count, count(*) FILTER (NOT excluded AND digit > 1) AS low_cohesion_count,
  count(*) FILTER (excluded AND digit > 1) AS low_cohesion_excluded_count, 1::BIGINT AS low_cohesion_threshold FROM cls""")
def _(f):
    return summaries.cohesion_summary(classes(f))


@query("q_excluded_offenders", "SELECT class_name, filepath, lineno, lcom4, 'interface' AS class_kind FROM cls WHERE excluded AND lcom4 > 1")
def _(f):
    return summaries.excluded_offenders(classes(f))


@query("q_param_count", """SELECT function_id, parameter_count FROM fn LEFT JOIN
  (SELECT l_orderkey, max(l_linenumber)::BIGINT AS parameter_count FROM lineitem WHERE l_orderkey <> 0 GROUP BY 1) ON l_orderkey = lineno""")
def _(f):
    counts = f.table("lineitem").join(f.orders(), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "filepath", F.col("l_orderkey").alias("lineno"), F.col("l_linenumber").cast("long").alias("parameter_count"), F.col("l_linenumber").alias("seq")
    )
    return relations.attach_parameter_counts(functions(f), counts).select("function_id", "parameter_count")


@query("q_asof_method_class", "SELECT function_id, class_id FROM bnd")
def _(f):
    return bound(f)


@query("q_asof_events", """SELECT p.event_id AS point_id, s.event_id AS start_id FROM (SELECT * FROM events WHERE event_type = 'error') p
  ASOF JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts""")
def _(f):
    from codestrata.operators.ordered import as_of

    # Microseconds from the parts, so that no session time zone shifts them.
    day = F.date_diff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.extract(F.lit("SECOND"), "ts") * 1_000_000).cast("long")
    rows = f.table("events").withColumn("at", ((day * 24 + F.hour("ts")) * 60 + F.minute("ts")) * 60_000_000 + second)
    points = rows.where("event_type = 'error'").select(F.col("event_id").alias("point_id"), "user_id", "at")
    starts = rows.where("event_type = 'signup'").select(F.col("event_id").alias("start_id"), "user_id", "at")
    hour = 3_600_000_000
    return as_of(points, starts, ["user_id"], "at", ["start_id"], ["start_id"], hour).select("point_id", "start_id")


@query("q_next_class_start", """SELECT class_id, lead(lineno) OVER (PARTITION BY filepath ORDER BY lineno) AS next_start FROM cls""")
def _(f):
    return relations.next_starts(classes(f)).select("class_id", "next_start")


@query("q_cross_functions", """SELECT f.function_id, b.class_id, m.mi AS file_mi, c.lcom4 AS class_lcom4 FROM fn f
  LEFT JOIN bnd b USING (function_id) LEFT JOIN mif m USING (filepath) LEFT JOIN cls c ON c.class_id = b.class_id""")
def _(f):
    return relations.cross_functions(functions(f), bound(f), classes(f), files(f)).select("function_id", "class_id", "file_mi", "class_lcom4")


part("ccc", f"SELECT class_id, max(cc) AS mx, {ratio_sql('sum(cc)', 'count(*)', 2)} AS mean FROM bnd JOIN fn USING (function_id) GROUP BY class_id")


@query("q_cross_classes", """SELECT c.class_id, m.mi AS file_mi, x.mx AS max_method_cc, x.mean AS mean_method_cc FROM cls c
  LEFT JOIN mif m USING (filepath) LEFT JOIN ccc x USING (class_id)""")
def _(f):
    return relations.cross_classes(classes(f), relations.method_stats(functions(f), bound(f)), files(f)).select(
        "class_id", "file_mi", "max_method_cc", "mean_method_cc"
    )


# ----------------------------------------------------------------- layer graph

_NAMES = (("core", "small", 0), ("ring", "small.ring", 1), ("hot", "red", 2), ("trap", "sm", 3))
_NAME_SQL = "(VALUES ('core', 'small', 0), ('ring', 'small.ring', 1), ('hot', 'red', 2), ('trap', 'sm', 3)) AS p(layer, prefix, ord)"


def _prefix_query(f: Facts, rule: str) -> DataFrame:
    rules = config_table(f.spark, "layer string, prefix string, ord int", _NAMES)
    modules = f.table("part").select("p_partkey", F.translate("p_name", " ", ".").alias("module"))
    return layers.resolve(modules, "module", rules, rule).select("p_partkey", "module", "layer")


def _prefix_sql(order: str) -> str:
    return f"""SELECT p_partkey, module, layer FROM (SELECT m.*, p.layer, row_number() OVER (PARTITION BY p_partkey ORDER BY {order}) AS r
      FROM (SELECT p_partkey, replace(p_name, ' ', '.') AS module FROM part) m
      LEFT JOIN {_NAME_SQL} ON m.module = p.prefix OR starts_with(m.module, p.prefix || '.')) WHERE r = 1"""


@query("q_prefix_longest", _prefix_sql("length(p.prefix) DESC"))
def _(f):
    return _prefix_query(f, "longest")


@query("q_prefix_first", _prefix_sql("p.ord"))
def _(f):
    return _prefix_query(f, "first")


@query("q_layer_edges", """SELECT DISTINCT 'n' || c_nationkey AS source, CASE WHEN s_acctbal < 0 THEN 'ext' || s_region ELSE 'n' || s_nationkey END AS target
  FROM items WHERE o_orderpriority <> '5-LOW' AND (s_acctbal < 0 OR c_nationkey <> s_nationkey)""")
def _(f):
    return layers.layer_edges(f.imports(), f.prefixes(), f.externals(), "app", ("tests",))


@query("q_ignore_module", """SELECT o_orderpriority = '5-LOW' AS ignored, count(*) AS n FROM items GROUP BY 1""")
def _(f):
    return f.imports().groupBy(is_ignored_module(F.col("importer"), "app", ["tests"]).alias("ignored")).agg(F.count(F.lit(1)).alias("n"))


@query("q_stability", "SELECT layer, ca, ce, instability FROM stab")
def _(f):
    return layers.stability(f.layers(), f.edges())


@query("q_tier_map", """SELECT layer, tier FROM lay UNION ALL SELECT 'ext' || r_regionkey, (SELECT max(tier) + 1 FROM lay) FROM region""")
def _(f):
    return layers.with_external_tier(f.tiers(), f.externals())


@query("q_attach_tier", "SELECT layer, tier = 4 AS is_utility, CASE WHEN tier <> 4 THEN tier END AS tier FROM lay")
def _(f):
    return layers.attach_tier(f.layers().select("layer"), f.tiers(), f.tiers().where("tier = 4")).select("layer", "is_utility", "tier")


def sdp(f: Facts, textbook: bool = False) -> DataFrame:
    edges = f.edges()
    return layers.sdp_violations(edges, layers.stability(f.layers(), edges), f.tiers(), f.exceptions(), TOLERANCE, textbook)


_SDP_COLUMNS = "source AS layer, target AS dependency, 'error' AS severity, i AS instability, d AS dep_instability"


@query("q_sdp", f"SELECT {_SDP_COLUMNS} FROM sdp")
def _(f):
    return sdp(f).select("layer", "dependency", "severity", "instability", "dep_instability")


@query("q_sdp_textbook", f"SELECT {_SDP_COLUMNS} FROM placed WHERE target <> 'n0' AND d > i + {TOLERANCE}::DOUBLE")
def _(f):
    return sdp(f, True).select("layer", "dependency", "severity", "instability", "dep_instability")


def slp(f: Facts) -> DataFrame:
    return layers.slp_violations(f.edges(), f.tiers(), f.interfaces())


@query("q_slp", """SELECT source AS layer, target AS dependency, severity, ts::BIGINT AS tier, tt::BIGINT AS dep_tier, skip::BIGINT AS skip_distance,
  array_to_string(range(ts + 1, tt), ',') AS skipped FROM slp""")
def _(f):
    return slp(f).select("layer", "dependency", "severity", "tier", "dep_tier", "skip_distance", F.array_join(F.col("skipped_tiers").cast("array<string>"), ",").alias("skipped"))


part("reach", "SELECT source, target FROM edges UNION SELECT r.source, e.target FROM reach r JOIN edges e ON e.source = r.target")
part("scc", """SELECT a.source AS node, min(b.target) AS lowest FROM reach a JOIN reach b ON a.source = b.source AND EXISTS
  (SELECT 1 FROM reach z WHERE z.source = b.target AND z.target = a.source) WHERE a.source = a.target GROUP BY 1""")
part("cyc", """SELECT lowest, string_agg(node, '__' ORDER BY node) AS cycle_id, min(node) AS from_layer, max(node) AS to_layer, count(*) AS cycle_size
  FROM scc GROUP BY lowest""")


@query("q_scc_cycles", "SELECT cycle_id, from_layer, to_layer, cycle_size FROM cyc")
def _(f):
    return layers.layer_cycles(f.edges()).select("cycle_id", "from_layer", "to_layer", "cycle_size")


@query("q_import_cycle_events", event_sql("IMPORT_CYCLE", "cycle_id", "'error'", "weak", "import_graph", "cyc", from_layer="from_layer", to_layer="to_layer"))
def _(f):
    return flat(events.import_cycles(layers.layer_cycles(f.edges())))


# Module-level import cycles: a part imports the part whose key is its size, when both have the same brand.
part("pe", """SELECT a.p_partkey AS s, b.p_partkey AS t FROM part a JOIN part b ON b.p_partkey = a.p_size WHERE a.p_partkey <> b.p_partkey""")


@query("q_component_sizes", """WITH RECURSIVE und AS (SELECT s, t FROM pe UNION SELECT t, s FROM pe),
  low AS (SELECT s AS node, s AS c FROM und UNION SELECT u.t, l.c FROM low l JOIN und u ON u.s = l.node WHERE l.c < u.t),
  lab AS (SELECT node, min(c) AS component FROM low GROUP BY node)
  SELECT component, count(*) AS n FROM lab GROUP BY 1""".replace("FROM pe", "FROM (SELECT a.p_partkey AS s, b.p_partkey AS t FROM part a JOIN part b ON b.p_partkey = a.p_size WHERE a.p_partkey <> b.p_partkey)"))
def _(f):
    p = f.table("part")
    edges = p.select(F.col("p_partkey").alias("u"), F.col("p_size").cast("long").alias("v")).join(
        p.select(F.col("p_partkey").alias("v")), "v", "left_semi"
    )
    return graph.connected_components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------- events


def counters(f: Facts) -> DataFrame:
    edges = f.edges()
    rated = layers.stability(f.layers(), edges)
    rules = sdp(f).select("rule", "layer").unionByName(slp(f).select("rule", "layer"))
    return layers.layer_counters(rated, rules, layers.broken_pairs(broken(f)))


def broken(f: Facts) -> DataFrame:
    return layers.resolve_broken_imports(f.contract_rows(), f.prefixes())


def dead(f: Facts) -> DataFrame:
    rate = round(callgraph.collision_rate(f.call_nodes(), f.colliding_calls()), 4)
    placed = relations.place_dead(relations.normal_dead(f.dead_names(), F.lit(rate)), classes(f))
    return layers.resolve(placed, "module", f.prefixes(), "longest").drop("module")


@query("q_layer_counters", "SELECT layer, sdp_n AS sdp_violations, slp_n AS slp_violations, broken_n AS broken_imports FROM cnt")
def _(f):
    return counters(f).select("layer", "sdp_violations", "slp_violations", "broken_imports")


@query("q_high_cc_events", event_sql("HIGH_CC_METHOD", "filepath || '::' || lineno || '::' || name", "CASE WHEN cc > 15 THEN 'error' ELSE 'warning' END", "weak", "radon",
  "fn WHERE cc > 10", filepath="filepath", lineno="lineno", name="name", cc="cc", rank="rank"))
def _(f):
    return flat(events.high_cc(functions(f)))


@query("q_low_mi_events", event_sql("LOW_MI_FILE", "filepath", "CASE WHEN rank = 'C' THEN 'error' ELSE 'warning' END", "weak", "radon",
  "mif WHERE rank IN ('B', 'C')", filepath="filepath", mi="mi", rank="rank"))
def _(f):
    return flat(events.low_mi(f.mi_files().withColumnRenamed("rank", "mi_rank")))


@query("q_low_cohesion_events", event_sql("LOW_COHESION_CLASS", "class_id", "CASE WHEN lcom4 >= 3 THEN 'error' ELSE 'warning' END", "weak", "cohesion",
  "cls WHERE NOT excluded AND lcom4 > 1", filepath="filepath", lineno="lineno", class_name="class_name", lcom4="lcom4"))
def _(f):
    return flat(events.low_cohesion_events(classes(f)))


@query("q_dead_enrich", "SELECT qn AS qualified_name, confidence, fp AS filepath, ly AS layer FROM dead, conf")
def _(f):
    return dead(f).select("qualified_name", "confidence", "filepath", "layer")


@query("q_dead_events", event_sql("DEAD_CODE_NODE", "qn", "CASE WHEN confidence = 'high' THEN 'error' ELSE 'warning' END", "weak", "pyan3",
  "dead, conf", filepath="fp", name="qn", layer="ly"))
def _(f):
    return flat(events.dead_code(dead(f)))


@query("q_dead_risk", event_sql("DEAD_CODE_RISK", "qn", "'error'", "strong", "pyan3+radon", "dead JOIN fn ON fn.filepath = fp AND fn.name = 'f' || k AND p <> '3' WHERE cc > 10",
  filepath="fp", name="qn", layer="ly", cc="cc", rank="rank"))
def _(f):
    return flat(events.dead_risk(dead(f), functions(f)))


@query("q_dead_layer", event_sql("DEAD_LAYER_NODE", "qn", "CASE WHEN confidence = 'high' THEN 'error' ELSE 'warning' END", "strong", "pyan3+import_graph",
  "dead JOIN cnt ON cnt.layer = ly, conf WHERE sdp_n > 0 OR slp_n > 0 OR broken_n > 0", filepath="fp", name="qn", layer="ly", instability="instability"))
def _(f):
    return flat(events.dead_layer(dead(f), counters(f)))


part("top", """SELECT class_id, max_by(cc, cc * 1000000000 - lineno) AS cc, max_by(name, cc * 1000000000 - lineno) AS witness, count(*) AS high FROM bnd JOIN fn USING (function_id)
  WHERE cc > 10 GROUP BY class_id""")


@query("q_overloaded", event_sql("OVERLOADED_CLASS", "class_id", "CASE WHEN lcom4 >= 3 AND cc > 15 THEN 'error' ELSE 'warning' END", "strong", "cohesion+radon",
  "cls JOIN top USING (class_id) WHERE NOT excluded AND lcom4 > 1", filepath="filepath", lineno="lineno", class_name="class_name", lcom4="lcom4", cc="cc"))
def _(f):
    # The event needs no file metrics, so only the method statistics are joined.
    stats = relations.method_stats(functions(f), bound(f))
    return flat(events.overloaded(classes(f).join(stats, "class_id")))


part("wrst", """SELECT layer, max(lcom4) AS lcom4 FROM cls WHERE NOT excluded AND lcom4 > 1 GROUP BY layer""")


@query("q_unstable_layer", event_sql("UNSTABLE_COHESION_LAYER", "layer", "'error'", "strong", "cohesion+import_graph", "cnt JOIN wrst USING (layer) WHERE sdp_n > 0",
  layer="layer", lcom4="lcom4", instability="instability"))
def _(f):
    return flat(events.unstable_layer(counters(f), events.with_layer(classes(f), f.prefixes())))


@query("q_low_mi_layer", event_sql("LOW_MI_VIOLATING_LAYER", "filepath", "CASE WHEN rank = 'C' THEN 'error' ELSE 'warning' END", "strong", "radon+import_linter",
  "mif JOIN cnt USING (layer) WHERE rank IN ('B', 'C') AND broken_n > 0", filepath="filepath", layer="layer", mi="mi", rank="rank"))
def _(f):
    return flat(events.low_mi_layer(events.with_layer(files(f), f.prefixes()), counters(f)))


@query("q_low_cohesion_layer", event_sql("LOW_COHESION_CONTRACT_LAYER", "class_id", "CASE WHEN lcom4 >= 3 THEN 'error' ELSE 'warning' END", "strong", "cohesion+import_linter",
  "cls JOIN cnt USING (layer) WHERE NOT excluded AND lcom4 > 1 AND broken_n > 0", filepath="filepath", lineno="lineno", class_name="class_name", layer="layer", lcom4="lcom4"))
def _(f):
    return flat(events.low_cohesion_layer(events.with_layer(classes(f), f.prefixes()), counters(f)))


def graph_violations(f: Facts) -> DataFrame:
    return as_rule_rows(sdp(f), slp(f))


part("lb", "SELECT from_layer, to_layer, count(*) AS n FROM broken GROUP BY ALL")
part("lm", """SELECT coalesce(l.from_layer, s.source, p.source) AS a, coalesce(l.to_layer, s.target, p.target) AS b, l.n, s.i, s.d, p.skip, p.severity AS ps,
  l.n IS NOT NULL AS hl, s.source IS NOT NULL AS hs, p.source IS NOT NULL AS hp FROM lb l FULL JOIN sdp s ON l.from_layer = s.source AND l.to_layer = s.target
  FULL JOIN slp p ON p.source = coalesce(l.from_layer, s.source) AND p.target = coalesce(l.to_layer, s.target)""")

_MERGE_SQL = " UNION ALL ".join((
    event_sql("LAYER_VIOLATION", "a || '::' || b", "'error'", "CASE WHEN hs OR hp THEN 'strong' ELSE 'weak' END",
              "'import_linter' || CASE WHEN hs THEN '+import_graph' ELSE '' END || CASE WHEN hp THEN '+import_graph' ELSE '' END", "lm WHERE hl",
              from_layer="a", to_layer="b", instability="i", dep_instability="d", skip_distance="skip"),
    event_sql("SDP_VIOLATION", "a || '::' || b", "'error'", "weak", "import_graph", "lm WHERE NOT hl AND hs", from_layer="a", to_layer="b", instability="i", dep_instability="d"),
    event_sql("SLP_VIOLATION", "a || '::' || b", "ps", "weak", "import_graph", "lm WHERE NOT hl AND hp", from_layer="a", to_layer="b", skip_distance="skip"),
))


@query("q_layer_merge", _MERGE_SQL)
def _(f):
    return flat(events.merge_layer_violations(graph_violations(f), layers.broken_pairs(broken(f))))


def order_events(f: Facts) -> DataFrame:
    """Events keyed by supplier, one per line item: many share an id, with a source and severity of their own.

    Copies of an item make the same event again, which the merge unites with the others.
    """
    severity = F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_returnflag") == "A", "warning").otherwise("info")
    source = F.when(F.col("l_linestatus") == "O", "radon").otherwise("cohesion")
    seq = F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 2).otherwise(4) + F.when(
        F.col("l_linestatus") == "O", 0
    ).otherwise(1)
    kind = F.when(F.col("l_linenumber") > 3, "LOW_MI_FILE").otherwise("HIGH_CC_METHOD")
    return f.table("lineitem").select(
        F.concat(kind, F.lit("::"), F.col("l_suppkey")).alias("id"), kind.alias("type"), severity.alias("severity"), F.lit("weak").alias("strength"),
        F.from_json(F.lit("{}"), "filepath string, lineno bigint, name string, class_name string, layer string, from_layer string, to_layer string").alias("location"),
        F.from_json(
            F.lit("{}"), "cc bigint, rank string, parameter_count bigint, mi double, lcom4 double, instability double, dep_instability double, skip_distance bigint"
        ).alias("metrics"),
        F.array(F.struct(source.alias("source"), F.concat(F.lit(""), seq).alias("details"))).alias("evidence"),
        F.struct(F.lit(0).alias("stream"), seq.alias("pos")).alias("seq"),
    )


part("oe", """SELECT CASE WHEN l_linenumber > 3 THEN 'LOW_MI_FILE' ELSE 'HIGH_CC_METHOD' END AS type, l_suppkey, CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS sev,
  CASE WHEN l_linestatus = 'O' THEN 'radon' ELSE 'cohesion' END AS source,
  l_orderkey * 100 + l_linenumber * 10 + CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 2 ELSE 4 END + CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS seq
  FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem)""")
part("os", "SELECT type, l_suppkey, source, min(seq) AS seq FROM oe GROUP BY ALL")
part("om", """SELECT type || '::' || l_suppkey AS id, type, CASE max(sev) WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN count(DISTINCT source) >= 2 THEN 'strong' ELSE 'weak' END AS strength, (SELECT string_agg(os.source || '@' || os.seq, '+' ORDER BY os.seq) FROM os
  WHERE os.type = oe.type AND os.l_suppkey = oe.l_suppkey) AS evidence FROM oe GROUP BY type, l_suppkey""")


@query("q_event_dedup", "SELECT id, type, severity, strength, evidence FROM om")
def _(f):
    return events.merge_duplicates(order_events(f)).select(
        "id", "type", "severity", "strength",
        F.array_join(F.transform("evidence", lambda e: F.concat(e["source"], F.lit("@"), e["details"])), "+").alias("evidence"),
    )


@query("q_strength_counts", """SELECT count(*) AS violations_total, count(*) FILTER (strength = 'strong') AS strong_violations, count(*) FILTER (strength <> 'strong') AS weak_violations FROM om""")
def _(f):
    return summaries.strength_counts(events.merge_duplicates(order_events(f)))


@query("q_event_order", """SELECT id, severity, type FROM om ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, type""")
def _(f):
    return events.in_report_order(events.merge_duplicates(order_events(f))).select("id", "severity", "type")


@query("q_imports_summary", """SELECT (SELECT count(*) FROM orders)::BIGINT AS contracts_checked, (SELECT count(*) FROM orders WHERE o_orderpriority <> '5-LOW') AS broken_contracts,
  (SELECT count(*) FROM sdp) AS sdp_violations, (SELECT count(*) FROM slp) AS slp_violations, (SELECT count(*) FROM cyc) AS import_cycles""")
def _(f):
    ok = F.col("o_orderpriority") == "5-LOW"
    totals = f.table("orders").select(ok.cast("long").alias("kept"), (~ok).cast("long").alias("broken"))
    return summaries.imports_summary(counters(f), totals, layers.layer_cycles(f.edges()))


@query("q_dead_summary", f"""SELECT (SELECT count(*) FROM dead) AS dead_node_count, (SELECT count(*) FROM dead, conf WHERE confidence = 'high') AS high_confidence_dead,
  {rounded('r', 4)} AS collision_rate FROM rate""")
def _(f):
    rate = round(callgraph.collision_rate(f.call_nodes(), f.colliding_calls()), 4)
    return summaries.dead_summary(dead(f), F.lit(rate))


# ------------------------------------------------------------------ call graph

part("le", "SELECT 'o' || l_orderkey AS source, 's' || l_suppkey AS target, count(*) AS n FROM lineitem GROUP BY ALL")


@query("q_suspicious_blocks", "SELECT block FROM susp")
def _(f):
    return f.colliding_calls()


@query("q_edge_dedup", """SELECT source, target, CASE WHEN source IN (SELECT block FROM susp) THEN 'low' ELSE 'high' END AS confidence FROM le""")
def _(f):
    return callgraph.rate_edges(f.calls(), f.colliding_calls(), cascade=False)


@query("q_edge_copies", """SELECT 'o' || l_orderkey AS source, 's' || l_suppkey AS target, CASE WHEN bool_or(l_returnflag = 'N') THEN 'low' ELSE 'high' END AS confidence
  FROM lineitem GROUP BY ALL""")
def _(f):
    rows = f.table("lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("target"),
        F.when(F.col("l_returnflag") == "N", "low").otherwise("high").alias("confidence"),
    )
    return callgraph.lower_copies(rows)


# Suppliers in debt count as suspicious targets.
part("bad", "SELECT block FROM susp UNION SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal < 0")


@query("q_edge_cascade", """SELECT source, target, CASE WHEN source IN (SELECT block FROM bad) OR target IN (SELECT block FROM bad) THEN 'low' ELSE 'high' END AS confidence FROM le""")
def _(f):
    return callgraph.rate_edges(f.calls(), _suspects(f))


def _suspects(f: Facts) -> DataFrame:
    indebted = f.table("supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("block"))
    return f.colliding_calls().union(indebted)


@query("q_edge_totals", """SELECT count(*) AS edge_count, count(*) FILTER (confidence = 'high') AS edge_count_high, count(*) FILTER (confidence = 'low') AS edge_count_low FROM
  (SELECT CASE WHEN source IN (SELECT block FROM bad) OR target IN (SELECT block FROM bad) THEN 'low' ELSE 'high' END AS confidence FROM le)""")
def _(f):
    return callgraph.edge_totals(callgraph.rate_edges(f.calls(), _suspects(f)))


@query("q_node_classes", """SELECT name, CASE WHEN name IN (SELECT target FROM le) THEN 'used' WHEN name IN (SELECT source FROM le) THEN 'root' ELSE 'dead' END AS node_class FROM call_n""")
def _(f):
    return callgraph.classify_nodes(f.call_nodes(), f.calls())


@query("q_collision_rate", f"""SELECT (SELECT count(*) FROM susp) AS suspicious, (SELECT count(*) FROM call_n) AS nodes, {rounded('r', 4)} AS collision_rate,
  CASE WHEN r > 0.35 THEN 'high_collision' ELSE 'ok' END AS status FROM rate""")
def _(f):
    found = callgraph.collisions(f.call_nodes(), f.colliding_calls())
    return found.select("suspicious", "nodes", round_binary(F.col("rate"), 4).alias("collision_rate"), callgraph.collision_status(F.col("rate")).alias("status"))


part("tl", """SELECT substr(o_orderpriority, 3) AS file, o_orderkey * 16 AS pos, CASE WHEN o_orderstatus = 'P' THEN 'WARNING: o' || o_orderkey
  WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'o-' || o_orderkey ELSE 'pkg.o' || o_orderkey END AS head, NULL::VARCHAR AS used FROM orders
  UNION ALL SELECT substr(o_orderpriority, 3), l_orderkey * 16 + l_linenumber, NULL::VARCHAR,
  CASE WHEN l_returnflag = 'N' THEN 'pkg.o' || l_orderkey ELSE 'pkg.s' || l_suppkey END FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
part("tf", """SELECT file, pos, used, last_value(CASE WHEN starts_with(head, 'pkg.') THEN head END IGNORE NULLS) OVER w AS source,
  last_value(CASE WHEN head IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS start,
  last_value(CASE WHEN starts_with(head, 'pkg.') THEN head WHEN head IS NOT NULL THEN '' END IGNORE NULLS) OVER w AS block
  FROM tl WINDOW w AS (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")


@query("q_text_block_parse", """SELECT source, used AS target, count(*) AS n FROM tf WHERE used IS NOT NULL AND source IS NOT NULL AND used <> source GROUP BY ALL""")
def _(f):
    return callgraph.raw_edges(callgraph.parse_blocks(f.call_lines())).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@query("q_text_suspicious", """SELECT DISTINCT block FROM (SELECT file, start, block, used FROM tf WHERE used IS NOT NULL AND block <> '' AND used <> block GROUP BY ALL HAVING count(*) > 1)""")
def _(f):
    return callgraph.suspicious_blocks(callgraph.parse_blocks(f.call_lines()))


part("kl", """SELECT o_orderstatus AS file, o_orderkey * 16 AS pos, CASE WHEN o_orderpriority <> '5-LOW' THEN 'Contract ' || o_orderkey END AS name, NULL::BIGINT AS s, NULL::BIGINT AS o FROM orders
  UNION ALL SELECT o_orderstatus, l_orderkey * 16 + l_linenumber, NULL, l_suppkey, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
part("kf", """SELECT *, last_value(name IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS contract FROM kl""")


@query("q_contract_parse", """SELECT contract AS contract_name, 'app.o' || o AS importer, 'app.s' || s AS imported, count(*) AS n FROM kf WHERE s IS NOT NULL AND contract IS NOT NULL GROUP BY ALL""")
def _(f):
    return contracts.broken_imports(f.contract_lines()).groupBy("contract_name", "importer", "imported").agg(F.count(F.lit(1)).alias("n"))


@query("q_broken_contracts", "SELECT file, name AS contract_name FROM kl WHERE name IS NOT NULL")
def _(f):
    return contracts.broken_contracts(f.contract_lines()).select("file", "contract_name")


@query("q_contract_stats", """SELECT 'c' || c_custkey AS file, CASE WHEN c_acctbal >= 0 THEN c_nationkey WHEN c_nationkey < 12 THEN 1 ELSE 0 END::BIGINT AS kept,
  CASE WHEN c_acctbal >= 0 THEN 2 * c_nationkey WHEN c_nationkey < 12 THEN 0 ELSE 1 END::BIGINT AS broken FROM customer""")
def _(f):
    rows = f.table("customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("file"), "c_acctbal", "c_nationkey")
    text = F.concat(F.lit("Contracts: "), F.col("c_nationkey"), F.lit(" kept, "), F.col("c_nationkey") * 2, F.lit(" broken."))
    lines = rows.select("file", F.lit(1).alias("pos"), F.when(F.col("c_acctbal") >= 0, text).otherwise("no totals").alias("text"))
    return contracts.contract_totals(lines, rows.select("file", (F.col("c_nationkey") < 12).alias("passed")))


# ------------------------------------------------------------------ predicates


@query("q_exclude_path", """SELECT page_id, regexp_matches(lower(replace(url, chr(92), '/')),
  'tests/|test_|_test\\.py|conftest\\.py|migrations/|__pycache__/|\\.venv/|venv/|node_modules/|setup\\.py|manage\\.py|config\\.py|settings\\.py|conf\\.py') AS excluded FROM pages""")
def _(f):
    return f.table("pages").select("page_id", is_excluded_path(F.col("url")).alias("excluded"))


@query("q_exclude_fragments", "SELECT page_id, contains(lower(url), 'example.com') OR contains(lower(url), '/en') AS excluded FROM pages")
def _(f):
    return f.table("pages").select("page_id", is_excluded_path(F.col("url"), ["Example.com", "\\en"]).alias("excluded"))


@query("q_path_to_module", "SELECT c_custkey, module FROM cust")
def _(f):
    return f.customers().select("c_custkey", path_to_module(F.col("filepath")).alias("module"))


# -------------------------------------------------------------------- cohesion

part("oi", "SELECT DISTINCT o_custkey, o_orderkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
part("lk", """SELECT o_custkey, o_orderkey AS a, o_orderkey AS b FROM orders UNION SELECT x.o_custkey, k.a, y.o_orderkey FROM lk k
  JOIN oi x ON x.o_orderkey = k.b JOIN oi y ON y.o_custkey = x.o_custkey AND y.l_suppkey = x.l_suppkey""")


@query("q_lcom4", """SELECT o_custkey AS class_id, count(DISTINCT a) AS methods_count, count(DISTINCT low) AS lcom4 FROM
  (SELECT o_custkey, a, min(b) AS low FROM lk GROUP BY ALL) GROUP BY 1""")
def _(f):
    orders = f.table("orders").select(F.col("o_custkey").alias("class_id"), F.col("o_orderkey").alias("method_id"))
    uses = f.table("lineitem").join(orders, F.col("l_orderkey") == F.col("method_id")).select("class_id", "method_id", F.col("l_suppkey").alias("attr"))
    return cohesion.lcom4(orders, uses)


# ---------------------------------------------------------------- whole report

_EVENT_NAMES = (
    "q_high_cc_events", "q_low_mi_events", "q_low_cohesion_events", "q_dead_events", "q_import_cycle_events", "q_overloaded", "q_dead_risk",
    "q_dead_layer", "q_unstable_layer", "q_low_mi_layer", "q_low_cohesion_layer",
)


def _all_events_sql() -> str:
    texts = [RAW[name] for name in _EVENT_NAMES] + [_MERGE_SQL]
    return " UNION ALL ".join(f"SELECT id, type, severity, strength, sources FROM ({t})" for t in texts)


def report(f: Facts, sections: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    contract_totals = f.table("orders").select(
        (F.col("o_orderpriority") == "5-LOW").cast("long").alias("kept"), (F.col("o_orderpriority") != "5-LOW").cast("long").alias("broken")
    )
    # Dead names are orders without items; all other call nodes have edges.
    calls = f.calls().select("source", "target")
    nodes = f.dead_names().union(calls.select("source")).union(calls.select("target")).distinct()
    return build(
        f.spark,
        Sources(f.blocks(), f.mi_files(), f.cohesion_rows(), f.edges(), f.contract_rows(), contract_totals, nodes, calls, f.colliding_calls()),
        Layering(f.layers().select("layer"), f.prefixes(), f.tiers(), f.interfaces(), f.tiers().where("tier > 90"), f.exceptions(), TOLERANCE),
        sections=sections,
    )


@query("q_report_events", _all_events_sql())
def _(f):
    return report(f)["violations"].select(
        "id", "type", "severity", "strength", F.array_join(F.transform("evidence", lambda e: e["source"]), "+").alias("sources")
    )


@query("q_report_summary", f"""SELECT count(*) AS violations_total, count(*) FILTER (strength = 'strong') AS strong_violations, count(*) FILTER (strength <> 'strong') AS weak_violations FROM ({_all_events_sql()})""")
def _(f):
    return report(f)["summary_violations"]


@query("q_report_layers", "SELECT layer, tier, false AS is_utility, ca, ce, instability, sdp_n AS sdp_violations, slp_n AS slp_violations, broken_n AS broken_imports FROM cnt JOIN lay USING (layer)")
def _(f):
    return report(f, ("layers",))["layers"].select("layer", "tier", "is_utility", "ca", "ce", "instability", "sdp_violations", "slp_violations", "broken_imports")
