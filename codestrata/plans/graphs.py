"""Queries over module graphs that grow with the line items: contracts, their chains, import cycles, calls; metrics of source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.operators import graph, import_contracts, native_metrics, symbols
from codestrata.plans.registry import part, query, rounded
from codestrata.plans.tables import Facts
from codestrata.session import cut_lineage
from codestrata.sources.python_metrics import metric_rows
from codestrata.sources.python_scopes import scope_rows

# Layers are nations in tiers of regions; region 4's nations must be independent; each of region 0's must not reach one outside package.
part("mi_edges", """SELECT DISTINCT CASE WHEN l_returnflag = 'R' THEN 'app.n' || c_nationkey || '.c' || c_custkey WHEN l_returnflag = 'A' THEN 'lib.p' || l_partkey
    WHEN l_linenumber = 1 AND s_suppkey % 3 = 0 THEN 'lib.q' || s_suppkey ELSE 'app.n' || s_nationkey || '.s' || s_suppkey END AS importer,
  CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'app.n' || s_nationkey || '.s' || s_suppkey WHEN l_returnflag = 'R' THEN 'lib.p' || l_partkey
    WHEN l_returnflag = 'A' THEN 'lib.q' || s_suppkey WHEN l_linenumber = 1 AND s_suppkey % 3 = 0 THEN 'app.n' || s_nationkey || '.s' || s_suppkey
    ELSE 'ext' || s_region END AS imported FROM items""")
part("con_pairs", """SELECT 'layers' AS contract, a.layer AS origin, b.layer AS target FROM lay a JOIN lay b ON a.tier > b.tier
  UNION ALL SELECT 'independence', a.layer, b.layer FROM lay a JOIN lay b ON a.tier = 4 AND b.tier = 4 AND a.layer <> b.layer
  UNION ALL SELECT 'forbidden', 'n' || n_nationkey, 'ext' || n_nationkey % 5 FROM nation WHERE n_regionkey = 0""")
part("con_mod", """SELECT c.contract, m.module, m.grp FROM (SELECT DISTINCT module, CASE WHEN module LIKE 'app.%' THEN split_part(module, '.', 2) WHEN module LIKE 'ext%' THEN module END AS grp
    FROM (SELECT importer AS module FROM mi_edges UNION SELECT imported FROM mi_edges)) m
  JOIN (SELECT contract, origin AS grp FROM con_pairs UNION SELECT contract, target FROM con_pairs) c ON c.grp = m.grp""")
part("con_reach", """SELECT contract, grp AS origin, module, 0 AS d FROM con_mod WHERE (contract, grp) IN (SELECT contract, origin FROM con_pairs)
  UNION SELECT r.contract, r.origin, e.imported, r.d + 1 FROM con_reach r JOIN mi_edges e ON e.importer = r.module
  WHERE r.d < 6 AND (r.d = 0 OR r.contract = 'forbidden' OR (r.contract, r.module) NOT IN (SELECT contract, module FROM con_mod))""")
part("con_dist", "SELECT contract, origin, module, min(d) AS d FROM con_reach GROUP BY ALL")
part("con_end", """SELECT contract, origin, target, min(d) AS chain_length, arg_min(module, (d, module)) AS at_end FROM
  (SELECT p.*, r.module, r.d FROM con_pairs p JOIN con_mod m ON m.contract = p.contract AND m.grp = p.target
    JOIN con_dist r ON r.contract = p.contract AND r.origin = p.origin AND r.module = m.module) GROUP BY ALL""")
part("con_walk", """SELECT contract, origin, target, at_end AS cur, chain_length AS d, at_end AS chain FROM con_end
  UNION ALL SELECT w.contract, w.origin, w.target, p.importer, w.d - 1, p.importer || ' -> ' || w.chain FROM con_walk w,
    LATERAL (SELECT min(e.importer) AS importer FROM mi_edges e JOIN con_dist r ON r.module = e.importer AND r.contract = w.contract AND r.origin = w.origin AND r.d = w.d - 1
      WHERE e.imported = w.cur AND (w.d = 1 OR w.contract = 'forbidden' OR NOT EXISTS (SELECT 1 FROM con_mod m WHERE m.contract = w.contract AND m.module = e.importer))) p WHERE w.d > 0""")
part("con_direct", """SELECT p.contract, p.origin, p.target, count(*) AS n FROM mi_edges e JOIN con_mod a ON a.module = e.importer
  JOIN con_mod b ON b.module = e.imported AND b.contract = a.contract JOIN con_pairs p ON p.contract = a.contract AND p.origin = a.grp AND p.target = b.grp GROUP BY ALL""")


def contract_relations(f: Facts) -> tuple[DataFrame, DataFrame, DataFrame]:
    tiers = f.tiers()
    origin, target = tiers.toDF("origin", "a"), tiers.toDF("target", "b")
    layered = origin.where("a > 0").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("a") - 1))).join(target, "b")
    apart = origin.where("a = 4").withColumnRenamed("a", "b").join(target, "b").where("origin <> target")
    outside = F.concat(F.lit("ext"), F.substring("origin", 2, 9).cast("int") % 5)
    named = lambda rows, name: rows.select(F.lit(name).alias("contract"), "origin", "target")
    layered, apart, forbidden = named(layered, "layers"), named(apart, "independence"), named(origin.where("a = 0").withColumn("target", outside), "forbidden")
    pairs = layered.unionByName(apart).unionByName(forbidden)
    used = pairs.select("contract", F.col("origin").alias("grp")).union(pairs.select("contract", "target")).distinct()
    groups = used.withColumn("prefix", F.when(F.col("grp").startswith("ext"), F.col("grp")).otherwise(F.concat(F.lit("app."), "grp")))
    modes = pairs.select("contract").distinct().select("contract", (F.col("contract") == "forbidden").alias("through"), F.lit(False).alias("direct_only"))
    return groups, pairs, modes


def found_breaches(f: Facts) -> DataFrame:
    return import_contracts.breaches(f.module_imports(), *contract_relations(f))


@query("q_contract_chains", """SELECT w.contract, w.origin, w.target, e.chain_length::BIGINT AS chain_length, w.chain, coalesce(x.n, 0) AS direct_imports
  FROM con_walk w JOIN con_end e USING (contract, origin, target) LEFT JOIN con_direct x USING (contract, origin, target) WHERE w.d = 0""")
def _(f):
    return found_breaches(f).withColumn("chain", F.array_join("chain", " -> "))


@query("q_contract_check", """SELECT count(*) FILTER (n = 0) AS kept, count(*) FILTER (n > 0) AS broken FROM
  (SELECT contract, count(e.at_end) AS n FROM (SELECT DISTINCT contract FROM con_pairs) LEFT JOIN con_end e USING (contract) GROUP BY contract)""")
def _(f):
    order = contract_relations(f)[2].select("contract", F.lit(0).alias("seq"))
    return import_contracts.totals(found_breaches(f), order)


# Modules are the lines of an order, each importing the next. Filled orders import back to their first
# line, orders import their customer's next order, and every fifth customer closes the ring of orders.
part("line_mod", "SELECT DISTINCT l_orderkey, o_custkey, o_orderstatus, 'o' || l_orderkey || '.l' || l_linenumber AS node FROM lineitem JOIN orders ON l_orderkey = o_orderkey")


def line_imports(f: Facts) -> DataFrame:
    node = F.concat(F.lit("o"), F.col("l_orderkey"), F.lit(".l"), F.col("line"))
    lines = f.table("lineitem").select("l_orderkey", F.col("l_linenumber").alias("line")).distinct()
    following = F.lead("line").over(Window.partitionBy("l_orderkey").orderBy("line"))
    inside = lines.withColumn("next", following).where("next is not null").select(node.alias("source"), F.concat(F.lit("o"), F.col("l_orderkey"), F.lit(".l"), F.col("next")).alias("target"))
    ends = lines.groupBy("l_orderkey").agg(F.min_by(node, "line").alias("first"), F.max_by(node, "line").alias("last"))
    orders = cut_lineage(ends.join(f.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "o_custkey", "o_orderstatus", "first", "last"))
    back = orders.where("o_orderstatus = 'F'").select(F.col("last").alias("source"), F.col("first").alias("target"))
    after = orders.withColumn("next", F.lead("first").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    ring = orders.where("o_custkey % 5 = 0").groupBy("o_custkey").agg(F.max_by("last", "o_orderkey").alias("source"), F.min_by("first", "o_orderkey").alias("target"))
    onward = after.where("next is not null").select(F.col("last").alias("source"), F.col("next").alias("target"))
    return inside.unionByName(back).unionByName(onward).unionByName(ring.select("source", "target"))


@query("q_module_cycles", """SELECT component, n FROM (
  SELECT max(node) AS component, count(*) AS n FROM line_mod WHERE o_custkey % 5 = 0 GROUP BY o_custkey
  UNION ALL SELECT max(node), count(*) FROM line_mod WHERE o_custkey % 5 <> 0 AND o_orderstatus = 'F' GROUP BY l_orderkey) WHERE n > 1""")
def _(f):
    return graph.strong_components(line_imports(f)).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def linked_modules(f: Facts) -> DataFrame:
    """One module per part that calls, extends and renames what the module an eighth of the way down defines."""
    k = F.col("p_partkey")
    q = F.floor(k / 8)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    root = F.array(
        text("class K", k, ":"), F.lit("    def base(self): return self"), text("def f", k, "(x): return x"), text("def use", k, "(x): return x.run()"),
    )
    deep = F.array(
        text("import src.u", q, " as up"), text("from src.u", q, " import f", q, " as g"), F.lit("h = g"), text("class K", k, "(up.K", q, "):"),
        text("    def own", k, "(self): return self.base()"), F.lit("    def run(self): pass"), text("def f", k, "(x): return h(x)"),
        text("def use", k, "(x):"), text("    y = K", k, "()"), text("    return y.own", k, "(), x.run(), x.own", k, "()"),
    )
    return f.table("part").select(text("src/u", k, ".py").alias("path"), F.array_join(F.when(k == 0, root).otherwise(deep), "\n").alias("source"))


@query("q_native_calls", """SELECT source, target, confidence FROM (SELECT p_partkey AS k, p_partkey // 8 AS q, 'src.u' || p_partkey AS m FROM part), LATERAL (
  SELECT m || '.K' || k AS source, 'src.u' || q || '.K' || q AS target, 'high' AS confidence WHERE k > 0
  UNION ALL SELECT m || '.K' || k || '.own' || k, 'src.u0.K0.base', 'high' WHERE k > 0
  UNION ALL SELECT m, 'src.u' || q || '.f' || q, 'high' WHERE k > 0 UNION ALL SELECT m || '.f' || k, 'src.u' || q || '.f' || q, 'high' WHERE k > 0
  UNION ALL SELECT m || '.use' || k, m || '.K' || k, 'high' WHERE k > 0 UNION ALL SELECT m || '.use' || k, m || '.K' || k || '.own' || k, 'high' WHERE k > 0
  UNION ALL SELECT m || '.use' || k, '*.run', 'low')""")
def _(f):
    return symbols.call_graph(cut_lineage(scope_rows(linked_modules(f).repartition(f.spark.sparkContext.defaultParallelism * 2, "path"))))[1]


def measured_modules(f: Facts) -> DataFrame:
    """One module per part whose size decides its comments, sums and branches, with a closure in every other one."""
    k, s = F.col("p_partkey"), F.col("p_size")
    many = lambda n, fn: F.when(n > 0, F.transform(F.sequence(F.lit(1), n), fn)).otherwise(F.array().cast("array<string>"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    sums, tests = F.floor(s / 5).cast("int") + 1, F.floor(s / 8).cast("int")
    lines = F.concat(
        many(s % 7, lambda i: F.lit("# note")), many(s % 3, lambda i: F.lit("")), F.array(F.lit("def f(a, b=1, *rest, key):")),
        many(sums, lambda i: text("    x", i, " = a + ", i - 1)),
        F.flatten(F.transform(F.filter(F.sequence(F.lit(0), tests), lambda j: j < tests), lambda j: F.array(text("    if a > ", j, ":"), F.lit("        b = b - 1")))),
        F.when(k % 2 == 0, F.array(F.lit("    def g(): return [y for y in rest if y]"))).otherwise(F.array().cast("array<string>")),
        F.array(F.lit("    return b"), F.lit("class K:"), F.lit("    def m(self): return self or 0")),
    )
    return f.table("part").select(text("src/m", k, ".py").alias("path"), F.array_join(lines, "\n").alias("source"))


def measured_rows(f: Facts) -> DataFrame:
    return metric_rows(measured_modules(f).repartition(f.spark.sparkContext.defaultParallelism * 2, "path"))


# Sums n, tests m, comments c; g says whether the closure is there.
part("met", "SELECT 'src/m' || p_partkey || '.py' AS filepath, p_size // 5 + 1 AS n, p_size // 8 AS m, p_size % 7 AS c, (p_partkey % 2 = 0)::INT AS g, p_size % 7 + p_size % 3 AS above FROM part")
part("hal", """SELECT *, 3.0::DOUBLE * (n + 2 * m + 1) AS len, 1 + 2 * (m > 0)::INT + 1 + 1 + (m > 0)::INT + CASE WHEN m > 0 THEN greatest(n, m, 2) ELSE n END + 1 AS words,
  (n + 2 * m + 2 + 3 + 2 * g)::DOUBLE AS logical, (n + 2 * m + 4 + g)::DOUBLE AS code, 1 + m + 2 * g + 2 AS cc FROM met""")
part("mi_n", """SELECT filepath, greatest(0.0::DOUBLE, least(100.0::DOUBLE, (171.0::DOUBLE - 5.2::DOUBLE * ln(len * log2(words::DOUBLE)) - 0.23::DOUBLE * cc - 16.2::DOUBLE * ln(logical)
  + 50.0::DOUBLE * sin(sqrt(2.46::DOUBLE * radians(c / code * 100.0::DOUBLE)))) * 100.0::DOUBLE / 171.0::DOUBLE)) AS x FROM hal""")


@query("q_native_complexity", """SELECT filepath, 'f' AS name, 'function' AS type, (1 + m + 2 * g)::BIGINT AS complexity,
    CASE WHEN 1 + m + 2 * g <= 5 THEN 'A' WHEN 1 + m + 2 * g <= 10 THEN 'B' ELSE 'C' END AS rank, (above + 1)::BIGINT AS lineno, 4::BIGINT AS parameter_count, NULL::VARCHAR AS class_name FROM met
  UNION ALL SELECT filepath, 'm', 'method', 2, 'A', above + n + 2 * m + g + 4, 1, 'K' FROM met""")
def _(f):
    return native_metrics.complexity_blocks(measured_rows(f))


@query("q_native_maintainability", f"""SELECT filepath, mi, CASE WHEN mi > 19 THEN 'A' WHEN mi > 9 THEN 'B' ELSE 'C' END AS rank FROM (SELECT filepath, {rounded('x', 2)} AS mi FROM mi_n)""")
def _(f):
    return native_metrics.maintainability_files(measured_rows(f))
