"""Queries over Python text that Spark writes from the ``part`` table.

Each part becomes one module with one class. Its type decides the kind of class,
its size the number of branches, cases or methods, its key an eighth of the way
down the key range the parent class. Facts read back from the text can therefore
be predicted from the columns, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.operators import classfacts as cf
from codestrata.operators import heuristics as h
from codestrata.plans.registry import part, query, rounded
from codestrata.plans.tables import Facts
from codestrata.session import cut_lineage
from codestrata.sources import sinks
from codestrata.sources.python_syntax import stored_syntax_rows


def _lines(*parts) -> Column:
    return F.array_join(F.array_compact(F.flatten(F.array(*[p if isinstance(p, Column) else F.array(F.lit(p)) for p in parts]))), "\n")


def _line(*parts, when=None):
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.array(text if when is None else F.when(when, text))


def modules(f: Facts, spread: bool = False) -> DataFrame:
    """``(path, source)``: one module per part. With ``spread`` the parts are dealt out before sources are written from them."""
    k, s, kind = F.col("p_partkey"), F.col("p_size"), F.col("p_type")
    q = F.floor(k / 8)
    odd_brand = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    parent = F.when(k == 0, "object").otherwise(F.concat(F.lit("C"), q))
    branches = F.floor(s / 8).cast("int")
    count = F.floor(s / 10).cast("int") + 1
    is_ = {name: kind == name for name in ("STANDARD", "LARGE", "MEDIUM", "SMALL", "ECONOMY", "PROMO")}

    def repeated(n, fn):
        return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), fn))).otherwise(F.array().cast("array<string>"))

    head = [
        _line("import pkg", s, ".core as core"), _line("from lib import ", F.split("p_name", " ")[0]), _line("from src.standard import c", q),
    ]
    standard = _lines(
        *head, "", _line("class C", k, "(", parent, "):"), '    """Doc."""', "", "    def __init__(self, seed=0):",
        F.array(F.when(s % 2 == 0, "        super().__init__()").otherwise("        pass")), _line("        self.a", k, " = ", s), "",
        _line("    def run(self, x: ", parent, "):"), _line("        if isinstance(x, C", k, "):", when=s > 20),
        _line("            return self.a", k, when=s > 20), _line("        self.a", k, " = x", when=s <= 20),
        F.array(F.when(s > 30, F.lit('        raise NotImplementedError("no")')).otherwise(F.concat(F.lit("        return self.a"), q))), "",
        "    def step(self):", _line("        return self.a", q),
    )
    large = _lines(
        *head, "from dataclasses import dataclass", "", "@dataclass", _line("class C", k, "(", parent, "):"), _line("    a", k, ": int = ", s), "",
        "    def run(self):", _line("        return self.a", k), "", "    def step(self):",
        F.array(F.when(s <= 10, "        pass").otherwise("        return self.run()")),
    )
    medium = _lines(
        *head, "from abc import ABC, abstractmethod", "", _line("class C", k, "(ABC):"), "    @abstractmethod", "    def run(self): ...", "",
        _line("    @abstractmethod", when=s % 2 == 0), "    def step(self):", "        pass",
    )
    small = _lines(
        *head, "", _line("class C", k, ":"), "    def run(self, x):",
        repeated(branches, lambda i: F.array(
            F.concat(F.when(i == 0, "        if").otherwise("        elif"), F.lit(" isinstance(x, A"), i, F.lit("):")), F.concat(F.lit("            return "), i)
        )), "        return -1",
    )
    economy = _lines(
        *head, "from pydantic import BaseModel as BM", "", F.array(F.when(odd_brand > 12, F.concat(F.lit("class C"), k, F.lit("(BM):"))).otherwise(F.concat(F.lit("class C"), k, F.lit(":")))),
        "    def run(self, x):", "        match x:",
        repeated(branches, lambda i: F.array(F.concat(F.lit("            case A"), i, F.lit("():")), F.concat(F.lit("                return "), i))),
        "            case _:", "                return -1",
    )
    linked = (odd_brand % 2 == 1)
    promo = _lines(
        *head, "", _line("class C", k, ":"), "    def __init__(self):", repeated(count, lambda i: F.array(F.concat(F.lit("        self.b"), i, F.lit(" = 0")))), "",
        repeated(count, lambda i: F.array(
            F.concat(F.lit("    def m"), i, F.lit("(self):")),
            F.concat(F.lit("        return self.b"), i, F.when(linked & (i + 1 < count), F.concat(F.lit(" + self.m"), i + 1, F.lit("()"))).otherwise("")), F.lit(""),
        )), "    @property", "    def size(self):", "        return self.b0",
    )
    source = F.lit(None).cast("string")
    for name, text in (("STANDARD", standard), ("LARGE", large), ("MEDIUM", medium), ("SMALL", small), ("ECONOMY", economy), ("PROMO", promo)):
        source = F.when(is_[name], text).otherwise(source)
    folder = F.when(F.col("p_brand") == "Brand#25", "tests/").otherwise("src/")
    part = f.table("part")
    if spread:
        part = part.repartition(f.spark.sparkContext.defaultParallelism * 2, "p_partkey")
    return part.select(F.concat(folder, F.lower(kind), F.lit("/c"), k, F.lit(".py")).alias("path"), source.alias("source"))


class Corpus:
    """Syntax rows and the facts built on them; parsed once, written once, read by every step."""

    def __init__(self, f: Facts, kinds: tuple[str, ...] | None = None, texts: bool = True):
        self.files = modules(f, spread=True)
        self.rows = stored_syntax_rows(self.files, kinds=kinds, texts=texts)
        self.methods = cf.method_facts(self.rows)
        self.classes = cf.class_facts(self.rows, self.methods)
        self.project = cf.project_classes(self.classes)

    def settle(self) -> Corpus:
        """Write methods and classes for a query that reads them many times."""
        self.methods = cut_lineage(self.methods)
        self.classes = cut_lineage(cf.class_facts(self.rows, self.methods))
        self.project = cut_lineage(cf.project_classes(self.classes))
        return self

    def findings(self) -> DataFrame:
        return h.findings(self.rows, self.project, self.methods)


part("cq", """SELECT p_partkey AS k, p_size AS s, p_type AS t, p_partkey // 8 AS q, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) AS bn, p_brand,
  split_part(p_name, ' ', 1) AS w, CASE WHEN p_brand = 'Brand#25' THEN 'tests/' ELSE 'src/' END || lower(p_type) || '/c' || p_partkey || '.py' AS path,
  'C' || p_partkey AS class_name, CASE WHEN p_partkey = 0 THEN 'object' ELSE 'C' || (p_partkey // 8) END AS parent FROM part""")
part("cp", "SELECT c.*, p.t AS pt, p.s AS ps FROM cq c LEFT JOIN cq p ON p.k = c.q AND c.k > 0")
part("mm", """SELECT *, m.name AS mn FROM cp, LATERAL (
  SELECT '__init__' AS name, 1 AS cc, false AS empty, false AS prop, false AS abs, 'self, seed' AS sig WHERE t = 'STANDARD'
  UNION ALL SELECT 'run', CASE WHEN s > 20 THEN 2 ELSE 1 END, false, false, false, 'self, x: ' || parent WHERE t = 'STANDARD'
  UNION ALL SELECT 'step', 1, false, false, false, 'self' WHERE t = 'STANDARD'
  UNION ALL SELECT 'run', 1, false, false, false, 'self' WHERE t = 'LARGE' UNION ALL SELECT 'step', 1, s <= 10, false, false, 'self' WHERE t = 'LARGE'
  UNION ALL SELECT 'run', 1, true, false, true, 'self' WHERE t = 'MEDIUM' UNION ALL SELECT 'step', 1, true, false, s % 2 = 0, 'self' WHERE t = 'MEDIUM'
  UNION ALL SELECT 'run', 1 + s // 8, false, false, false, 'self, x' WHERE t = 'SMALL' UNION ALL SELECT 'run', 1, false, false, false, 'self, x' WHERE t = 'ECONOMY'
  UNION ALL SELECT '__init__', 1, false, false, false, 'self' WHERE t = 'PROMO' UNION ALL SELECT 'size', 1, false, true, false, 'self' WHERE t = 'PROMO'
  UNION ALL SELECT 'm' || g.i, 1, false, false, false, 'self' FROM range(s // 10 + 1) g(i) WHERE t = 'PROMO') m""")
part("kd", """SELECT *, CASE t WHEN 'LARGE' THEN 'dataclass' WHEN 'MEDIUM' THEN CASE WHEN s % 2 = 0 THEN 'interface' ELSE 'abstract' END ELSE 'concrete' END AS class_kind,
  CASE WHEN t = 'MEDIUM' THEN 'PURE_INTERFACE' WHEN t = 'ECONOMY' AND bn > 12 THEN 'INFRA_MODEL' ELSE 'DOMAIN' END AS class_role FROM cp""")
part("lc", """SELECT *, CASE t WHEN 'STANDARD' THEN 2 WHEN 'LARGE' THEN CASE WHEN s <= 10 THEN 1 ELSE 2 END WHEN 'MEDIUM' THEN 0 WHEN 'PROMO' THEN s // 10 + 1 ELSE 1 END AS mc,
  CASE t WHEN 'STANDARD' THEN CASE WHEN k = 0 OR (s <= 30 AND pt = 'STANDARD') THEN 1 ELSE 2 END WHEN 'PROMO' THEN CASE WHEN bn % 2 = 1 THEN 1 ELSE s // 10 + 1 END ELSE 1 END AS lc FROM kd""")
part("up", """SELECT k, q AS a FROM cp WHERE t IN ('STANDARD', 'LARGE') AND k > 0 UNION SELECT u.k, c.q FROM up u JOIN cp c ON c.k = u.a WHERE c.t IN ('STANDARD', 'LARGE') AND c.k > 0""")
part("hit", """SELECT path, class_name, k, 'run' AS method_name, 'LSP-H-001' AS rule FROM cp WHERE t = 'STANDARD' AND s > 30 AND k > 0 AND pt <> 'PROMO'
  UNION ALL SELECT path, class_name, k, 'step', 'LSP-H-002' FROM cp WHERE t = 'LARGE' AND s <= 10 AND k > 0 AND pt IN ('STANDARD', 'LARGE', 'MEDIUM')
  UNION ALL SELECT path, class_name, k, 'run', 'LSP-H-003' FROM cp WHERE t = 'STANDARD' AND s > 20 AND k > 0
  UNION ALL SELECT path, class_name, k, '__init__', 'LSP-H-004' FROM cp WHERE t = 'STANDARD' AND s % 2 = 1 AND k > 0 AND pt <> 'MEDIUM'
  UNION ALL SELECT path, class_name, k, 'run', 'OCP-H-001' FROM cp WHERE t = 'SMALL' AND s // 8 >= 3
  UNION ALL SELECT path, class_name, k, 'run', 'OCP-H-002' FROM cp WHERE t = 'ECONOMY' AND s // 8 >= 3 AND bn <= 12
  UNION ALL SELECT path, class_name, k, 'run', 'OCP-H-004' FROM cp WHERE t = 'SMALL' AND s // 8 >= 4""")
part("fnd", "SELECT * FROM hit WHERE NOT starts_with(path, 'tests/')")


@query("q_ast_classes", """SELECT path, class_name, CAST(CASE t WHEN 'LARGE' THEN 7 WHEN 'MEDIUM' THEN 6 WHEN 'ECONOMY' THEN 6 ELSE 5 END AS BIGINT) AS lineno,
  CASE t WHEN 'ECONOMY' THEN CASE WHEN bn > 12 THEN 'BM' ELSE '' END WHEN 'MEDIUM' THEN 'ABC' WHEN 'STANDARD' THEN parent WHEN 'LARGE' THEN parent ELSE '' END AS bases FROM cp""")
def _(f):
    return Corpus(f).classes.select("path", "class_name", "lineno", F.array_join("bases", ",").alias("bases"))


@query("q_class_kind", "SELECT class_name, class_kind FROM kd")
def _(f):
    return Corpus(f).classes.select("class_name", "class_kind")


@query("q_class_role", "SELECT class_name, class_role FROM kd")
def _(f):
    return Corpus(f).classes.select("class_name", "class_role")


@query("q_infra_score", "SELECT class_name, CASE WHEN t = 'LARGE' THEN 1 WHEN t = 'ECONOMY' AND bn > 12 THEN 2 ELSE 0 END::INT AS infra_score FROM kd")
def _(f):
    return Corpus(f).classes.select("class_name", "infra_score")


@query("q_ast_methods", """SELECT path, mn AS method_name, cc::BIGINT AS cc, empty AS is_empty, prop AS is_property, abs AS is_abstract, len(string_split(sig, ','))::BIGINT AS parameter_count FROM mm""")
def _(f):
    return Corpus(f).methods.select("path", "method_name", "cc", "is_empty", "is_property", "is_abstract", "parameter_count")


@query("q_signatures", "SELECT path, mn AS method_name, sig AS parameters, 'Any' AS return_type FROM mm")
def _(f):
    c = Corpus(f)
    return cf.signatures(c.rows).join(c.methods, cf.METHOD).select("path", "method_name", "parameters", "return_type")


@query("q_top_imports", """SELECT path, 'pkg' || s AS package FROM cp UNION ALL SELECT path, 'lib' FROM cp UNION ALL SELECT path, 'src' FROM cp
  UNION ALL SELECT path, CASE t WHEN 'LARGE' THEN 'dataclasses' WHEN 'MEDIUM' THEN 'abc' ELSE 'pydantic' END FROM cp WHERE t IN ('LARGE', 'MEDIUM', 'ECONOMY')""")
def _(f):
    return cf.top_imports(Corpus(f).rows).select("path", "package")


@query("q_import_aliases", """SELECT path, 'core' AS alias, 'pkg' || s || '.core' AS original FROM cp UNION ALL SELECT path, 'BM', 'BaseModel' FROM cp WHERE t = 'ECONOMY'""")
def _(f):
    return cf.aliases(Corpus(f).rows).select("path", F.col("base").alias("alias"), "original")


@query("q_import_graph", """SELECT DISTINCT replace(replace(c.path, '.py', ''), '/', '.') AS importer, x.m AS imported FROM cp c LEFT JOIN cq p ON p.k = c.q AND p.t = 'STANDARD' AND p.p_brand <> 'Brand#25',
  LATERAL (SELECT 'pkg' || c.s AS m UNION ALL SELECT 'lib' UNION ALL SELECT CASE WHEN p.k IS NOT NULL THEN 'src.standard.c' || p.k ELSE 'src' END
  UNION ALL SELECT CASE c.t WHEN 'LARGE' THEN 'dataclasses' WHEN 'MEDIUM' THEN 'abc' WHEN 'ECONOMY' THEN 'pydantic' END) x
  WHERE x.m IS NOT NULL AND x.m <> replace(replace(c.path, '.py', ''), '/', '.')""")
def _(f):
    return cf.import_graph(Corpus(f).rows)


@query("q_resolve_base", """SELECT class_name, parent AS base, CASE WHEN k > 0 THEN 1 ELSE 0 END::BIGINT AS hits FROM cp WHERE t IN ('STANDARD', 'LARGE')
  UNION ALL SELECT class_name, CASE t WHEN 'MEDIUM' THEN 'ABC' ELSE 'BM' END, 0 FROM cp WHERE t = 'MEDIUM' OR (t = 'ECONOMY' AND bn > 12)""")
def _(f):
    c = Corpus(f)
    asked = cf.bases(c.rows).select(*cf.CLASS, "base")
    found = cf.resolve_base(asked, cf.base_index(c.classes.select(*cf.CLASS, "class_name")))
    return found.join(c.classes.select(*cf.CLASS, "class_name"), cf.CLASS).select("class_name", "base", "hits")


@query("q_ancestors", "SELECT 'C' || k AS class_name, 'C' || a AS ancestor FROM up")
def _(f):
    c = Corpus(f, ("class", "base"))
    name = F.regexp_replace(F.regexp_extract("path", r"/c(\d+)\.py$", 1), "^", "C")
    above = F.regexp_replace(F.regexp_extract("found_path", r"/c(\d+)\.py$", 1), "^", "C")
    return cf.ancestors(c.rows).select(name.alias("class_name"), above.alias("ancestor"))


@query("q_ancestor_attrs", """SELECT c.path, 'a' || p.k AS attr FROM up u JOIN cp c ON c.k = u.k JOIN cp p ON p.k = u.a WHERE p.t = 'STANDARD'
  UNION ALL SELECT c.path, 'b' || g.i FROM up u JOIN cp c ON c.k = u.k JOIN cp p ON p.k = u.a, LATERAL (SELECT i FROM range(p.s // 10 + 1) r(i)) g WHERE p.t = 'PROMO'""")
def _(f):
    c = Corpus(f)
    return cf.inherited_attributes(c.rows, cf.init_attributes(c.rows, c.methods)).select("path", "attr")


@query("q_ast_lcom4", f"""SELECT path AS filepath, class_name AS name, mc::BIGINT AS methods_count, lc::DOUBLE AS cohesion_score,
  CASE WHEN lc > 1 THEN {rounded('1.0::DOUBLE / lc::DOUBLE', 4)} ELSE 1.0 END AS cohesion_score_norm, class_kind, class_kind <> 'concrete' AS excluded_from_aggregation FROM lc WHERE mc > 0""")
def _(f):
    c = Corpus(f).settle()
    return cf.cohesion_rows(c.rows, c.methods, c.classes).select(
        "filepath", "name", "methods_count", "cohesion_score", "cohesion_score_norm", "class_kind", "excluded_from_aggregation"
    )


@query("q_project_map", "SELECT class_name, path, 1::BIGINT AS definitions, t = 'MEDIUM' AS known_interface FROM cp")
def _(f):
    return Corpus(f).project.select("class_name", "path", "definitions", "known_interface")


@query("q_overrides", """SELECT c.class_name, c.mn AS method_name FROM mm c JOIN mm p ON p.k = c.q AND c.k > 0 AND p.mn = c.mn WHERE c.t IN ('STANDARD', 'LARGE')""")
def _(f):
    c = Corpus(f)
    return cf.overrides(c.project, c.methods).join(c.project, cf.CLASS).select("class_name", "method_name")


@query("q_iface_backlink", "SELECT class_name, parent AS interface FROM cp WHERE t IN ('STANDARD', 'LARGE') AND k > 0 AND pt = 'MEDIUM'")
def _(f):
    return cf.interface_links(Corpus(f).project)


def _ruled(f: Facts, *rules: str) -> Corpus:
    return Corpus(f, h.kinds(*(rules or h.RULE_ORDER)), texts=False).settle()


def _rule(name: str):
    code = name[-9:].upper().replace("_", "-")

    @query(name, f"SELECT path, class_name, method_name, rule FROM fnd WHERE rule = '{code}'")
    def _(f):
        return _ruled(f, code).findings().where(F.col("rule") == code).select("path", "class_name", "method_name", "rule")


for _name in ("lsp_h_001", "lsp_h_002", "lsp_h_003", "lsp_h_004", "ocp_h_001", "ocp_h_002", "ocp_h_004"):
    _rule(f"q_heur_{_name}")

part("fm", """SELECT path, class_name, method_name, list(rule ORDER BY CASE rule WHEN 'OCP-H-001' THEN 2 WHEN 'LSP-H-001' THEN 2 WHEN 'OCP-H-004' THEN 1 WHEN 'LSP-H-002' THEN 1 ELSE 0 END DESC) AS rules
  FROM fnd GROUP BY ALL""")


@query("q_finding_dedup", """SELECT path, class_name, method_name, rules[1] AS rule, CASE WHEN len(rules) > 1 THEN 'Also detected: ' || array_to_string(list_sort(rules[2:]), ', ') || '.' ELSE '' END AS note FROM fm""")
def _(f):
    return h.merge_findings(_ruled(f).findings()).select(
        "path", "class_name", "method_name", "rule", F.regexp_extract("explanation", r"(Also detected: .*)$", 1).alias("note")
    )


part("cd", """SELECT c.path, c.class_name, c.k, c.pt, c.t, coalesce(n, 0) AS n, coalesce(o, false) AS o, coalesce(l, false) AS l,
  CASE WHEN c.t IN ('STANDARD', 'LARGE') THEN 1 ELSE 0 END AS depth, CASE WHEN c.t IN ('STANDARD', 'LARGE') AND c.pt = 'MEDIUM' AND c.k > 0 THEN 1 ELSE 0 END AS i
  FROM kd c LEFT JOIN (SELECT path, count(*) AS n, bool_or(starts_with(rule, 'OCP')) AS o, bool_or(starts_with(rule, 'LSP')) AS l FROM fnd GROUP BY 1) x USING (path)
  WHERE NOT starts_with(c.path, 'tests/') AND c.class_role = 'DOMAIN'""")
part("cand", """SELECT *, CASE WHEN o AND l THEN 'both' WHEN l THEN 'lsp' WHEN o THEN 'ocp' WHEN depth > 0 THEN 'both' ELSE 'ocp' END AS candidate_type, (2 * n + depth + i)::BIGINT AS priority
  FROM cd WHERE n > 0 OR depth > 0""")


@query("q_identify_candidates", "SELECT path, class_name, candidate_type, priority, n::INT AS reasons FROM cand")
def _(f):
    c = _ruled(f)
    return h.candidates(c.project, c.findings()).select("path", "class_name", "candidate_type", "priority", F.size("reasons").alias("reasons"))


_HEAD_SQL = "'import pkg' || s || '.core as core' || chr(10) || 'from lib import ' || w || chr(10) || 'from src.standard import c' || q || chr(10)"


def _skeleton_sql() -> str:
    nl = "chr(10)"

    def method(sig: str, body: str = "pass", lead: str = "") -> str:
        return f"{nl} || {nl} || '{lead}    def {sig}:' || {nl} || '        {body}'"

    run_typed = f"{nl} || {nl} || '    def run(self, x: ' || parent || '):' || {nl} || '        pass'"
    marked = f"{nl} || {nl} || '    @abstractmethod' || {nl} || '    def"
    return f"""CASE t
      WHEN 'STANDARD' THEN {_HEAD_SQL} || {nl} || 'class C' || k || '(' || parent || '):' || {nl} || '    \"\"\"Doc.\"\"\"' || {method('__init__(self, seed=0)')} || {run_typed} || {method('step(self)')}
      WHEN 'LARGE' THEN {_HEAD_SQL} || 'from dataclasses import dataclass' || {nl} || {nl} || '@dataclass' || {nl} || 'class C' || k || '(' || parent || '):' || {nl} || '    a' || k || ': int = ' || s || {method('run(self)')} || {method('step(self)')}
      WHEN 'MEDIUM' THEN {_HEAD_SQL} || 'from abc import ABC, abstractmethod' || {nl} || {nl} || 'class C' || k || '(ABC):' || {marked} run(self):' || {nl} || '        pass' || CASE WHEN s % 2 = 0 THEN {marked} step(self):' || {nl} || '        pass' ELSE {method('step(self)')} END
      WHEN 'SMALL' THEN {_HEAD_SQL} || {nl} || 'class C' || k || ':' || {method('run(self, x)')}
      WHEN 'ECONOMY' THEN {_HEAD_SQL} || 'from pydantic import BaseModel as BM' || {nl} || {nl} || 'class C' || k || CASE WHEN bn > 12 THEN '(BM)' ELSE '' END || ':' || {method('run(self, x)')}
      ELSE {_HEAD_SQL} || {nl} || 'class C' || k || ':' || {method('__init__(self)')} || (SELECT string_agg({nl} || {nl} || '    def m' || i || '(self):' || {nl} || '        pass', '' ORDER BY i) FROM range(s // 10 + 1) r(i)) || {nl} || {nl} || '    @property' || {nl} || '    def size(self):' || {nl} || '        pass'
      END"""


@query("q_skeleton", f"SELECT path, {_skeleton_sql()} AS text FROM cp")
def _(f):
    return sinks.skeletons(modules(f), spread=True).select("path", "text")


part("tr", "SELECT DISTINCT string_split(path, '/') AS p FROM cq")
part("te", """SELECT DISTINCT p[:n] AS place, CASE WHEN n = 3 THEN 1 ELSE 0 END AS is_file, array_to_string(p[:n - 1], '/') AS folder, p[n] AS name FROM tr, range(1, 4) g(n)""")
part("tm", """SELECT *, row_number() OVER (PARTITION BY folder ORDER BY is_file DESC, lower(name) DESC, name DESC) = 1 AS is_last FROM te""")


@query("q_tree", """SELECT array_to_string(a.place, '/') AS path, CASE WHEN len(a.place) >= 2 THEN CASE WHEN b.is_last THEN '    ' ELSE chr(9474) || '   ' END ELSE '' END ||
  CASE WHEN len(a.place) >= 3 THEN CASE WHEN c.is_last THEN '    ' ELSE chr(9474) || '   ' END ELSE '' END || CASE WHEN a.is_last THEN chr(9492) ELSE chr(9500) END || chr(9472) || chr(9472) || ' ' || a.name AS line
  FROM tm a LEFT JOIN tm b ON b.place = a.place[:1] AND len(a.place) >= 2 LEFT JOIN tm c ON c.place = a.place[:2] AND len(a.place) >= 3""")
def _(f):
    lines = sinks.tree_lines(modules(f).select("path"))
    return lines.select(F.array_join(F.transform("place", lambda p: p["name"]), "/").alias("path"), "line")
