import json

import pytest
from pyspark.sql import functions as F

from codestrata.operators import events, layers, relations

FUNCTION = "filepath string, name string, type string, complexity long, rank string, lineno long"
CLASS = (
    "filepath string, name string, lineno long, class_kind string, cohesion_score double, cohesion_score_norm double, methods_count long, "
    "excluded_from_aggregation boolean"
)


def functions(spark, *rows):
    return relations.normal_functions(spark.createDataFrame([(p, n, t, c, "A", at) for p, n, t, c, at in rows], FUNCTION))


def classes(spark, *rows):
    return relations.normal_classes(spark.createDataFrame([(p, n, at, "concrete", s, 1.0, 2, x) for p, n, at, s, x in rows], CLASS))


def test_complexity_bounds(spark):
    rows = functions(spark, ("a.py", "x", "function", 16, 1), ("a.py", "y", "function", 11, 2), ("a.py", "z", "function", 10, 3))
    assert {(r.id, r.severity) for r in events.high_cc(rows).collect()} == {("HIGH_CC_METHOD::a.py::1::x", "error"), ("HIGH_CC_METHOD::a.py::2::y", "warning")}


def test_cohesion_bounds(spark):
    rows = classes(spark, ("a.py", "A", 1, 3.0, False), ("a.py", "B", 2, 2.0, False), ("a.py", "C", 3, 1.0, False), ("a.py", "D", 4, 9.0, True), ("a.py", "E", 5, None, False))
    assert {(r.location.class_name, r.severity) for r in events.low_cohesion_events(rows).collect()} == {("A", "error"), ("B", "warning")}


@pytest.mark.parametrize("rate, severity", [(0.0, "error"), (0.3499, "error"), (0.35, "warning"), (0.5, "warning")])
def test_dead_code_confidence(spark, rate, severity):
    dead = relations.normal_dead(spark.createDataFrame([("a.b",)], "name string"), F.lit(rate)).withColumns({"filepath": F.lit("a.py"), "layer": F.lit(None).cast("string")})
    assert events.dead_code(dead).first().severity == severity


def test_methods_bind_to_the_class_above(spark):
    cls = classes(spark, ("a.py", "A", 5, 2.0, False), ("a.py", "B", 20, 2.0, False), ("b.py", "C", 1, 2.0, False))
    fns = functions(spark, ("a.py", "early", "method", 1, 3), ("a.py", "in_a", "method", 1, 19), ("a.py", "at_b", "method", 1, 20), ("a.py", "plain", "function", 1, 30), ("c.py", "alone", "method", 1, 2))
    assert {tuple(r) for r in relations.bind_methods(fns, cls, width=4).collect()} == {("a.py::19::in_a", "a.py::A"), ("a.py::20::at_b", "a.py::B")}


def test_overloaded_class_names_its_first_largest_method(spark):
    cls = classes(spark, ("a.py", "A", 1, 3.0, False), ("a.py", "B", 50, 3.0, False))
    fns = functions(spark, ("a.py", "m", "method", 16, 5), ("a.py", "n", "method", 16, 3), ("a.py", "o", "method", 11, 9), ("a.py", "p", "method", 10, 60))
    stats = relations.method_stats(fns, relations.bind_methods(fns, cls))
    rows = events.overloaded(cls.join(stats, "class_id", "left")).collect()
    assert [(r.location.class_name, r.severity, r.strength) for r in rows] == [("A", "error", "strong")]
    assert json.loads(rows[0].evidence[1].details) == {
        "max_cc_method_name": "n", "max_complexity": 16, "max_cc_method_lineno": 3, "mean_cc_in_class": 14.33, "high_cc_methods_count": 3
    }


def test_dead_names_of_one_to_five_parts(spark):
    cls = classes(spark, ("app/svc/search.py", "Search", 1, 1.0, False))
    names = ["run", "app.run", "app.svc.search.Search.go", "app.svc.search.Other.go", "app.svc.search.go"]
    dead = relations.normal_dead(spark.createDataFrame([(n,) for n in names], "name string"), F.lit(0.0))
    got = {r.qualified_name: r.filepath for r in relations.place_dead(dead, cls).collect()}
    assert got == {
        "run": "run.py", "app.run": "app.py", "app.svc.search.Search.go": "app/svc/search.py", "app.svc.search.Other.go": "app/svc/search/Other.py",
        "app.svc.search.go": "app/svc/search.py",
    }


def test_dead_risk_takes_the_last_function_of_a_name(spark):
    fns = functions(spark, ("a.py", "f", "function", 20, 1), ("a.py", "f", "function", 11, 9))
    dead = spark.createDataFrame([("a.f", "high", "a.py", None)], "qualified_name string, confidence string, filepath string, layer string")
    assert [r.metrics.cc for r in events.dead_risk(dead, fns).collect()] == [11]


def _merge(spark, contract, sdp, slp):
    shape = "rule string, layer string, dependency string, severity string, instability double, dep_instability double, tier long, dep_tier long, skip_distance long, seq long"
    rows = []
    if sdp:
        rows.append(("SDP-001", "a", "b", "error", 0.8, 0.2, None, None, None, 1))
    for i, (distance, severity) in enumerate(slp):
        rows.append(("SLP-001", "a", "b", severity, None, None, 0, distance + 1, distance, 2 + i))
    broken = spark.createDataFrame([("a", "b", "c2", 5), ("a", "b", "c1", 3)] if contract else [], "from_layer string, to_layer string, contract_name string, seq long")
    return sorted(events.merge_layer_violations(spark.createDataFrame(rows, shape), layers.broken_pairs(broken)).collect(), key=lambda r: r.type)


@pytest.mark.parametrize(
    "contract, sdp, slp, want",
    [
        (True, True, [], [("LAYER_VIOLATION", "error", "strong", 2)]),
        (True, False, [(1, "warning")], [("LAYER_VIOLATION", "error", "strong", 2)]),
        (True, True, [(2, "error")], [("LAYER_VIOLATION", "error", "strong", 3)]),
        (True, False, [], [("LAYER_VIOLATION", "error", "weak", 1)]),
        (True, False, [(1, "info")], [("LAYER_VIOLATION", "warning", "strong", 2)]),
        (False, True, [], [("SDP_VIOLATION", "error", "weak", 1)]),
        (False, False, [(1, "warning")], [("SLP_VIOLATION", "warning", "weak", 1)]),
        (False, True, [(1, "warning")], [("SDP_VIOLATION", "error", "weak", 1), ("SLP_VIOLATION", "warning", "weak", 1)]),
    ],
)
def test_layer_merge(spark, contract, sdp, slp, want):
    rows = _merge(spark, contract, sdp, slp)
    assert [(r.type, r.severity, r.strength, len(r.evidence)) for r in rows] == want


def test_layer_merge_keeps_first_contract_and_first_worst_skip(spark):
    row = _merge(spark, True, True, [(1, "warning"), (3, "error"), (3, "warning")])[0]
    assert json.loads(row.evidence[0].details) == {"contract_name": "c1", "broken_imports_count": 2}
    assert json.loads(row.evidence[1].details) == {"rule": "SDP-001", "severity": "error", "instability": 0.8, "dep_instability": 0.2}
    assert json.loads(row.evidence[2].details)["severity"] == "error" and row.metrics.skip_distance == 3


def _event(spark, *rows):
    base = events.high_cc(functions(spark, ("a.py", "x", "function", 16, 1)))
    made = []
    for at, (key, severity, strength, sources) in enumerate(rows):
        proofs = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(f"{s}{at}").alias("details")) for s in sources]) if sources else F.col("evidence")
        made.append(base.withColumns({"id": F.lit(key), "severity": F.lit(severity), "strength": F.lit(strength), "evidence": proofs, "seq": F.struct(F.lit(0).alias("stream"), F.lit(at).cast("long").alias("pos"))}))
    return {r.id: r for r in events.merge_duplicates(events.concat_events(made)).collect()}


def test_duplicates_merge(spark):
    got = _event(
        spark, ("k", "warning", "weak", ["radon"]), ("k", "error", "weak", ["radon"]), ("k", "info", "weak", ["cohesion", "pyan3"]),
        ("same", "info", "weak", ["radon"]), ("same", "info", "weak", ["radon"]), ("lone", "warning", "weak", ["import_linter", "import_graph", "import_graph"]),
    )
    assert (got["k"].severity, got["k"].strength) == ("error", "strong")
    assert [(e.source, e.details) for e in got["k"].evidence] == [("radon", "radon0"), ("cohesion", "cohesion2"), ("pyan3", "pyan32")]
    assert (got["same"].severity, got["same"].strength, len(got["same"].evidence)) == ("info", "weak", 1)
    # An event of its own keeps its strength and its repeated sources.
    assert (got["lone"].strength, len(got["lone"].evidence)) == ("weak", 3)


def test_order_is_severity_then_type(spark):
    rows = functions(spark, ("a.py", "x", "function", 11, 1), ("a.py", "y", "function", 20, 2))
    cls = classes(spark, ("a.py", "A", 1, 5.0, False))
    both = events.merge_duplicates(events.high_cc(rows).unionByName(events.low_cohesion_events(cls)))
    assert [(r.severity, r.type) for r in events.in_report_order(both).collect()] == [
        ("error", "HIGH_CC_METHOD"), ("error", "LOW_COHESION_CLASS"), ("warning", "HIGH_CC_METHOD")
    ]


def test_file_index_unites_all_sources(spark):
    fns = functions(spark, ("a.py", "x", "function", 11, 1), ("a.py", "y", "function", 4, 2))
    cls = classes(spark, ("c.py", "A", 1, 5.0, False))
    mi = spark.createDataFrame([("b.py", 8.5, "C"), ("a.py", 50.0, "A")], "filepath string, mi double, rank string")
    got = {r.filepath: tuple(r)[1:] for r in relations.file_index(fns, mi, cls).collect()}
    assert got == {"a.py": (50.0, "A", 2, 7.5, 11, 1, 0), "b.py": (8.5, "C", 0, 0.0, 0, 0, 0), "c.py": (None, None, 0, 0.0, 0, 0, 1)}


def test_merge_sorts_only_events_at_a_least_place(spark, monkeypatch):
    """Of 20,000 events of ten ids the merge carries whole only those that supply fields or evidence."""
    written = []
    monkeypatch.setattr(events, "cut_lineage", lambda df: written.append(df) or df, raising=False)
    kind = F.when(F.col("id") % 3 == 0, "radon").otherwise("cohesion")
    rows = spark.range(20_000).select(
        F.concat(F.lit("e"), F.col("id") % 10).alias("id"), F.lit("T").alias("type"), F.when(F.col("id") == 19_999, "error").otherwise("info").alias("severity"), F.lit("weak").alias("strength"),
        F.struct(F.lit("x").alias("filepath")).alias("location"), F.struct("id").alias("metrics"), F.array(F.struct(kind.alias("source"), F.col("id").cast("string").alias("details"))).alias("evidence"),
        F.struct((F.col("id") % 2).cast("int").alias("stream"), (F.col("id") - 10_000).alias("pos")).alias("seq"),
    )
    got = {r.id: r for r in events.merge_duplicates(rows).collect()}
    assert len(written) == 2 and written[1].count() <= 200
    assert "SortAggregate" not in written[0]._jdf.queryExecution().executedPlan().toString()
    assert {k: [(e.source, int(e.details)) for e in r.evidence] for k, r in got.items()} == {
        f"e{k}": sorted([("radon", min(n for n in range(k, 20_000, 10) if n % 3 == 0)), ("cohesion", min(n for n in range(k, 20_000, 10) if n % 3))], key=lambda x: x[1]) for k in range(10)
    }
    assert all(r.strength == "strong" and r.severity == ("error" if k == "e9" else "info") and r.metrics.id == int(k[1:]) for k, r in got.items())


def test_merge_of_events_without_evidence_or_place(spark):
    none = "cast(array() as array<struct<source:string,details:string>>)"
    rows = spark.sql(f"""SELECT id, 'T' type, sev severity, 'weak' strength, struct('x' filepath) location, struct(m) metrics, ev evidence, struct(0 stream, cast(pos as bigint) pos) seq FROM VALUES
      ('a', 'info', 1, {none}, 5), ('a', 'error', 2, array(struct('s' source, 'd' details)), 9), ('b', 'info', 3, {none}, 7), ('b', 'warning', 4, {none}, cast(null as int)), ('c', 'info', 5, {none}, -4), ('c', 'info', 6, {none}, 4)
      AS t(id, sev, m, ev, pos)""")
    got = {r.id: (r.severity, r.strength, r.metrics[0], [e.source for e in r.evidence]) for r in events.merge_duplicates(rows).collect()}
    assert got == {"a": ("error", "weak", 1, ["s"]), "b": ("warning", "weak", 4, []), "c": ("info", "weak", 5, [])}


def test_lone_events_pass_by_the_merge(spark, monkeypatch):
    row = lambda k, seq: (f"e{k}", "LOW_MI_FILE", "error", "weak", None, None, [("radon", "{}")], (1, seq))
    given = spark.createDataFrame([*[row(k, k) for k in range(300)], row(7, 900)], events.EVENT_SCHEMA)
    met, whole = [], events.merge_duplicates
    monkeypatch.setattr(events, "merge_duplicates", lambda e: met.append(e.count()) or whole(e))
    out = events.merge_shared(given)
    assert met[0] < 10 and out.count() == 300 and out.columns == given.columns
    assert {r.severity for r in out.collect()} == {"error"}
