from codestrata.operators import callgraph, contracts
from codestrata.sources.files import read_lines

CALLS = """WARNING: odd thing
pkg.a
  [U] pkg.b
  [U] pkg.b
  [U] pkg.a

pkg.b
    [U] pkg.c
    [D] pkg.zzz
not a name!
    [U] pkg.d
    [U] pkg.d
pkg.e
info: skipped
    [U] pkg.e
    [U] pkg.e
    [U] 9bad
    [U] pkg.f
pkg.lonely
"""

CONTRACTS = """\x1b[31mLayered architecture BROKEN\x1b[0m
    app.api.x -> app.db.y
Other KEPT
-   app.api.z -> app.db.w (l.12)
    app.a -> app.b trailing words
 BROKEN
    app.lost -> app.found
Second BROKEN

Contracts: 1 kept, 2 broken.
"""


def _lines(spark, tmp_path, text, name="t.txt"):
    path = tmp_path / name
    path.write_text(text)
    return read_lines(spark, str(path))


def test_call_text(spark, tmp_path):
    parsed = callgraph.parse_blocks(_lines(spark, tmp_path, CALLS))
    assert {r[0] for r in callgraph.suspicious_blocks(parsed).collect()} == {"pkg.a"}
    edges = callgraph.raw_edges(parsed)
    # A broken header leaves the block before it open for edges, but not for collisions.
    assert sorted(tuple(r) for r in edges.collect()) == sorted(
        [("pkg.a", "pkg.b"), ("pkg.a", "pkg.b"), ("pkg.b", "pkg.c"), ("pkg.b", "pkg.d"), ("pkg.b", "pkg.d"), ("pkg.e", "pkg.f")]
    )
    nodes, bad = callgraph.nodes(parsed), callgraph.suspicious_blocks(parsed)
    assert {r[0] for r in nodes.collect()} == {"pkg.a", "pkg.b", "pkg.c", "pkg.d", "pkg.e", "pkg.f", "pkg.lonely"}
    kinds = {r.name: r.node_class for r in callgraph.classify_nodes(nodes, edges).collect()}
    assert (kinds["pkg.a"], kinds["pkg.b"], kinds["pkg.lonely"], kinds["pkg.e"]) == ("root", "used", "dead", "root")
    rated = {(r.source, r.target): r.confidence for r in callgraph.rate_edges(edges, bad).collect()}
    assert rated[("pkg.a", "pkg.b")] == "low" and rated[("pkg.b", "pkg.c")] == "high"
    assert callgraph.collision_rate(nodes, bad) == 1 / 7
    assert spark.range(1).select(callgraph.parse_warning(nodes, edges)).first()[0] is False


def test_cascade_lowers_edges_into_suspicious_targets(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "source string, target string")
    bad = spark.createDataFrame([("c",)], "block string")
    assert {(r.source, r.confidence) for r in callgraph.rate_edges(edges, bad).collect()} == {("a", "high"), ("b", "low"), ("c", "low")}
    assert {(r.source, r.confidence) for r in callgraph.rate_edges(edges, bad, cascade=False).collect()} == {("a", "high"), ("b", "high"), ("c", "low")}
    copies = spark.createDataFrame([("a", "b", "high"), ("a", "b", "low"), ("x", "y", "high")], "source string, target string, confidence string")
    assert {(r.source, r.confidence) for r in callgraph.lower_copies(copies).collect()} == {("a", "low"), ("x", "high")}


def test_guard_is_strict(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(*[callgraph.collision_status(F.lit(r), 0.35, a) for r, a in ((0.35, True), (0.36, False), (0.36, True))]).first()
    assert tuple(row) == ("ok", "high_collision", "aborted")


def test_contract_text(spark, tmp_path):
    lines = _lines(spark, tmp_path, CONTRACTS)
    assert [r.contract_name for r in contracts.broken_contracts(lines).orderBy("pos").collect()][0] == "Layered architecture"
    got = {(r.contract_name, r.importer, r.imported) for r in contracts.broken_imports(lines).collect()}
    # A bare BROKEN names no contract, so the open one goes on.
    assert got == {("Layered architecture", f"app.{a}", f"app.{b}") for a, b in (("api.x", "db.y"), ("api.z", "db.w"), ("lost", "found"))}
    status = lines.select("file").distinct().selectExpr("file", "false as passed")
    assert [(r.kept, r.broken) for r in contracts.contract_totals(lines, status).collect()] == [(1, 2)]


def test_totals_fall_back_on_the_return_code(spark, tmp_path):
    lines = _lines(spark, tmp_path, "nothing here\n")
    for passed, want in ((True, (1, 0)), (False, (0, 1))):
        status = lines.select("file").distinct().selectExpr("file", f"{str(passed).lower()} as passed")
        row = contracts.contract_totals(lines, status).first()
        assert (row.kept, row.broken) == want
