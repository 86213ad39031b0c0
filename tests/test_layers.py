
import pytest
from pyspark.sql import functions as F

from codestrata.config import ProjectConfig, config_table
from codestrata.operators import layers

TIERS = [("routers", 0), ("services", 1), ("infrastructure", 2), ("interfaces", 3), ("models", 4), ("db_libs", 5)]


def _edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "source string, target string")


def _sdp(spark, source, target, i_source, i_target, **more):
    rated = spark.createDataFrame([(source, i_source), (target, i_target)], "layer string, instability double")
    tiers = config_table(spark, "layer string, tier int", TIERS)
    return layers.sdp_violations(_edges(spark, (source, target)), rated, tiers, **more).collect()


@pytest.mark.parametrize(
    "source, target, i_source, i_target, more, count",
    [
        ("routers", "services", 1.0, 0.8, {}, 1),
        ("routers", "services", 0.5, 0.5, {}, 0),
        ("routers", "services", 0.8, 0.75, {"tolerance": 0.1}, 0),
        ("routers", "services", 0.2, 0.8, {}, 0),
        ("routers", "services", 0.2, 0.8, {"textbook": True}, 1),
        ("routers", "unknown", 1.0, 0.0, {}, 0),
    ],
)
def test_sdp(spark, source, target, i_source, i_target, more, count):
    assert len(_sdp(spark, source, target, i_source, i_target, **more)) == count


def test_sdp_message_and_exception(spark):
    row = _sdp(spark, "routers", "services", 1.0, 0.8)[0]
    assert row.severity == "error" and row.message == "import from routers to services: instability 1.0 meets 0.8; the source is the less stable side by 0.2 where 0.0 is allowed"
    allowed = config_table(spark, "source string, target string", [("models", "db_libs")])
    assert _sdp(spark, "models", "db_libs", 1.0, 0.0, exceptions=allowed) == []


@pytest.mark.parametrize(
    "source, target, interfaces, severity, skipped",
    [
        ("services", "interfaces", ["interfaces"], "warning", [2]),
        ("routers", "interfaces", ["interfaces"], "warning", [1, 2]),
        ("infrastructure", "models", ["interfaces"], "error", [3]),
        ("routers", "interfaces", [], "error", [1, 2]),
        ("routers", "infrastructure", [], "warning", [1]),
        ("routers", "db_libs", [], "error", [1, 2, 3, 4]),
        ("routers", "services", [], None, None),
        ("models", "routers", [], None, None),
        ("routers", "unknown", [], None, None),
    ],
)
def test_slp(spark, source, target, interfaces, severity, skipped):
    tiers = config_table(spark, "layer string, tier int", TIERS)
    faces = config_table(spark, "layer string", [(n,) for n in interfaces])
    rows = layers.slp_violations(_edges(spark, (source, target)), tiers, faces).collect()
    assert [(r.severity, r.skipped_tiers) for r in rows] == ([] if severity is None else [(severity, skipped)])


def test_slp_without_tiers(spark):
    none = config_table(spark, "layer string, tier int", [])
    assert layers.slp_violations(_edges(spark, ("a", "b")), none, none.select("layer")).count() == 0


def test_tiers_flat_grouped_and_external(spark):
    flat = ProjectConfig.of({"layer_order": ["a", " b ", ""], "external_layers": {"x": ["lib"], "a": ["y"]}})
    assert flat.tier_rows() == [("a", 0), ("b", 1)]
    assert ProjectConfig.of({"layer_order": [["a"], ["b", "c"]]}).tier_rows() == [("a", 0), ("b", 1), ("c", 1)]
    assert ProjectConfig.of({"layer_order": None}).tier_rows() == [] and ProjectConfig.of({"layer_order": [3]}).tier_rows() == []
    both = layers.with_external_tier(flat.tiers(spark), flat.names(spark, ["x", "a"]))
    assert {tuple(r) for r in both.collect()} == {("a", 0), ("b", 1), ("x", 2)}


def test_longest_and_first_prefix_differ(spark):
    rules = config_table(spark, "layer string, prefix string, ord int", [("wide", "app", 0), ("narrow", "app.api", 1), ("late", "app.api", 2)])
    modules = spark.createDataFrame([("app.api.x",), ("app.apix",), ("app",), ("other",)], "m string")
    longest = {r.m: r.layer for r in layers.resolve(modules, "m", rules, "longest").collect()}
    first = {r.m: r.layer for r in layers.resolve(modules, "m", rules, "first").collect()}
    assert longest == {"app.api.x": "late", "app.apix": "wide", "app": "wide", "other": None}
    assert first == {"app.api.x": "wide", "app.apix": "wide", "app": "wide", "other": None}


def test_edges_and_stability(spark):
    config = ProjectConfig.of(
        {"package_root": "app", "layers": {"api": "api", "core": ["app.core"]}, "utility_layers": {"util": "util"}, "external_layers": {"db": ["sqlalchemy"]}}
    )
    imports = spark.createDataFrame(
        [("app.api.a", "app.core.b"), ("app.api.a", "app.api.c"), ("app.core.b", "sqlalchemy.orm"), ("app.tests.t", "app.core.b"), ("app.api.a", "app.tests.x"),
         ("other", "app.core"), ("app.api.a", "requests")], "importer string, imported string",
    )
    edges = layers.layer_edges(imports, config.prefixes(spark), config.externals(spark), "app", ("tests",))
    assert {tuple(r) for r in edges.collect()} == {("api", "core"), ("core", "db")}
    rated = {r.layer: (r.ca, r.ce, r.instability) for r in layers.stability(config.names(spark, ["api", "core", "util", "db"]), edges).collect()}
    assert rated == {"api": (0, 1, 1.0), "core": (1, 1, 0.5), "util": (0, 0, 0.0), "db": (1, 0, 0.0)}


def test_three_layer_cycle(spark):
    rows = layers.layer_cycles(_edges(spark, ("c", "a"), ("a", "b"), ("b", "c"), ("c", "d"))).collect()
    assert [(r.cycle_id, r.from_layer, r.to_layer, r.cycle_size) for r in rows] == [("a__b__c", "a", "c", 3)]


def test_config_checks(tmp_path):
    path = tmp_path / "c.json"
    for text in ("{}", '{"package_root": "a"}', '{"package_root": "a", "layers": {}}', '{"package_root": "a", "layers": {"x": []}, "ignore_dirs": [], "layer_order": ["y"]}'):
        path.write_text(text)
        with pytest.raises(ValueError):
            ProjectConfig.read(str(path))
    path.write_text('{"package_root": "a", "layers": {"x": [], "y": []}, "ignore_dirs": [], "layer_order": [["x", "y"]]}')
    assert ProjectConfig.read(str(path)).tier_rows() == [("x", 0), ("y", 0)]


def test_utility_layers_have_no_tier(spark):
    tiers = config_table(spark, "layer string, tier int", [("a", 0), ("u", 1)])
    got = layers.attach_tier(tiers.select("layer"), tiers, tiers.where("layer = 'u'").select("layer"))
    assert {(r.layer, r.tier, r.is_utility) for r in got.collect()} == {("a", 0, False), ("u", None, True)}
    assert got.where(F.col("tier").isNull()).count() == 1


def test_prefixes_of_any_depth(spark):
    prefixes = config_table(spark, "layer string, prefix string, ord int", [("api", "app.api", 0), ("deep", "app.api.x.y", 1), ("top", "app", 2)])
    names = spark.createDataFrame([("app.api.x.y.z",), ("app.api.x",), ("app.q",), ("other",)], "module string")
    got = {r.module: r.layer for r in layers.resolve(names, "module", prefixes, "longest").collect()}
    assert got == {"app.api.x.y.z": "deep", "app.api.x": "api", "app.q": "top", "other": None}
    assert {r.layer for r in layers.resolve(names, "module", prefixes.limit(0), "first").collect()} == {None}
