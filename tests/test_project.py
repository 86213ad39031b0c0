import json

import pytest
from pyspark.sql import functions as F

from codestrata.__main__ import main
from codestrata.config import ProjectConfig
from codestrata.operators.relations import attach_parameter_counts
from codestrata.plans.report import Project, run
from codestrata.plans.review import review, review_settings, review_status
from codestrata.sources import sinks
from codestrata.sources.files import scan_python
from codestrata.sources.tool_reports import complexity_blocks, maintainability_files, source_status

CONFIG = {
    "package_root": "app", "layers": {"api": ["api"], "svc": ["svc"], "db": ["db"]}, "layer_order": ["api", "svc", "db"], "utility_layers": {"util": ["util"]},
    "external_layers": {"libs": ["sqlalchemy"]}, "ignore_dirs": ["tests"], "interface_layers": [], "llm": {"enabled": True, "max_tokens_per_run": 0},
}
FILES = {
    "__init__.py": "", "api/__init__.py": "", "svc/__init__.py": "", "db/__init__.py": "",
    "api/views.py": "from app.svc.work import Work\nfrom app.db.models import Row\nclass View(Work):\n    def run(self):\n        raise NotImplementedError\n    def show(self): return 3\n",
    "svc/work.py": "import app.db.models\nimport app.api.views\nclass Work:\n    def __init__(self): self.a = 1; self.b = 2\n    def run(self): return self.a\n    def stop(self): return self.b\n",
    "db/models.py": "import sqlalchemy.orm\nclass Row:\n    def load(self): return 1\n", "tests/test_x.py": "class Ignored: pass\n", "bad.py": "class :\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    tmp_path = tmp_path_factory.mktemp("project")
    root = tmp_path / "app"
    for name, text in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "latin.py").write_bytes("x = 'é'".encode("latin-1"))
    reports = tmp_path / "reports"
    reports.mkdir()
    block = {"rank": "C", "lineno": 5}
    (reports / "cc.json").write_text(json.dumps({
        str(root / "svc/work.py"): [{"type": "method", "name": "run", "complexity": 17, **block}, {"type": "class", "name": "Work", "complexity": 3, "rank": "A", "lineno": 3}],
        "app/db/models.py": [{"type": "method", "name": "load", "complexity": 12, "rank": "C", "lineno": 3}], "app/bad.py": "SyntaxError",
    }, indent=1))
    (reports / "mi.json").write_text(json.dumps({"app/svc/work.py": {"mi": 9.005, "rank": "C"}, "app/bad.py": "error"}))
    (reports / "contracts.txt").write_text("Layers BROKEN\n    app.svc.work -> app.db.models\n    app.api.views -> app.svc.work\nContracts: 0 kept, 1 broken.\n")
    (reports / "calls.txt").write_text("app.api.views.View.run\n  [U] app.svc.work.Work.run\napp.db.models.Row.load\napp.svc.work.Work.stop\n")
    (tmp_path / "config.json").write_text(json.dumps(CONFIG))
    return tmp_path


def _reports(tree):
    return {"complexity": "cc.json", "maintainability": "mi.json", "contracts": "contracts.txt", "calls": "calls.txt"}.items()


@pytest.fixture(scope="module")
def done(spark, tree):
    project = Project(spark, str(tree / "app"), ProjectConfig.read(str(tree / "config.json")), {n: str(tree / "reports" / f) for n, f in _reports(tree)}, False)
    return project, run(project)


def test_scan_keeps_undecodable_files_as_errors(spark, tree):
    got = {r.path: r.error for r in scan_python(spark, str(tree / "app"), ["tests"], "app").collect()}
    assert got["app/latin.py"] == "not utf-8" and got["app/svc/work.py"] is None and not any("tests" in p for p in got)


def test_whole_project(done):
    project, report = done
    assert project.sources.errors == {}
    events = {r.id: r for r in report["violations"].collect()}
    kinds = {}
    for e in events.values():
        kinds.setdefault(e.type, []).append(e.id)
    # Tool paths are absolute or relative; all end up relative, so layers resolve end to end.
    assert events["HIGH_CC_METHOD::app/svc/work.py::5::run"].location.class_name == "Work"
    assert set(kinds) == {
        "HIGH_CC_METHOD", "LOW_MI_FILE", "LOW_COHESION_CLASS", "DEAD_CODE_NODE", "IMPORT_CYCLE", "LAYER_VIOLATION", "OVERLOADED_CLASS", "DEAD_CODE_RISK",
        "DEAD_LAYER_NODE", "LOW_MI_VIOLATING_LAYER", "LOW_COHESION_CONTRACT_LAYER", "SDP_VIOLATION", "SLP_VIOLATION", "UNSTABLE_COHESION_LAYER",
    }
    assert kinds["IMPORT_CYCLE"] == ["IMPORT_CYCLE::api__svc"] and kinds["DEAD_CODE_RISK"] == ["DEAD_CODE_RISK::app.db.models.Row.load"]
    assert {r.layer: (r.tier, r.broken_imports) for r in report["layers"].collect()} == {"api": (0, 1), "svc": (1, 1), "db": (2, 0), "util": (None, 0), "libs": (3, 0)}
    total = report["summary_violations"].first()
    assert total.violations_total == len(events) == total.strong_violations + total.weak_violations
    assert {(r.rule, r.class_name) for r in report["findings"].collect()} == {("LSP-H-001", "View")}
    assert all(r.succeeded for r in report["meta"].collect())


def test_notes_on_the_run(spark, tree, done):
    project, report = done
    assert tuple(report["run"].first()) == (None, "parameters" in project.reports, False)
    assert {r.name for r in report["call_roots"].collect()} == {"app.api.views.View.run"}
    assert report["call_warnings"].first().collision_status == "ok" and not report["call_warnings"].first().nodes_without_edges
    errors = {r.path: r.error for r in report["file_errors"].collect()}
    assert errors["app/latin.py"] == "not utf-8" and errors["app/bad.py"].startswith("SyntaxError")
    worst = [r.cc for r in report["functions_by_complexity"].collect()]
    assert worst == sorted(worst, reverse=True) and len(worst) == report["functions"].count()
    assert report["files_by_maintainability"].first().filepath == "app/svc/work.py"
    assert report["name_collisions"].count() == 0 == report["suspicious_blocks"].count()
    scanned = {r.path for r in project.files().collect()}
    assert {"app/" + name for name in FILES if "tests/" not in name} <= scanned


def test_missing_sources_are_named_and_the_rest_goes_on(spark, tree):
    project = Project(spark, str(tree / "app"), ProjectConfig.read(str(tree / "config.json")))
    report = run(project)
    assert {r.source for r in report["meta"].where("not succeeded").collect()} == {"radon", "import_linter", "pyan3"}
    assert report["violations"].count() > 0


def test_report_that_only_says_what_went_wrong(spark, tree, tmp_path):
    (tmp_path / "cc.json").write_text('{"error": "crashed"}')
    (tmp_path / "mi.json").write_text("[1]")
    project = Project(spark, str(tree / "app"), ProjectConfig(), {"complexity": str(tmp_path / "cc.json"), "maintainability": str(tmp_path / "mi.json")})
    with pytest.raises(ValueError, match="complexity report is no result: .*crashed"):
        project.json("complexity")
    with pytest.raises(ValueError, match="not a JSON object"):
        project.json("maintainability")
    assert project.json("parameters") is None


def test_command_line_writes_the_same_report_with_other_partitions(spark, tree, done):
    given = ["--target-dir", str(tree), "--config", str(tree / "config.json"), "--out", str(tree / "out"), "--contracts-failed", "--texts"]
    for name, file in _reports(tree):
        given += ["--report", f"{name}={tree / 'reports' / file}"]
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert main(given, spark) == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    written = {p.name for p in (tree / "out").iterdir()}
    assert {"violations", "files", "classes", "functions", "layers", "dead_code", "skeleton", "tree", "summary_imports"} <= written
    summary = spark.read.json(str(tree / "out" / "summary_imports")).first()
    assert (summary.contracts_checked, summary.broken_contracts, summary.import_cycles) == (1, 1, 1)
    expected = done[1]["violations"]
    again = spark.read.schema(expected.schema).json(str(tree / "out" / "violations"))
    assert sorted(map(str, again.drop("seq").collect())) == sorted(map(str, expected.drop("seq").collect()))


def test_review_uses_its_cache(tree, done):
    project, _ = done
    texts = project.rows().where("kind = 'class'").select("path", "cls", "text")
    settings = review_settings(project.config, str(tree / "config.json"))
    assert review_status(project.config, project.candidates) == ("ready", None) and review_status(ProjectConfig.of({}), None)[0] == "disabled"

    def service(payload):
        answer = {"findings": [{"message": "found", "principle": "LSP"}]}
        return 200, json.dumps({"choices": [{"finish_reason": "stop", "message": {"content": json.dumps(answer)}}], "usage": {"total_tokens": 11}})

    first = review(project.candidates, texts, project.findings, settings, service, ())
    summary = first["review_summary"].first()
    assert (summary.candidates_processed, summary.tokens_used, summary.cache_hits) == (1, 11, 0)
    assert [(r.rule, r.class_name, r.path) for r in first["review_findings"].collect()] == [("LSP-LLM-001", "View", "app/api/views.py")]

    def closed(payload):
        raise AssertionError("must not be called")

    again = review(project.candidates, texts, project.findings, settings, closed, ())["review_summary"].first()
    assert (again.candidates_processed, again.tokens_used, again.cache_hits) == (1, 0, 1)


def test_tree_text(spark):
    files = spark.createDataFrame([(p,) for p in ("b/z.py", "b/A.py", "a.py", "C/d/e.py", "C/x.py", "build/q.py", ".DS_Store")], "path string")
    lines = [r.line for r in sinks.tree_lines(files).orderBy("place").collect()]
    assert lines == ["├── b", "│   ├── A.py", "│   └── z.py", "├── C", "│   ├── d", "│   │   └── e.py", "│   └── x.py", "└── a.py"]


def test_skeleton_blocks(spark):
    files = spark.createDataFrame([("a.py", "def f(): return 1"), ("b.py", "def ("), ("dist/c.py", "x = 1")], "path string, source string")
    got = {r.path: r.block for r in sinks.skeleton_blocks(sinks.skeletons(files)).collect()}
    assert set(got) == {"a.py", "b.py"} and "FILE: a.py" in got["a.py"] and got["a.py"].endswith("def f():\n    pass\n") and got["b.py"].startswith("\n# Parsing error — b.py")


def test_tool_json_shapes(spark):
    text = json.dumps({"a.py": [{"type": "function", "name": "f"}], "b.py": "SyntaxError", "c.py": []})
    df = spark.createDataFrame([(text,)], "json string")
    assert [tuple(r) for r in complexity_blocks(df).collect()] == [("a.py", "f", "function", 0, "A", 0)]
    mi = spark.createDataFrame([(json.dumps({"a.py": {"mi": 2.675, "rank": "C"}, "b.py": {}, "c.py": 3}),)], "json string")
    assert {tuple(r) for r in maintainability_files(mi).collect()} == {("a.py", 2.67, "C"), ("b.py", 0.0, "A")}
    status = spark.createDataFrame([("a", '{"is_success": false}'), ("b", '{"error": "x"}'), ("c", "[]"), ("d", "{")], "source string, json string")
    assert {r.source: r.ok for r in source_status(status).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_parameter_counts_take_the_last_row_and_skip_line_zero(spark):
    fns = spark.createDataFrame([("a.py", 3, "f"), ("a.py", 0, "g")], "filepath string, lineno long, name string").withColumn("parameter_count", F.lit(None).cast("long"))
    counts = spark.createDataFrame([("a.py", 3, 1, 0), ("a.py", 3, 4, 1), ("a.py", 0, 9, 2)], "filepath string, lineno long, parameter_count long, seq long")
    assert {r.name: r.parameter_count for r in attach_parameter_counts(fns, counts).collect()} == {"f": 4, "g": None}
