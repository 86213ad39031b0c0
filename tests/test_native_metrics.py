import ast
import math

import pandas as pd
import pytest

from codestrata.config import ProjectConfig
from codestrata.operators import native_metrics
from codestrata.plans.report import Project, run
from codestrata.session import cut_lineage
from codestrata.sources import python_metrics, python_scopes
from codestrata.sources.python_metrics import file_metrics, line_classes, metric_rows

SOURCE = '''"""Doc
over lines."""
import os  # why

# alone

def plain(a, /, b, *c, d=1, **e): pass


async def waits(x):
    async for y in x:
        if y and y or not y:
            assert y
    else:
        return [z for z in x if z if x]
    try:
        with x: pass
    except (A, B): pass
    except C: pass
    else: x += 1
    finally: pass
    while x: x = 1 if y else 2
    def inner():
        if x: return lambda q: q or 1
        class Deep:
            def method(self):
                for _ in x: pass
    match x:
        case 1: pass
        case P(): pass
        case _: pass


class K:
    "text"
    if os: limit = 3
    def one(self): return -self.a + self.a
    @property
    def two(self): return self.a
'''


def test_blocks(spark):
    files = spark.createDataFrame([("a.py", SOURCE), ("bad.py", "x = ("), ("empty.py", ""), ("none.py", None)], "path string, source string")
    rows = cut_lineage(metric_rows(files))
    got = {(r.name, r.type): r for r in native_metrics.complexity_blocks(rows).collect()}
    ways = {k: (r.complexity, r.parameter_count, r.class_name) for k, r in got.items()}
    # for 2, if 1, boolean 2, assert 1, comprehension 3, try 3, while 1, conditional 1, cases 2; inside the closure if 1, boolean 1
    assert ways == {
        ("plain", "function"): (1, 5, None), ("waits", "function"): (19, 1, None), ("method", "method"): (2, 1, "Deep"), ("one", "method"): (1, 1, "K"), ("two", "method"): (1, 1, "K"),
    }
    assert got["waits", "function"].rank == "C" and got["plain", "function"].lineno == 7
    files = {r.filepath: (r.mi, r.rank) for r in native_metrics.maintainability_files(rows).collect()}
    assert set(files) == {"a.py", "empty.py"} and files["empty.py"] == (100.0, "A") and 0 < files["a.py"][0] < 100


def test_lines_and_words():
    assert line_classes(SOURCE) == {"code": 29, "comment": 2, "text": 3, "blank": 6}
    assert line_classes("") == {"code": 0, "comment": 0, "text": 0, "blank": 0}
    rows = file_metrics("x.py", "a = b + b\nc += -a.d\nprint(1 < a < 2)\n")
    words = {(r[1], r[4]): r[7] for r in rows if r[1] in ("operator", "operand")}
    assert words == {
        ("operator", "Add"): 2, ("operand", "b"): 2, ("operand", "c"): 1, ("operand", "-a.d"): 1, ("operator", "USub"): 1, ("operand", "a.d"): 1,
        ("operator", "Lt"): 2, ("operand", "1"): 1, ("operand", "a"): 1, ("operand", "2"): 1,
    }
    assert file_metrics("x.py", "def (")[0][1] == "error" and {r[4]: r[7] for r in rows if r[1] == "lines"}["logical"] == 3


def test_index_formula(spark):
    rows = metric_rows(spark.createDataFrame([("x.py", "# c\na = b + b\n")], "path string, source string"))
    volume = 3 * math.log2(2)
    want = (171 - 5.2 * math.log(volume) - 16.2 * math.log(1) + 50 * math.sin(math.sqrt(2.46 * math.radians(100)))) * 100 / 171
    assert native_metrics.maintainability_files(rows).first().mi == round(min(want, 100.0), 2)


def test_project_without_reports(spark, tmp_path):
    root = tmp_path / "app"
    root.mkdir()
    (root / "deep.py").write_text("def f(a, b):\n" + "".join(f"    if a > {k}: b += {k}\n" for k in range(12)) + "    return b\n\ndef g(): return f(1, 2)\n")
    report = run(Project(spark, str(root), ProjectConfig.of({"package_root": "app", "layers": {"all": ["deep"]}, "ignore_dirs": []}), native=True))
    found = {r.function_id: (r.cc, r.parameter_count) for r in report["functions"].collect()}
    assert found == {"app/deep.py::1::f": (13, 2), "app/deep.py::16::g": (1, 0)}
    assert report["files"].first().mi is not None and report["run"].first().parameters_used
    assert {(r.source, r.target) for r in report["call_edges"].collect()} == {("app.deep.g", "app.deep.f")}


def test_sources_are_read_once_for_complexity(spark):
    files = spark.createDataFrame([("a.py", "def f(x):\n    return x if x else 1\n")], "path string, source string")
    blocks = native_metrics.complexity_blocks(python_metrics.metric_rows(files))
    assert blocks._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") <= 1
    assert [(r.name, r.complexity) for r in blocks.collect()] == [("f", 2)]


@pytest.mark.parametrize("module", [python_metrics, python_scopes])
def test_rows_of_many_files_go_out_in_small_batches(module, monkeypatch):
    monkeypatch.setattr(module, "_ROWS_PER_BATCH", 100, raising=False)
    files = pd.DataFrame([(f"m{k}.py", "def f(x):\n    return x + 1\n") for k in range(300)], columns=["path", "source"])
    sizes = [len(frame) for frame in module._batches(iter([files, files]))]
    assert max(sizes) < 130 and sum(sizes) == 2 * len(pd.concat(module._batches(iter([files]))))


def test_operands_read_as_unparsed():
    for text in ("a", "7", "True", "'x'", "-a", "a.b", "1.0", "f(x)", "...", "10 ** 400"):
        node = ast.parse(text, mode="eval").body
        assert python_metrics._written(node) == ast.unparse(node)
