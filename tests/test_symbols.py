import pytest

from codestrata.operators import symbols
from codestrata.session import cut_lineage
from codestrata.sources.python_scopes import file_scopes, scope_rows

FILES = {
    "app/__init__.py": "from app.core import make as build\n",
    "app/core.py": "import os\n\nclass Base:\n    def save(self): return self.check()\n    def check(self): return os.getcwd()\n\ndef make():\n    return Base()\n\ndef only_here(): pass\n",
    "app/svc/__init__.py": "",
    "app/svc/work.py": (
        "from .. import build\nfrom ..core import Base as B\nimport app.core\nimport app.core as c\nalias = build\nagain = alias\nring = ring2\nring2 = ring\n\n"
        "class Work(B):\n    limit = 3\n    def __init__(self, log: c.Base, other):\n        self.base = c.Base()\n        self.other = other\n        log.check()\n"
        "    def run(self):\n        self.save()\n        self.base.check()\n        self.other.check()\n        again()\n        return app.core.only_here\n"
        "    @staticmethod\n    def still(x): return x.run()\n"
        "    def nested(self):\n        def inner(): return helper(limit)\n        return [inner() for helper in ()]\n\n"
        "def helper(n): return Work(None, None).run()\n\nif 1:\n    def twice(): pass\nelse:\n    from app.core import make as twice\n\ndef go():\n    twice()\n    ring()\n    (1).bit_length()\n    Work.base.save()\n    make().save()\n"
    ),
    "app/other.py": "class X:\n    def run(self): pass\n",
    "app/bad.py": "def (:\n",
}
WORK = "app.svc.work"


@pytest.fixture(scope="module")
def graph(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, source string")
    nodes, edges, bad = symbols.call_graph(cut_lineage(scope_rows(files)))
    return {r.name for r in nodes.collect()}, {(r.source, r.target): r.confidence for r in edges.collect()}, {r.block for r in bad.collect()}


def targets(graph, source):
    return {t: c for (s, t), c in graph[1].items() if s == source}


def test_self_inheritance_and_aliases(graph):
    assert targets(graph, "app.core.Base.save") == {"app.core.Base.check": "high"}
    assert targets(graph, "app.core.make") == {"app.core.Base": "high"}
    assert targets(graph, f"{WORK}.Work") == {"app.core.Base": "high"}
    # By way of self, an attribute of self, two aliases over a package's import, and a plain dotted import.
    run = targets(graph, f"{WORK}.Work.run")
    assert run == {"app.core.Base.save": "high", "app.core.Base.check": "high", "app.core.make": "high", "app.core.only_here": "high"}
    assert targets(graph, f"{WORK}.Work.__init__") == {"app.core.Base": "high", "app.core.Base.check": "high"}


def test_unknown_values_and_ambiguous_names(graph):
    assert targets(graph, f"{WORK}.Work.still") == {"*.run": "low"}
    # A name bound twice, an unknown value, an attribute of a class, and a name that is not bound at all.
    assert targets(graph, f"{WORK}.go") == {f"{WORK}.twice": "low", "app.core.make": "low", "*.bit_length": "low", "app.core.Base.save": "high"}
    assert {f"{WORK}.go", f"{WORK}.Work.still"} <= graph[2] and f"{WORK}.Work.run" not in graph[2]


def test_scopes(graph):
    assert targets(graph, f"{WORK}.helper") == {f"{WORK}.Work": "high", f"{WORK}.Work.run": "high"}
    # A class body's names are not visible in a nested function; the loop's name hides the module's.
    assert targets(graph, f"{WORK}.Work.nested.inner") == {} and targets(graph, f"{WORK}.Work.nested") == {f"{WORK}.Work.nested.inner": "high"}
    assert "app.bad" not in graph[0] and {"app.core.only_here", "app.other.X.run", "app"} <= graph[0]


def test_rows_of_one_file():
    assert file_scopes("a/b.py", "x = (")[0][1] == "error"
    rows = file_scopes("a/__init__.py", "from . import b\nfrom .c import d as e\nx, [y] = f()\nwith g() as h: pass\n")
    assert {(r[3], r[4], r[5]) for r in rows if r[1] == "bind"} == {("import", "b", "a.b"), ("import", "e", "a.c.d"), ("other", "x", None), ("other", "y", None), ("value", "h", "a")}


def test_first_names_are_looked_up_in_their_file():
    rows = file_scopes("a/b.py", "import os\nx = 1\nclass K:\n    x = 2\n    def m(self):\n        import os\n        def inner(): return os.path, x, len\n        return x\n")
    near = {(r[2], r[4], r[5]) for r in rows if r[1] == "near"}
    # A class body is not visible in its methods, the nearer import hides the outer one, and a builtin has no row.
    assert near == {("a.b.K.m.inner", "os", "a.b.K.m"), ("a.b.K.m.inner", "x", "a.b"), ("a.b.K.m", "x", "a.b")}
    assert {r[1] for r in rows} == {"scope", "bind", "use", "near"}


def test_a_round_reads_the_steps_of_its_states_only(spark):
    steps = spark.range(100_000).selectExpr("concat('m', id) as place", "'own' as form", "'f' as name")
    asked = spark.createDataFrame([("m7", "f"), ("m99", "f"), ("m8", "g")], "place string, name string")
    left = symbols._possible(steps, asked, ["place", "name"])
    assert left.columns == steps.columns and {"m7", "m99"} <= {r.place for r in left.collect()} and left.count() < 100
