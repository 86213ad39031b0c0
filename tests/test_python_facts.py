import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codestrata.operators import classfacts as cf
from codestrata.sources import python_syntax
from codestrata.sources.python_syntax import annotation_text, file_rows, skeleton_text


def _by_name(df, *columns):
    return {r.class_name: (tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]]) for r in df.collect()}


def _cohesion(made):
    rows, methods, classes, _ = made
    return {r.name: (r.cohesion_score, r.methods_count, r.class_kind) for r in cf.cohesion_rows(rows, methods, classes).collect()}


KINDS = """
import abc, dataclasses
from dataclasses import dataclass
class Plain: pass
@dataclass
class D1: pass
@dataclasses.dataclass
class D2: pass
@dataclass(frozen=True)
class Called: pass
class Model(BaseModel): pass
class Row(orm.Base): pass
class Empty(ABC): pass
class OnlyDunder(Protocol):
    def __init__(self): self.x = 1
class Face(abc.ABC):
    @abstractmethod
    def a(self): ...
    @abc.abstractmethod
    async def b(self): ...
class Half(ABC):
    @abstractmethod
    def a(self): ...
    def b(self): return 1
class Meta(ABCMeta):
    def a(self): return 1
"""


def test_class_kinds(facts):
    assert _by_name(facts({"k.py": KINDS})[2], "class_kind") == {
        "Plain": "concrete", "D1": "dataclass", "D2": "dataclass", "Called": "concrete", "Model": "dataclass", "Row": "dataclass", "Empty": "interface",
        "OnlyDunder": "interface", "Face": "interface", "Half": "abstract", "Meta": "abstract",
    }


ROLES = '''
from pydantic import BaseModel as Shape
from conf import AppConfig as Cfg
class Faces(ABC):
    @abstractmethod
    def a(self): return compute()
    def b(self):
        """Doc."""
        raise NotImplementedError("x")
class TwoStubs:
    def a(self):
        pass
        ...
class NoMethods: x = 1
class Aliased(Shape): pass
class Settings2(Cfg): pass
class Both(BaseSettings): pass
class Table:
    __tablename__ = "t"
    id = Column()
class OneSign:
    __tablename__ = "t"
class Typed:
    a: int
    b: int
    c: int = Field()
class Documented:
    """Doc."""
    a: int
    b: int
class Deep:
    model_config = {}
    def m(self):
        def inner():
            return mapped_column()
        return inner
'''


def test_class_roles(facts):
    assert _by_name(facts({"r.py": ROLES})[2], "class_role", "infra_score") == {
        "Faces": ("PURE_INTERFACE", 0), "TwoStubs": ("DOMAIN", 0), "NoMethods": ("DOMAIN", 0), "Aliased": ("INFRA_MODEL", 2), "Settings2": ("CONFIG", 0),
        "Both": ("CONFIG", 2), "Table": ("INFRA_MODEL", 2), "OneSign": ("DOMAIN", 1), "Typed": ("INFRA_MODEL", 2), "Documented": ("DOMAIN", 0), "Deep": ("INFRA_MODEL", 2),
    }


METHODS = '''
class C:
    def a(self): pass
    def b(self): ...
    def c(self):
        """Doc."""
        pass
        raise NotImplementedError
    def d(self): raise ValueError
    @property
    def e(self): return 1
    @e.setter
    def e(self, v): self._e = v
    @staticmethod
    def f(x: "T", *rest, **more) -> a.B[int, str]: return x
    @other.classmethod
    def g(cls, y: int | None = None): return y
    async def h(self, p, /, q, *, r):
        async for _ in p: pass
        async with p: pass
        for i in q:
            if i and p or r: pass
        def inner():
            if 1: pass
        return [j for j in q if j] if p else None
'''


def test_method_facts(facts):
    rows, methods, _, _ = facts({"m.py": METHODS})
    got = {(r.method_name, r.lineno): r for r in methods.collect()}
    empty = {k[0] for k, r in got.items() if r.is_empty}
    assert empty == {"a", "b", "c"}
    assert {k[0] for k, r in got.items() if r.is_trivial} == {"a", "b"}
    assert [r.is_property for k, r in sorted(got.items(), key=lambda x: x[1].lineno) if k[0] == "e"] == [True, False]
    by = {k[0]: r for k, r in got.items()}
    assert by["f"].is_static and by["g"].is_class_method and by["h"].is_async
    # 1 + for + if + two operators + comprehension + conditional; async forms and inner functions do not count.
    assert by["h"].cc == 7
    # Positional-only and keyword-only parameters are not listed.
    signed = {r.method_name: (r.parameters, r.return_type) for r in cf.signatures(rows).join(methods, cf.METHOD).collect()}
    assert signed["f"] == ("x: 'T', *rest, **more", "a.B[int, str]") and signed["g"] == ("cls, y: int | None", "Any") and signed["h"] == ("q", "Any")


def test_annotations_fall_back_on_any():
    import ast

    assert annotation_text(ast.parse("f(x)", mode="eval").body) == "Any"


LCOM = '''
class Split:
    def __init__(self): self.a = 1; self.b: int = 2
    def x(self): return self.a
    def y(self): return self.a
    def z(self): return self.b
class Called:
    def x(self): return self.y()
    def y(self): return z()
    def z(self): return 1
    @property
    def p(self): return self.x()
class Super(Called):
    def x(self): return super().y()
    def y(self): return 2
class Static:
    n = 1
    @staticmethod
    def s(self): return self.n
    def t(self): return self.n
class Own:
    k, v = 1, 2
    [q, r] = 3, 4
    def x(this): return this.k
    def y(this): return this.k
    def z(this): return this.q
    def w(this): return this.q
class Nested:
    v = 1
    def x(self):
        def direct(other): return other.v
        return direct
    def y(self):
        if self:
            def deeper(other): return other.v
        return 1
    def z(self): return self.v
class Twice:
    v = 1
    def m(self): return self.v
    def m(self): return 2
    def n(self): return self.v
class Setter:
    @property
    def v(self): return self._v
    @v.setter
    def v(self, x): self._v = x
class Nothing:
    def __init__(self): pass
class AsyncInit:
    async def __init__(self): self.a = 1
    def x(self): return self.a
    def y(self): return self.a
class Tupled:
    def __init__(self):
        self.a, self.b = 1, 2
        self.c += 1
        cls.d = 1
    def x(self): return self.a, self.c, self.d
    def y(self): return self.a, self.c
    def z(self): return self.d
class Outer:
    class Inner:
        w = 1
        def p(self): return self.w
        def q(self): return self.w
    def o(self): return self.Inner
'''


def test_lcom4(facts):
    got = {k: v[:2] for k, v in _cohesion(facts({"l.py": LCOM})).items()}
    assert got == {
        "Split": (2.0, 3), "Called": (1.0, 3), "Super": (1.0, 2), "Static": (2.0, 2), "Own": (3.0, 4), "Nested": (2.0, 3), "Twice": (2.0, 3), "Setter": (1.0, 1),
        "AsyncInit": (2.0, 2), "Tupled": (2.0, 3), "Inner": (1.0, 2), "Outer": (1.0, 1),
    }


def test_lcom4_against_plain_search(facts):
    """Random classes; components found by a direct search over all method pairs."""
    rng = random.Random(3)
    text, want = [], {}
    for c in range(25):
        names = [f"m{i}" for i in range(rng.randrange(1, 9))]
        uses = {m: {rng.randrange(12) for _ in range(rng.randrange(3))} for m in names}
        calls = {m: {rng.choice(names)} if rng.random() < 0.3 else set() for m in names}
        text.append(f"class C{c}:\n" + "".join(f"    a{i} = {i}\n" for i in range(12)))
        for m in names:
            body = "".join(f"        self.a{u}\n" for u in sorted(uses[m])) + "".join(f"        self.{x}()\n" for x in calls[m])
            text.append(f"    def {m}(self):\n{body}        return 0\n")
        left, count = set(names), 0
        while left:
            stack, count = [left.pop()], count + 1
            while stack:
                a = stack.pop()
                for b in list(left):
                    if uses[a] & uses[b] or b in calls[a] or a in calls[b]:
                        left.discard(b)
                        stack.append(b)
        want[f"C{c}"] = (float(count), len(names))
    assert {k: v[:2] for k, v in _cohesion(facts({"x.py": "".join(text)})).items()} == want


HIERARCHY = {
    "a.py": "class Base:\n    def __init__(self): self.root = 1\nclass Dup:\n    def __init__(self): self.from_a = 1\nclass LocalDup(Dup):\n    def x(self): return self.from_a\n",
    "b.py": "class Dup:\n    def __init__(self): self.from_b = 1\nclass Left(Base):\n    def __init__(self): self.left = 1\nclass Right(m.Base): pass\n"
    "class Diamond(Left, Right):\n    def x(self): return self.root\n    def y(self): return self.root\n    def z(self): return self.left\n",
    "c.py": "class Lost(Dup):\n    def x(self): return self.from_a\n    def y(self): return self.from_a\nclass Loop(Loop2): pass\nclass Loop2(Loop):\n    def __init__(self): self.l = 1\nclass Outside(External): pass\n"
    "class Dyn(make()): pass\n",
}


def test_ancestor_attributes(facts):
    rows, methods, classes, _ = made = facts(HIERARCHY)
    named = cf.inherited_attributes(rows, cf.init_attributes(rows, methods)).join(classes, cf.CLASS)
    got = {}
    for r in named.collect():
        got.setdefault(r.class_name, set()).add(r.attr)
    assert got == {"LocalDup": {"from_a"}, "Left": {"root"}, "Right": {"root"}, "Diamond": {"root", "left"}, "Loop": {"l"}}
    scores = _cohesion(made)
    assert scores["Diamond"][:2] == (2.0, 3) and scores["Lost"][:2] == (2.0, 2)


def test_base_resolution_counts_hits(facts):
    rows, _, classes, _ = facts(HIERARCHY)
    found = cf.resolve_base(cf.bases(rows).select(*cf.CLASS, "base"), cf.base_index(classes.select(*cf.CLASS, "class_name")))
    got = {(r.path, r.base): (r.hits, r.found_path) for r in found.collect()}
    assert got["a.py", "Dup"] == (2, "a.py") and got["c.py", "Dup"] == (2, None) and got["b.py", "Base"] == (1, "a.py") and got["c.py", "External"] == (0, None)


def test_project_map_keeps_the_last_definition(facts):
    files = {"a.py": "class A(ABC):\n    def m(self): pass\nclass B(A): pass\n", "z.py": "class A:\n    def n(self): return 1\n"}
    rows, methods, classes, project = facts(files)
    got = {r.class_name: (r.path, r.definitions, r.known_interface) for r in project.collect()}
    # The interface entry outlives the class that made it one.
    assert got == {"A": ("z.py", 2, True), "B": ("a.py", 1, False)}
    assert [tuple(r) for r in cf.name_collisions(classes).collect()] == [("A", 2, "z.py")]
    assert [tuple(r) for r in cf.interface_links(project).collect()] == [("B", "A")]


def test_import_graph_and_packages(facts):
    files = {
        "app/__init__.py": "", "app/api/__init__.py": "from . import views\n", "app/api/views.py": "import sqlalchemy.orm as orm\nfrom ..core import db\nfrom app.core.db import Thing\nimport app.core.db\nfrom .. import core\n",
        "app/core/__init__.py": "", "app/core/db.py": "def f():\n    import json.decoder\n",
    }
    rows = facts(files)[0].cache()
    extra = rows.sparkSession.createDataFrame([(p,) for p in files], "path string")
    got = {tuple(r) for r in cf.import_graph(rows, extra).collect()}
    assert got == {
        ("app.api", "app.api.views"), ("app.api.views", "sqlalchemy"), ("app.api.views", "app.core.db"), ("app.api.views", "app.core"), ("app.core.db", "json"),
    }
    top = {(r.path, r.package) for r in cf.top_imports(rows).collect()}
    assert ("app/api/views.py", "sqlalchemy") in top and ("app/core/db.py", "json") not in top


@pytest.mark.parametrize("source", ["class :", "x = 1\x00", "(" * 5000])
def test_broken_files_become_error_rows(source):
    (row,) = file_rows("x.py", source)
    assert row[1] == "error"


def test_skeleton():
    text = skeleton_text('class A:\n    """C."""\n    x = 1\n    def m(self):\n        """M."""\n        def inner(): return 1\n        return 2\n    async def n(self): return 3\n')
    assert text == 'class A:\n    """C."""\n    x = 1\n\n    def m(self):\n        """M."""\n\n    async def n(self):\n        pass'


def test_spread_does_not_change_rows(facts, spark):
    from codestrata.sources.python_syntax import syntax_rows

    given = spark.createDataFrame([("l.py", LCOM), ("k.py", KINDS)], "path string, source string")
    assert syntax_rows(given).exceptAll(syntax_rows(given, spread=True)).count() == 0
    assert syntax_rows(given).where(F.col("kind") == "class").count() == 24


@pytest.mark.parametrize("levels", [20, pytest.param(200, marks=pytest.mark.skipif("CHECK_ALL" not in os.environ, reason="long; CHECK_ALL=1 runs it"))])
def test_deep_hierarchy(facts, levels):
    source = "class C0:\n    def __init__(self): self.a0 = 1\n" + "".join(f"class C{k}(C{k - 1}):\n    def __init__(self): self.a{k} = 1\n" for k in range(1, levels))
    rows, methods, classes, _ = facts({"a.py": source})
    got = {}
    names = {r.cls: r.class_name for r in classes.collect()}
    for r in cf.inherited_attributes(rows, cf.init_attributes(rows, methods)).collect():
        got.setdefault(names[r.cls], set()).add(r.attr)
    assert got == {f"C{k}": {f"a{j}" for j in range(k)} for k in range(1, levels)}


def test_walk_leaves_names_and_signs_alone(monkeypatch):
    """Only elements that have rows, or hold others that may, are looked at."""
    seen = []
    plain = python_syntax._Walk.visit_plain
    monkeypatch.setattr(python_syntax._Walk, "visit_plain", lambda self, node, *rest: seen.append(type(node).__name__) or plain(self, node, *rest), raising=False)
    rows = python_syntax.file_rows("a.py", "def f(x):\n    if x and not x + 1 > 2:\n        g(x, -1)\n    return x\n")
    assert sorted(seen) == ["BoolOp", "Call", "If"] and [r[1] for r in rows] == ["function"]


def test_rows_go_out_as_arrow_batches(monkeypatch):
    monkeypatch.setattr(python_syntax, "_ROWS_PER_BATCH", 10)
    files = pa.RecordBatch.from_pydict({"path": [f"m{k}.py" for k in range(9)], "source": ["class A:\n    def f(self): return 1\n"] * 8 + ["("]})
    made = list(python_syntax._batches(iter([files])))
    assert all(isinstance(b, pa.RecordBatch) for b in made) and len(made) > 1
    rows = [tuple(r.values()) for b in made for r in b.to_pylist()]
    assert rows == [r for p, s in zip(*files.to_pydict().values()) for r in python_syntax.file_rows(p, s)]


def test_a_reader_of_few_kinds_gets_their_rows_only():
    from codestrata.sources.python_syntax import file_rows

    source = "import a\nclass A(B, x.C):\n    def f(self, y: int):\n        class D(A): pass\n        return [g(z) for z in y if z and z.w]\n"
    plain = lambda rows: [(r[1], r[8], r[12], r[15]) for r in rows if r[1] in ("class", "base")]
    few = file_rows("a.py", source, ("class", "base"))
    assert plain(few) == plain(file_rows("a.py", source)) and {r[1] for r in few} == {"class", "base"}
    assert [r[1] for r in file_rows("b.py", "def (", ("class",))] == ["error"]


def test_rules_read_their_kinds_alone(spark, sf_dir="/root/testdata/sf0.001"):
    """A rule gives the same findings from its own kinds without texts, and sources are written from parts in many tasks."""
    from codestrata.operators import heuristics as h
    from codestrata.plans import corpus
    from codestrata.plans.tables import Facts

    facts = Facts(spark, sf_dir)
    assert corpus.modules(facts, spread=True).rdd.getNumPartitions() > 1
    whole = corpus.Corpus(facts)
    assert sorted(corpus.Corpus(facts, h.kinds("OCP-H-004"), texts=False).rows.select("kind").distinct().toPandas()["kind"]) == sorted(
        r.kind for r in whole.rows.select("kind").distinct().collect() if r.kind in h.kinds("OCP-H-004")
    )
    every = {tuple(r) for r in whole.findings().select("path", "class_name", "method_name", "rule", "message").collect()}
    assert every
    for rule in h.RULE_ORDER:
        own = corpus._ruled(facts, rule).findings().where(f"rule = '{rule}'").select("path", "class_name", "method_name", "rule", "message")
        assert {tuple(r) for r in own.collect()} == {r for r in every if r[3] == rule}
