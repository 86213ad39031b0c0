import pytest

from codestrata.operators import heuristics as h

BASE = "class Base:\n    def run(self): return 1\n    def stop(self): return 2\n    def __init__(self): self.a = 1\n"
CHAIN = "    def run(self, x):\n        if isinstance(x, A): return 1\n        elif flag and isinstance(x, B): return 2\n        elif isinstance(x, C): return 3\n"


def _found(made, **more):
    rows, methods, _, project = made
    return sorted((r.class_name, r.method_name, r.rule) for r in h.findings(rows, project, methods, **more).collect())


@pytest.mark.parametrize(
    "body, want",
    [
        ("class C(Base):\n    def run(self):\n        if 1:\n            raise NotImplementedError('x')\n        raise NotImplementedError\n", [("C", "run", "LSP-H-001")]),
        ("class C(Base):\n    def other(self): raise NotImplementedError\n", []),
        ("class C(Base):\n    def run(self): raise errors.NotImplementedError\n", []),
        ("class C(Base, ABC):\n    def run(self): raise NotImplementedError\n    def go(self): return 1\n", []),
        ("class C(Base):\n    def run(self): raise NotImplementedError\n    @abstractmethod\n    def x(self): return 1\n", []),
        ("class C(Base):\n    def run(self): pass\n    def stop(self):\n        'doc'\n    def x(self): return 1\n", [("C", "run", "LSP-H-002"), ("C", "stop", "LSP-H-002")]),
        ("class C(Base):\n    def run(self): ...\n    def x(self): return 1\n", []),
        ("class C:\n    def f(self, b: Base, o: int):\n        return isinstance(o, str) or isinstance(b, C)\n", [("C", "f", "LSP-H-003")]),
        ("class C:\n    def f(self, b: 'Base', *rest: Base, k: Base = 1):\n        return isinstance(b, C) or isinstance(k, C) or isinstance()\n", []),
        ("class C(Base):\n    def __init__(self): Base.__init__(self)\n", [("C", "__init__", "LSP-H-004")]),
        ("class C(Base):\n    def __init__(self): super(C, self).__init__()\n", []),
        ("class C(NamedTuple, object):\n    def __init__(self): self.x = 1\n", []),
        ("@dataclass(frozen=True)\nclass C(Base):\n    def __init__(self): self.x = 1\n", []),
        ("class F(Protocol):\n    def run(self): ...\nclass C(F, Base):\n    def __init__(self): self.x = 1\n", []),
        ("class C(Unknown):\n    def __init__(self): self.x = 1\n", [("C", "__init__", "LSP-H-004")]),
        ("class C(Base):\n    async def __init__(self): self.x = 1\n", []),
        ("class C:\n" + CHAIN, [("C", "run", "OCP-H-001"), ("C", "run", "OCP-H-004")]),
        ("class C:\n    def run(self, x):\n        if isinstance(x, A): return 1\n        elif isinstance(x, B): return 2\n        else:\n            y = 1\n            if isinstance(x, C): return 3\n", []),
        ("class C:\n    def run(self, x):\n        if isinstance(x, A): return 1\n        else:\n            if isinstance(x, B): return 2\n            elif isinstance(x, D): return 3\n", [("C", "run", "OCP-H-001")]),
        ("class C(BaseModel):\n" + CHAIN, []),
        ("class C(Settings):\n" + CHAIN, []),
        ("class C:\n    def run(self, x):\n        match x:\n            case A(): pass\n            case B() | D() | 3: pass\n", [("C", "run", "OCP-H-002")]),
        ("class C:\n    def run(self, x):\n        match x:\n            case A(): pass\n            case [B(), D()]: pass\n            case E() as e: pass\n", []),
        ("class C:\n    def run(self, x):\n        for i in x:\n            while i and x:\n                assert i\n        return isinstance(x, A)\n", [("C", "run", "OCP-H-004")]),
        ("class C:\n    def run(self, x):\n        for i in x:\n            while i and x:\n                assert i\n        def inner(): return isinstance(x, A)\n        return inner\n", []),
        ("class Outer:\n    class C:\n" + CHAIN.replace("    def", "        def").replace("        if", "            if").replace("        elif", "            elif"), []),
        ("class C(make()):\n" + CHAIN, []),
    ],
)
def test_rules(facts, body, want):
    assert _found(facts({"src/m.py": BASE + body})) == want


def test_kept_dynamic_bases_and_excluded_paths(facts):
    made = facts({"src/m.py": "class C(make()):\n" + CHAIN, "tests/x.py": "class D:\n" + CHAIN, "myconf.py": "class E:\n" + CHAIN})
    assert _found(made) == []
    assert {f[0] for f in _found(made, keep_dynamic=True)} == {"C"}
    assert {f[0] for f in _found(made, patterns=("nothing",))} == {"D", "E"}


def test_merged_findings_keep_the_strongest_rule(facts):
    body = BASE + "class C(Base):\n" + CHAIN + "        raise NotImplementedError\n    def stop(self): return 1\n"
    rows, methods, _, project = facts({"src/m.py": body})
    (row,) = h.merge_findings(h.findings(rows, project, methods)).collect()
    # Equal ranks: the substitution rule was emitted first and swallows the other principle.
    assert row.rule == "LSP-H-001" and row.explanation.endswith(" Also detected: OCP-H-001, OCP-H-004.")


def test_candidates(facts):
    body = (
        BASE + "class Face(ABC):\n    @abstractmethod\n    def run(self): ...\n" + "class Both(Base, Face):\n" + CHAIN + "    def stop(self): pass\n"
        + "class Plain:\n    def f(self): return 1\nclass Child(Base): pass\nclass Ocp:\n" + CHAIN + "class Lsp:\n    def f(self, b: Base): return isinstance(b, Lsp)\n"
    )
    rows, methods, _, project = facts({"src/m.py": body})
    found = h.findings(rows, project, methods)
    got = {r.class_name: (r.candidate_type, r.priority, r.reasons) for r in h.candidates(project, found).collect()}
    assert got == {
        "Both": ("both", 2 * 3 + 2 + 1, ["LSP-H-002", "OCP-H-001", "OCP-H-004"]), "Child": ("both", 1, []),
        "Ocp": ("ocp", 4, ["OCP-H-001", "OCP-H-004"]), "Lsp": ("lsp", 2, ["LSP-H-003"]),
    }


def test_candidates_merge(spark):
    rows = spark.createDataFrame(
        [("p", "A", ["b", "a"], 3, "ocp"), ("p", "A", ["a", "c"], 7, "lsp"), ("p", "B", ["z", "y", "z"], 1, "lsp")],
        "path string, class_name string, reasons array<string>, priority long, candidate_type string",
    )
    got = {r.class_name: (r.reasons, r.priority, r.candidate_type) for r in h.merge_candidates(rows).collect()}
    assert got == {"A": (["a", "b", "c"], 7, "both"), "B": (["z", "y", "z"], 1, "lsp")}
