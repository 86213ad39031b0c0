import random
from collections import deque

import pytest

from codestrata.config import Contract, ProjectConfig, read_contracts
from codestrata.operators import import_contracts
from codestrata.plans.report import Project, contract_relations, run

INI = """
[importlinter]
root_packages =
    app

[importlinter:contract:1]
name = Tiers
type = layers
containers =
    app
layers =
    api
    svc | jobs
    (db)
ignore_imports =
    app.db.legacy.* -> app.api

[importlinter:contract:2]
name = No web in data
type = forbidden
source_modules =
    app.db
forbidden_modules =
    flask
allow_indirect_imports = true

[importlinter:contract:three]
type = independence
modules =
    app.svc
    app.jobs
"""


def plain(imports, contract):
    """The contract by one search per pair, over dictionaries."""

    def group(module):
        fits = [(len(p.split(".")), g) for g, p in contract.groups if module == p or module.startswith(p + ".")]
        return max(fits)[1] if fits else None

    edges = sorted(set(imports))
    out = {}
    for origin, target in contract.pairs:
        modules = sorted({m for e in edges for m in e})
        chain = {m: [m] for m in modules if group(m) == origin}
        queue, hits = deque(sorted(chain)), []
        while queue:
            at = queue.popleft()
            if len(chain[at]) > 1 and (contract.direct_only or (group(at) is not None and not contract.through)):
                continue
            for a, b in edges:
                if a == at and b not in chain:
                    chain[b] = [*chain[at], b]
                    queue.append(b)
        hits = [c for m, c in chain.items() if group(m) == target and len(c) > 1]
        if hits:
            out[origin, target] = min(map(len, hits)) - 1
    return out


def check(spark, imports, contracts):
    groups, pairs, modes, order = contract_relations(spark, contracts)
    edges = spark.createDataFrame(imports, "importer string, imported string")
    ignored = import_contracts.ignored_imports(edges, [(c.name, *p) for c in contracts for p in c.ignored])
    found = import_contracts.breaches(edges, groups, pairs, modes, ignored)
    return {(r.contract, r.origin, r.target): r for r in found.collect()}


def test_ini_file():
    tiers, forbidden, apart = read_contracts(INI)
    assert tiers.name == "Tiers" and set(tiers.pairs) == {("app.svc", "app.api"), ("app.jobs", "app.api"), ("app.svc", "app.jobs"), ("app.jobs", "app.svc"), ("app.db", "app.api"), ("app.db", "app.svc"), ("app.db", "app.jobs")}
    assert tiers.ignored == (("app.db.legacy.*", "app.api"),) and forbidden.direct_only and forbidden.through
    assert apart.name == "three" and set(apart.pairs) == {("app.svc", "app.jobs"), ("app.jobs", "app.svc")}
    with pytest.raises(ValueError, match="unknown type"):
        Contract.of({"type": "other"})


def test_chains_modes_and_ignored_imports(spark):
    imports = [
        ("app.db.rows", "lib.a"), ("lib.a", "lib.b"), ("lib.b", "lib.a"), ("lib.b", "app.api.views"), ("app.db.old", "app.svc.work"), ("app.svc.work", "app.api"),
        ("app.db.legacy.x", "app.api"), ("app.jobs.run", "app.svc"), ("app.svc.loop", "app.svc.loop"), ("lib.a", "flask"), ("app.api", "app.db"),
    ]
    got = check(spark, imports, read_contracts(INI))
    far = got["Tiers", "app.db", "app.api"]
    # Not through app.svc, which is a layer itself, nor by the ignored import.
    assert far.chain == ["app.db.rows", "lib.a", "lib.b", "app.api.views"] and (far.chain_length, far.direct_imports) == (3, 0)
    assert got["Tiers", "app.svc", "app.api"].chain == ["app.svc.work", "app.api"] and got["Tiers", "app.svc", "app.api"].direct_imports == 1
    assert set(got) == {("Tiers", "app.db", "app.api"), ("Tiers", "app.db", "app.svc"), ("Tiers", "app.svc", "app.api"), ("Tiers", "app.jobs", "app.svc"), ("three", "app.jobs", "app.svc")}


def test_against_plain_search(spark):
    rng = random.Random(4)
    names = [f"app.l{k % 6}.m{k}" for k in range(40)] + [f"lib.x{k}" for k in range(30)] + ["ext", "ext.deep"]
    imports = [(rng.choice(names), rng.choice(names)) for _ in range(110)] + [(f"lib.y{k}", f"lib.y{k + 1}") for k in range(5)] + [("app.l5.m5", "lib.y0"), ("lib.y5", "ext.deep")]
    contracts = [
        Contract.of({"name": "a", "type": "layers", "containers": ["app"], "layers": ["l0", ["l1", "l2"], "l3 | l4", "l5"]}),
        Contract.of({"name": "b", "type": "forbidden", "source_modules": ["app.l5", "app.l4.m4"], "forbidden_modules": ["ext", "app.l0.m0"]}),
        Contract.of({"name": "c", "type": "independence", "modules": ["app.l1", "app.l1.m1", "app.l3", "lib.y3"]}),
        Contract.of({"name": "d", "type": "forbidden", "source_modules": ["app"], "forbidden_modules": ["lib"], "allow_indirect_imports": "true"}),
    ]
    got = check(spark, imports, contracts)
    for c in contracts:
        assert {(k[1], k[2]): r.chain_length for k, r in got.items() if k[0] == c.name} == plain(imports, c)
    edges = set(imports)
    for r in got.values():
        assert len(r.chain) == r.chain_length + 1 and all(e in edges for e in zip(r.chain, r.chain[1:]))
    assert check(spark, [], contracts) == {}


def test_project_without_a_contract_report(spark, tmp_path):
    root = tmp_path / "app"
    files = {
        "__init__.py": "", "api/__init__.py": "", "svc/__init__.py": "", "db/__init__.py": "", "help.py": "import app.api.views\n",
        "api/views.py": "import app.svc.work\n", "svc/work.py": "import app.api.views\nimport app.db.rows\n", "db/rows.py": "from app import help\n",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    config = ProjectConfig.of({"package_root": "app", "layers": {"api": ["api"], "svc": ["svc"], "db": ["db"]}, "layer_order": ["api", "svc", "db"], "ignore_dirs": []})
    report = run(Project(spark, str(root), config, native=True))
    chains = {(r.origin, r.target): r.chain for r in report["contract_chains"].collect()}
    assert chains == {("svc", "api"): "app.svc.work -> app.api.views", ("db", "api"): "app.db.rows -> app.help -> app.api.views"}
    assert {(r.from_layer, r.to_layer, r.importer, r.imported) for r in report["violation_imports"].collect()} == {("svc", "api", "app.svc.work", "app.api.views"), ("db", "api", "app.db.rows", "app.api.views")}
    assert report["summary_imports"].first().broken_contracts == 1
    # The names used in the source are resolved as well: nothing but imports here.
    assert {r.name for r in report["call_roots"].collect()} == set() and report["call_edges"].count() == 0
    assert "LAYER_VIOLATION" in {r.type for r in report["violations"].collect()}
