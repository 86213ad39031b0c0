import os

from codestrata.operators import classfacts
from codestrata.sources.files import scan_names, scan_python
from codestrata.sources.python_syntax import file_rows, syntax_rows
from codestrata.sources.sinks import tree_lines

FILES = {
    "pkg/__init__.py": "from pkg import _x\n", "pkg/_x.py": "import pkg._int.m\n", "pkg/_int/__init__.py": "", "pkg/_int/m.py": "a = 1\n", ".hidden/z.py": "b = 2\r\n",
    "sub/__main__.py": "pass\n", "a.py": "pass\n", ".git/x.py": "pass\n", "sub/build/y.py": "pass\n", "notes.txt": "text", "_data/raw.bin": "x",
}


def grown(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe = 1")
    (tmp_path / "empty").mkdir()
    return str(tmp_path)


def test_scan_keeps_every_name(spark, tmp_path):
    root = grown(tmp_path)
    got = {r.path: (r.source, r.error) for r in scan_python(spark, root, [".git", "build"]).collect()}
    want = {k: (v.replace("\r\n", "\n"), None) for k, v in FILES.items() if k.endswith(".py") and not k.startswith(".git") and "build" not in k}
    assert got == want | {"bad.py": (None, "not utf-8")}
    assert {r.path for r in scan_python(spark, f"file://{root}", [], "app").collect()} == {"app/" + k for k in [*FILES, "bad.py"] if k.endswith(".py")}


def test_ignored_folders_are_not_opened(spark, tmp_path):
    root = grown(tmp_path)
    os.chmod(tmp_path / ".git", 0)
    assert scan_python(spark, root, [".git"]).count() == 9
    os.chmod(tmp_path / ".git", 0o755)


def test_many_folders(spark, tmp_path):
    for k in range(90):
        (tmp_path / f"_p{k % 9}" / f"q{k}" / "deep").mkdir(parents=True)
        (tmp_path / f"_p{k % 9}" / f"q{k}" / "deep" / "__init__.py").write_text("")
    assert scan_python(spark, str(tmp_path)).count() == 90


def test_imports_run_through_package_files(spark, tmp_path):
    files = scan_python(spark, grown(tmp_path), [".git", "build"]).where("source is not null")
    edges = classfacts.import_graph(syntax_rows(files), files).collect()
    assert ("pkg._x", "pkg._int.m") in {(r.importer, r.imported) for r in edges}
    assert "pkg" in {r.importer for r in edges}


def test_tree_lists_all_files_and_folders(spark, tmp_path):
    lines = [r.line for r in tree_lines(scan_names(spark, grown(tmp_path), [".git", "build"])).orderBy("place").collect()]
    names = {x.split("── ")[1] for x in lines}
    assert {"notes.txt", "raw.bin", "empty", "__init__.py", ".hidden", "_int"} <= names and "build" not in names


def test_deep_nesting_keeps_the_file():
    wide = "class A:\n    def m(self):\n        return " + " + ".join(["self.x"] * 5000) + "\n"
    kinds = [r[1] for r in file_rows("a.py", wide)]
    assert "error" not in kinds and kinds.count("attr") >= 5000
    chain = "def f(x):\n    if x == 0:\n        pass\n" + "".join(f"    elif x == {k}:\n        pass\n" for k in range(1500))
    assert [r[1] for r in file_rows("b.py", chain)].count("error") == 0
