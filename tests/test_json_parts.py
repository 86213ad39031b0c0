import json
import random

import pytest

from codestrata.sources.json_parts import entries
from codestrata.sources.tool_reports import complexity_blocks, complexity_entries, maintainability_entries, maintainability_files, parameter_entries


def _value(rng, depth=0):
    if depth == 3 or rng.random() < 0.4:
        return rng.choice([None, True, 1.5, -7, "", "plain", 'q"uote', "b\\", "\\\\\"", "{[,:]}", "ünïcode 漢", "x" * rng.randrange(90)])
    if rng.random() < 0.5:
        return [_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"{k}\"{{": _value(rng, depth + 1) for k in range(rng.randrange(4))}


@pytest.mark.parametrize("block", [7, 64])
def test_entries_equal_a_whole_parse_wherever_blocks_fall(spark, tmp_path, block):
    rng = random.Random(block)
    docs = [{f"k{n}\\\"": _value(rng) for n in range(12)}, [_value(rng) for _ in range(12)], {}, [], {"one": "y" * 300}]
    for n, doc in enumerate(docs):
        (tmp_path / f"{n}.json").write_text("\n  " * (n % 2) + json.dumps(doc, indent=n % 2 or None, ensure_ascii=bool(n % 3)) + "\n" * n)
    got = {}
    for r in entries(spark, str(tmp_path), block).orderBy("file", "place").collect():
        assert r.problem is None
        got.setdefault(int(r.file.rsplit("/", 1)[1][0]), []).append((r.key, json.loads(r.value)))
    want = {n: list(doc.items()) if isinstance(doc, dict) else [(None, v) for v in doc] for n, doc in enumerate(docs) if doc}
    assert got == want


def test_broken_documents_are_named(spark, tmp_path):
    texts = {"cut": '{"a": [1, 2', "string": '{"a": "x', "two": '{"a": 1} {"b": 2}', "none": " \n ", "scalar": '"text"', "comma": '{"a": 1,}', "colon": '{"a" 1}', "after": "[1] x", "fine": '{"a": 1, "a": 2}'}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    for block in (3, 1000):
        rows = entries(spark, str(tmp_path), block).collect()
        assert {r.file.rsplit("/", 1)[1] for r in rows if r.problem} == set(texts) - {"fine"}
        assert [(r.key, r.value) for r in sorted(rows, key=lambda r: r.place) if r.file.endswith("/fine")] == [("a", "1"), ("a", "2")]


def test_one_report_is_read_by_many_tasks(spark, tmp_path):
    report = {f"m{k}.py": [{"type": "function", "name": "f", "complexity": k, "rank": "A", "lineno": 1}] if k % 7 else "Syntax, {error" for k in range(3000)}
    (tmp_path / "cc.json").write_text(json.dumps(report))
    found = entries(spark, str(tmp_path / "cc.json"), 20_000)
    tasks = found.selectExpr("spark_partition_id() as t").distinct().count()
    assert tasks >= 5
    text = spark.createDataFrame([(json.dumps(report),)], "json string")
    assert complexity_entries(found).exceptAll(complexity_blocks(text)).count() == 0 and complexity_entries(found).count() == sum(1 for k in range(3000) if k % 7)


def test_other_reports(spark, tmp_path):
    mi = {"a.py": {"mi": 2.675, "rank": "C"}, "b.py": {}, "c.py": 3, "d.py": "error", "e.py": {"mi": "x"}}
    (tmp_path / "mi.json").write_text(json.dumps(mi))
    text = spark.createDataFrame([(json.dumps(mi),)], "json string")
    assert {tuple(r) for r in maintainability_entries(entries(spark, str(tmp_path / "mi.json"))).collect()} == {tuple(r) for r in maintainability_files(text).collect()}
    one = {"filename": "a.py", "function_list": [{"start_line": 3, "parameter_count": 1}, {"start_line": 9, "parameter_count": 4}]}
    want = [("a.py", 3, 1, 0), ("a.py", 9, 4, 1)]
    for name, doc in (("one.json", one), ("list.json", [one])):
        (tmp_path / name).write_text(json.dumps(doc))
        assert sorted(tuple(r) for r in parameter_entries(entries(spark, str(tmp_path / name), 16)).collect()) == want
