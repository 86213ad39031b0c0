"""Python source text to rows that complexity and maintainability are computed from.

Rows by kind: ``block`` (a function or class with its start line; ``owner`` is the block
that its branches count for), ``branch``, ``operator`` and ``operand`` (how often one
occurs in a block, in ``num``) and ``lines`` (physical lines by class, and statements).
"""

from __future__ import annotations

import ast
import io
import tokenize
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

METRIC_SCHEMA = "path string, kind string, block int, owner int, name string, form string, cls string, num int, line int"
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_ROWS_PER_BATCH = 50_000
_SKIPPED = frozenset((tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING, tokenize.ENDMARKER))
# Elements with ways or operators of their own, and those that neither have any nor hold others.
_BRANCHING = frozenset((ast.Try, ast.TryStar, ast.BoolOp, ast.For, ast.AsyncFor, ast.While, ast.comprehension, ast.Match, ast.If, ast.IfExp, ast.Assert))
_OPERATING = frozenset((ast.BinOp, ast.AugAssign, ast.UnaryOp, ast.BoolOp, ast.Compare))
_SIGNS = (ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop)


def metric_rows(files: DataFrame) -> DataFrame:
    """Metric rows of ``files(path, source)``. A file that does not parse has one ``error`` row."""
    return files.select("path", "source").where("source is not null").mapInPandas(_batches, METRIC_SCHEMA)


def _batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in METRIC_SCHEMA.split(", ")]
    rows: list[tuple] = []
    for part in parts:
        for path, source in zip(part["path"], part["source"]):
            rows.extend(file_metrics(path, source))
            if len(rows) >= _ROWS_PER_BATCH:
                yield pd.DataFrame(rows, columns=names)
                rows = []
    if rows:
        yield pd.DataFrame(rows, columns=names)


def file_metrics(path: str, source: str) -> list[tuple]:
    try:
        tree, lines = ast.parse(source), line_classes(source)
    except (SyntaxError, ValueError, RecursionError, tokenize.TokenError) as exc:
        return [(path, "error", 0, 0, type(exc).__name__, None, None, 0, 0)]
    rows, counts = [], Counter()
    statements = 0
    # (element, block, owner, class, whether the element stands in a class body); block 0 is the module.
    todo: list[tuple] = [(stmt, 0, 0, None, False) for stmt in tree.body]
    blocks = 0
    while todo:
        node, block, owner, cls, in_class = todo.pop()
        statements += isinstance(node, ast.stmt)
        if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            blocks += 1
            mine = blocks
            if isinstance(node, ast.ClassDef):
                form, inner, params = "class", mine, 0
            else:
                form = "method" if in_class else "closure" if owner else "function"
                inner, params = (owner if form == "closure" else mine), _parameters(node.args)
            rows.append((path, "block", mine, inner, node.name, form, cls if form != "class" else None, params, node.lineno))
            # A function inside a class inside a function is a method of that class.
            is_class = isinstance(node, ast.ClassDef)
            body = [(child, mine, 0 if is_class else inner, node.name if is_class else cls, is_class) for child in node.body]
            rest = [c for c in ast.iter_child_nodes(node) if c not in node.body]
            todo.extend(body + [(c, block, owner, cls, False) for c in rest])
            continue
        form = type(node)
        if form in _BRANCHING and (ways := _branches(node)):
            counts["branch", owner, form.__name__] += ways
        if form in _OPERATING:
            for kind, name in _tokens(node):
                counts[kind, owner, name] += 1
        for field in node._fields:
            value = getattr(node, field, None)
            for child in value if isinstance(value, list) else (value,):
                if isinstance(child, ast.AST) and not isinstance(child, _SIGNS):
                    todo.append((child, block, owner, cls, in_class and isinstance(child, ast.stmt)))
    rows += [(path, kind, owner, owner, name, None, None, n, 0) for (kind, owner, name), n in counts.items()]
    return rows + [(path, "lines", 0, 0, name, None, None, n, 0) for name, n in (lines | {"logical": statements}).items()]


def line_classes(source: str) -> dict[str, int]:
    """How many physical lines hold code, a comment, a text that stands alone, or nothing."""
    code, comment, text = set(), set(), set()
    alone = True
    for kind, _, (first, _), (last, end), line in tokenize.generate_tokens(io.StringIO(source).readline):
        if kind == tokenize.COMMENT:
            comment.add(first)
        elif kind in _SKIPPED:
            alone = alone or kind == tokenize.NEWLINE
        else:
            only = alone and kind == tokenize.STRING and (first != last or not line[end:].strip())
            (text if only else code).update(range(first, last + 1))
            alone = False
    total = len(source.splitlines())
    return {"code": len(code), "comment": len(comment), "text": len(text - code), "blank": total - len(code | comment | text)}


def _parameters(args: ast.arguments) -> int:
    return len(args.posonlyargs) + len(args.args) + len(args.kwonlyargs) + bool(args.vararg) + bool(args.kwarg)


def _branches(node: ast.AST) -> int:
    """Ways through an element beyond the first."""
    if isinstance(node, (ast.Try, ast.TryStar)):
        return len(node.handlers) + bool(node.orelse)
    if isinstance(node, ast.BoolOp):
        return len(node.values) - 1
    if isinstance(node, (ast.For, ast.AsyncFor, ast.While)):
        return 1 + bool(node.orelse)
    if isinstance(node, ast.comprehension):
        return 1 + len(node.ifs)
    if isinstance(node, ast.Match):
        return len([c for c in node.cases if not (isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None)])
    return int(isinstance(node, (ast.If, ast.IfExp, ast.Assert)))


def _tokens(node: ast.AST) -> list[tuple[str, str]]:
    """The operators of an element, and its operands as written."""
    if isinstance(node, (ast.BinOp, ast.AugAssign)):
        ops, operands = [node.op], [node.left, node.right] if isinstance(node, ast.BinOp) else [node.target, node.value]
    elif isinstance(node, ast.UnaryOp):
        ops, operands = [node.op], [node.operand]
    elif isinstance(node, ast.BoolOp):
        ops, operands = [node.op], node.values
    elif isinstance(node, ast.Compare):
        ops, operands = node.ops, [node.left, *node.comparators]
    else:
        return []
    return [("operator", type(op).__name__) for op in ops] + [("operand", _written(x)) for x in operands]


def _written(node: ast.expr) -> str:
    """What ``ast.unparse`` gives, without its costs for a name or a whole number."""
    if isinstance(node, ast.Name):
        return node.id
    return repr(node.value) if isinstance(node, ast.Constant) and type(node.value) is int else ast.unparse(node)
