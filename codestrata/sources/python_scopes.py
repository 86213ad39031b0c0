"""Python source text to rows of scopes, bindings and uses.

A scope is a module, class or function and is named by its dotted path. The walk says which
names each scope binds and which dotted expressions it uses, and in which scope of the file a
first name is bound; what they stand for is decided by joins. An expression is a list of parts, where ``()`` is a call and ``?`` an unknown value.

Rows by kind: ``scope`` (form module, class or function), ``near`` (a first name that ``scope``
uses is bound in ``target``, the nearest visible scope of the file that binds it), ``bind`` (a
name, see below), ``base`` and ``use``.
Bindings by form: ``def`` and ``self`` stand for the scope in ``target``; ``import`` for the
dotted name in ``target``; ``value`` for the expression ``parts`` read in scope ``target``;
``other`` for something unknown.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCOPE_SCHEMA = "path string, kind string, scope string, form string, name string, target string, parts array<string>, pos int"
_ROWS_PER_BATCH = 50_000
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def scope_rows(files: DataFrame) -> DataFrame:
    """Scope rows of ``files(path, source)``. A file that does not parse has one ``error`` row."""
    return files.select("path", "source").where("source is not null").mapInPandas(_batches, SCOPE_SCHEMA)


def _batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    for part in parts:
        for path, source in zip(part["path"], part["source"]):
            rows.extend(file_scopes(path, source))
            if len(rows) >= _ROWS_PER_BATCH:
                yield _frame(rows)
                rows = []
    if rows:
        yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SCOPE_SCHEMA.split(", ")]).astype({"pos": "Int32"})


def file_scopes(path: str, source: str) -> list[tuple]:
    try:
        walk = _Scopes(path)
        walk.module(ast.parse(source))
        walk.nearest()
        return walk.rows
    except (SyntaxError, ValueError, RecursionError) as exc:
        return [(path, "error", None, type(exc).__name__, None, None, None, None)]


def module_name(path: str) -> str:
    return path.removesuffix(".py").replace("/", ".").strip(".").removesuffix(".__init__")


class _Scopes:
    def __init__(self, path: str):
        self.path, self.rows = path, []
        self.visible: dict[str, list[set[str]]] = {}
        self.package = module_name(path) if path.endswith("__init__.py") else module_name(path).rpartition(".")[0]

    def emit(self, kind, scope, form=None, name=None, target=None, parts=None, pos=None):
        self.rows.append((self.path, kind, scope, form, name, target, parts, pos))

    def enter(self, scope, form, visible):
        self.emit("scope", scope, form)
        levels = self.visible.setdefault(scope, [])
        for pos, seen in enumerate([scope, *visible]):
            levels.extend(set() for _ in range(pos + 1 - len(levels)))
            levels[pos].add(seen)

    def nearest(self):
        """Where the first name of each expression is bound; a name that the file does not bind has no row."""
        bound: dict[str, set[str]] = {}
        asked = set()
        for _, kind, scope, form, name, target, parts, _ in self.rows:
            if kind == "bind":
                bound.setdefault(name, set()).add(scope)
            if parts is not None:
                asked.add((scope if kind == "use" else target, parts[0]))
        for at, name in sorted(asked):
            holders = bound.get(name, set())
            for scope in sorted(next((level & holders for level in self.visible[at] if level & holders), ())):
                self.emit("near", at, name=name, target=scope)

    def module(self, tree):
        name = module_name(self.path)
        self.enter(name, "module", [])
        for stmt in tree.body:
            self.visit(stmt, name, [], None)

    def visit(self, node, scope, outer, owner):
        """``outer`` are the visible enclosing scopes, ``owner`` the class that ``self`` is an instance of."""
        if isinstance(node, ast.ClassDef):
            return self.visit_class(node, scope, outer)
        if isinstance(node, _FUNCTIONS):
            return self.visit_function(node, scope, outer, None)
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            return self.visit_import(node, scope)
        if isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign, ast.NamedExpr)):
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                self.bind(target, node.value if not isinstance(node, ast.AugAssign) else None, scope, owner)
        elif isinstance(node, (ast.For, ast.AsyncFor, ast.comprehension)):
            self.bind(node.target, None, scope, owner)
        elif isinstance(node, ast.withitem) and node.optional_vars is not None:
            self.bind(node.optional_vars, node.context_expr, scope, owner)
        elif isinstance(node, ast.ExceptHandler) and node.name:
            self.emit("bind", scope, "other", node.name)
        elif isinstance(node, ast.Lambda):
            for arg in _arguments(node.args):
                self.emit("bind", scope, "other", arg.arg)
        elif isinstance(node, (ast.Name, ast.Attribute)):
            itself = isinstance(node, ast.Name) and owner is not None and node.id == owner[1]
            if isinstance(node.ctx, ast.Load) and not itself:
                self.emit("use", scope, parts=_parts(node))
            return self.below(node, scope, outer, owner)
        for child in ast.iter_child_nodes(node):
            self.visit(child, scope, outer, owner)

    def below(self, node, scope, outer, owner):
        """The parts of a chain are one use; what its calls and indexes hold is visited on its own."""
        while isinstance(node, ast.Attribute):
            node = node.value
            if isinstance(node, ast.Call):
                for child in ast.iter_child_nodes(node):
                    self.visit(child, scope, outer, owner)
                return
        if not isinstance(node, ast.Name):
            self.visit(node, scope, outer, owner)

    def bind(self, target, value, scope, owner):
        if isinstance(target, (ast.Tuple, ast.List)):
            for item in target.elts:
                self.bind(item, None, scope, owner)
            return
        at, name = None, None
        if isinstance(target, ast.Name):
            at, name = scope, target.id
        elif isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and owner and target.value.id == owner[1]:
            at, name = owner[0], target.attr
        if name is not None:
            parts = _parts(value) if value is not None else None
            known = parts is not None and parts[0] != "?"
            self.emit("bind", at, "value" if known else "other", name, scope if known else None, parts if known else None)

    def visit_class(self, node, scope, outer):
        mine = f"{scope}.{node.name}"
        self.emit("bind", scope, "def", node.name, mine)
        self.enter(mine, "class", [scope, *outer])
        for pos, base in enumerate(node.bases):
            parts = _parts(base)
            self.emit("base", mine, target=scope, parts=parts, pos=pos)
            self.emit("use", mine, parts=parts)
        for decorator in node.decorator_list:
            self.visit(decorator, scope, outer, None)
        for stmt in node.body:
            if isinstance(stmt, _FUNCTIONS):
                self.visit_function(stmt, mine, [scope, *outer], mine)
            else:
                self.visit(stmt, mine, [scope, *outer], None)

    def visit_function(self, node, scope, outer, cls):
        """Names of a class body are not visible in its methods."""
        mine = f"{scope}.{node.name}"
        self.emit("bind", scope, "def", node.name, mine)
        self.enter(mine, "function", outer if cls else [scope, *outer])
        static = any(isinstance(d, ast.Name) and d.id == "staticmethod" for d in node.decorator_list)
        args = _arguments(node.args)
        owner = (cls, args[0].arg) if cls and args and not static else None
        for place, arg in enumerate(args):
            if owner and place == 0:
                self.emit("bind", mine, "self", arg.arg, cls)
            elif isinstance(arg.annotation, (ast.Name, ast.Attribute)):
                self.emit("bind", mine, "value", arg.arg, scope, [*_parts(arg.annotation), "()"])
            else:
                self.emit("bind", mine, "other", arg.arg)
        for decorator in node.decorator_list:
            self.visit(decorator, scope, outer, None)
        for child in [node.args, *([node.returns] if node.returns else []), *node.body]:
            self.visit(child, mine, outer if cls else [scope, *outer], owner)

    def visit_import(self, node, scope):
        if isinstance(node, ast.Import):
            for alias in node.names:
                name = alias.asname or alias.name.partition(".")[0]
                self.emit("bind", scope, "import", name, alias.name if alias.asname else name)
            return
        up = self.package.split(".")[: max(len(self.package.split(".")) - node.level + 1, 0)] if node.level else []
        origin = ".".join([*up, *([node.module] if node.module else [])])
        for alias in node.names:
            self.emit("bind", scope, "import", alias.asname or alias.name, f"{origin}.{alias.name}")


def _arguments(args: ast.arguments) -> list[ast.arg]:
    return [*args.posonlyargs, *args.args, *([args.vararg] if args.vararg else []), *args.kwonlyargs, *([args.kwarg] if args.kwarg else [])]


def _parts(node: ast.expr) -> list[str]:
    """The parts of a chain of names, attributes and calls; any other start is ``?``."""
    parts: list[str] = []
    while True:
        if isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        elif isinstance(node, ast.Call):
            parts.append("()")
            node = node.func
        elif isinstance(node, ast.Await):
            node = node.value
        else:
            parts.append(node.id if isinstance(node, ast.Name) else "?")
            return parts[::-1]
