"""Python files as graph rows: definitions, imports, calls, bases, notes and gaps, read from the syntax tree."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "path string, row string, kind string, name string, owner string, line_start long, line_end long, signature string, keys array<string>, alias_key string"
#: Bytes of a path of names; characters of a signature.
PATH_LIMIT, SIGNATURE_LIMIT = 1024, 200
_NOTE = re.compile(r"\b(TODO|FIXME|HACK|XXX)\b")


def module_path(path: str) -> tuple[str, str, bool]:
    """(module, package, whether the file is the package's own) of a file, joined by double colons."""
    parts = path.removesuffix(".py").removeprefix("src/").split("/")
    own = parts[-1] == "__init__"
    module = parts[:-1] if own else parts
    return "::".join(module), "::".join(module if own else module[:-1]), own


def absolute(module: str, dots: int, package: str) -> str | None:
    """A module's path; leading dots climb from the package, and too many lead nowhere."""
    tail = [p for p in module.split(".") if p]
    if not dots:
        return "::".join(tail) or None
    base = [p for p in package.split("::") if p]
    if dots - 1 > len(base):
        return None
    return "::".join(base[: len(base) - dots + 1] + tail) or None


def key(path: str) -> str:
    return f"py:{path}"


@dataclass
class _Scope:
    """A definition or the module: what its body binds, by import and otherwise."""

    path: str
    kind: str
    above: _Scope | None = None
    first: str | None = None
    bases: list[str] = field(default_factory=list)
    imported: dict[str, set[str]] = field(default_factory=dict)
    bound: set[str] = field(default_factory=set)
    members: set[str] = field(default_factory=set)


class _Reader(ast.NodeVisitor):
    """One walk collects definitions and bindings, and what refers; references are looked up once all is known."""

    def __init__(self, path: str, text: str):
        self.path, self.lines = path, text.split("\n")
        self.module, self.package, self.own = module_path(path)
        self.top = self.scope = _Scope(self.module, "file")
        self.rows: list[dict] = []
        self.later: list = []

    def row(self, row: str, kind: str, name: str | None, at, end=None, owner=None, signature="", keys=(), alias=None) -> None:
        self.rows.append(dict(path=self.path, row=row, kind=kind, name=name, owner=owner if owner is not None else self.scope.path, line_start=at, line_end=end or at, signature=signature, keys=list(keys), alias_key=alias))

    def _define(self, node, kind: str, first: str | None = None) -> None:
        above = self.scope
        inner = _Scope(f"{above.path}::{node.name}" if above.path else node.name, kind, above, first)
        if len(inner.path.encode()) > PATH_LIMIT:
            return self.row("gap", "parse", node.name, node.lineno, node.end_lineno)
        above.members.add(node.name)
        at = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        signature = " ".join(" ".join(self.lines[node.lineno - 1 : node.body[0].lineno]).split())[:SIGNATURE_LIMIT]
        self.row("node", kind, node.name, at, node.end_lineno, signature=signature, keys=[key(inner.path)])
        for d in node.decorator_list:
            self.visit(d)
        self.scope = inner
        if kind == "type":
            names = [_dotted(b) for b in node.bases]
            inner.bases = [n for n in names if n]
            self.later.append(("base", inner, node.lineno, node.end_lineno, None))
        else:
            inner.bound |= {a.arg for a in ast.walk(node.args) if isinstance(a, ast.arg)}
        for child in ast.iter_child_nodes(node):
            if child not in node.decorator_list:
                self.visit(child)
        self.scope = above

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._define(node, "type")

    def visit_FunctionDef(self, node) -> None:
        args = [*node.args.posonlyargs, *node.args.args]
        self._define(node, "test" if node.name.startswith("test_") else "function", args[0].arg if args else None)

    visit_AsyncFunctionDef = visit_FunctionDef

    def _import(self, module: str | None, name: str | None, alias: str | None, line: int, raw: str) -> None:
        if module is None:
            return self.row("gap", "dynamic-or-unsupported-dispatch", raw, line)
        path = f"{module}::{name}" if name else module
        bound, to = (alias, path) if alias else (name, path) if name else (path.split("::")[0],) * 2
        self.scope.imported.setdefault(bound, set()).add(to)
        exported = self.own and self.scope is self.top and (name or alias)
        self.row("import", "IMPORTS", raw, line, keys=[key(path)], alias=key(f"{self.module}::{alias or name}" if self.module else alias or name) if exported else None)

    def visit_Import(self, node: ast.Import) -> None:
        for n in node.names:
            self._import("::".join(n.name.split(".")), None, n.asname, node.lineno, n.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        raw = "." * node.level + (node.module or "")
        for n in node.names:
            if n.name != "*":
                self._import(absolute(node.module or "", node.level, self.package), n.name, n.asname, node.lineno, raw)

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, (ast.Store, ast.Del)):
            self.scope.bound.add(node.id)

    def visit_ExceptHandler(self, node: ast.ExceptHandler) -> None:
        self.scope.bound |= {node.name} - {None}
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        self.later.append(("call", self.scope, node.lineno, node.lineno, node.func))
        self.generic_visit(node)

    def named(self, name: str, scope: _Scope | None, start: _Scope | None = None) -> list[str]:
        """Keys of a bare name, by the scopes around it: shadowed or doubtful names have none; bodies of classes don't count from within."""
        while scope is not None:
            if scope.kind != "type" or scope is start:
                if name in scope.bound:
                    return []
                here, imported = name in scope.members, scope.imported.get(name)
                if here or imported:
                    if here and imported or imported and len(imported) > 1:
                        return []
                    return [key(f"{scope.path}::{name}" if scope.path else name) if here else key(next(iter(imported)))]
            scope = scope.above
        return [key(f"{self.module}::{name}" if self.module else name)]

    def base_keys(self, cls: _Scope) -> list[str]:
        out = []
        for base in cls.bases:
            head, *rest = base.split(".")
            found = self.named(head, cls.above, cls.above)
            if len(found) == 1:
                out.append("::".join([found[0], *rest]))
        return out

    def finish(self) -> None:
        for what, scope, line, end, func in self.later:
            self.scope = scope
            if what == "base":
                for k in self.base_keys(scope):
                    self.row("base", "IMPLEMENTS", None, line, end, keys=[key(scope.path), k])
            elif isinstance(func, ast.Name):
                self._called(func.id, line, self.named(func.id, scope, scope))
            else:
                cls, keys = scope.above, []
                if isinstance(func, ast.Attribute) and isinstance(func.value, ast.Name) and cls is not None and cls.kind == "type" and func.value.id in ("self", "cls") and scope.first == func.value.id:
                    keys = [key(f"{cls.path}::{func.attr}"), *(f"{k}::{func.attr}" for k in self.base_keys(cls))]
                self._called(ast.unparse(func)[:SIGNATURE_LIMIT], line, keys)

    def _called(self, name: str, line: int, keys: list[str]) -> None:
        if keys:
            self.row("call", "CALLS", name, line, keys=keys)
        else:
            self.row("gap", "dynamic-or-unsupported-dispatch", name, line)


def _dotted(node: ast.expr) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (head := _dotted(node.value)):
        return f"{head}.{node.attr}"
    return None


def read(path: str, text: str) -> list[dict]:
    """Rows of one file. A file that doesn't parse is a file row and a gap from the place of the error."""
    reader = _Reader(path, text)
    count = max(1, len(text.splitlines()))
    reader.row("node", "file", path, 1, count, owner="", keys=[key(reader.module)])
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        at = getattr(error, "lineno", None) or 1
        reader.row("gap", "parser-error", type(error).__name__, min(at, count), count)
        return reader.rows
    reader.visit(tree)
    reader.finish()
    reader.scope = reader.top
    for token in tokenize.generate_tokens(io.StringIO(text).readline):
        if token.type == tokenize.COMMENT and (found := _NOTE.search(token.string)):
            reader.row("note", found[1], token.string.lstrip("# ")[:SIGNATURE_LIMIT], token.start[0])
    return reader.rows


def python_rows(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Rows (see ROWS) of all files whose name ends in .py, one file at a time in any order, in parallel.

    ``row`` is node, import, call, base, gap or note. A null content counts as an empty file; null paths are left out.
    Repeated files give their rows again.
    """
    columns = [f.split()[0] for f in ROWS.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [r for p, t in zip(part["p"], part["t"], strict=True) for r in read(p, t or "")]
            yield pd.DataFrame(made, columns=columns)

    return files.where(F.col(path).endswith(".py")).select(F.col(path).alias("p"), F.col(content).cast("string").alias("t")).mapInPandas(run, ROWS)


def graph_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """nodes, node_keys, refs and heritage as the resolver takes them; ids are text: path, kind, first key and line."""
    node = rows.where("row = 'node'").withColumn("id", F.concat_ws("|", "path", "kind", F.get("keys", F.lit(0)), "line_start"))
    file = node.where("kind = 'file'").select(F.col("path"), F.col("id").alias("file_id"))
    keyed = node.select(F.get("keys", F.lit(0)).alias("key"), F.col("id").alias("node_id"))
    # A reference's source is the definition around it in its own file, by its path of names.
    owners = node.select("path", F.substring(F.get("keys", F.lit(0)), F.lit(4), F.lit(PATH_LIMIT)).alias("owner"), "line_start", "id")
    owners = owners.groupBy("path", "owner").agg(F.min_by("id", "line_start").alias("source_id"))
    made = rows.where("row in ('import', 'call')").join(owners, ["path", "owner"], "left")
    refs = made.select(
        F.concat_ws("|", "path", "row", "owner", "line_start", F.concat_ws(",", "keys"), "name").alias("ref_id"), "source_id", "kind", F.col("line_start").alias("line"), "keys", "alias_key"
    ).distinct()
    return {
        "nodes": node.join(file, "path").select("id", "kind", "name", "file_id", "path", "line_start", "line_end", "signature"),
        "node_keys": keyed.distinct(),
        "refs": refs,
        "heritage": rows.where("row = 'base'").select(F.get("keys", F.lit(0)).alias("implementor_key"), F.get("keys", F.lit(1)).alias("trait_key")).distinct(),
    }
