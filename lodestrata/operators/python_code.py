"""Python sources: imports, functions, SDK calls through bound names, and the closure of local imports. Parsing runs over Arrow batches."""

from __future__ import annotations

import ast
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.tables import dealt
from lodestrata.operators.fixed import FACTORIES, FACTORY_MODULES, NAMING_ARGUMENTS, RESOURCE_KINDS
from lodestrata.operators.graph import closure

FACTS = "path string, ord int, line_no int, end_line int, kind string, service string, value string, resource string"
_BRANCHES = (ast.Import, ast.ImportFrom)


def _literal(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _factory(call: ast.AST | None) -> str | None:
    """The service of ``boto3.client('x')`` and the like."""
    match call:
        case ast.Call(func=ast.Attribute(value=ast.Name(id=module), attr=made), args=[first, *_]) if made in FACTORIES and module in FACTORY_MODULES:
            return _literal(first)
    return None


class Bindings:
    """Services of names: those that factories, methods of bound names, and chains on either give, in the order of the source."""

    def __init__(self, nodes: Iterable[ast.AST]):
        self.known: dict[str, str] = {}
        for node in nodes:
            match node:
                case ast.Assign(targets=[ast.Name(id=name)], value=value) | ast.AnnAssign(target=ast.Name(id=name), value=value):
                    found = _factory(value) or (self.service(value) if isinstance(value, ast.Call) else None)
                    if found:
                        self.known[name] = found

    def service(self, call: ast.Call) -> str | None:
        """The service on which a call's chain of attributes and calls stands."""
        if not isinstance(call.func, ast.Attribute):
            return None
        base = call.func
        while isinstance(base, (ast.Attribute, ast.Call)):
            if made := _factory(base):
                return made
            base = base.value if isinstance(base, ast.Attribute) else base.func
        return self.known.get(base.id) if isinstance(base, ast.Name) else None


def _resource(call: ast.Call) -> str | None:
    """The first argument if it is a text, else the first naming keyword's."""
    if call.args and _literal(call.args[0]) is not None:
        return _literal(call.args[0])
    return next((v for k in call.keywords if k.arg in NAMING_ARGUMENTS and (v := _literal(k.value)) is not None), None)


def _modules(node: ast.AST, folder: list[str]) -> list[str]:
    """Absolute names that an import may mean, in a file of the package ``folder``."""
    if isinstance(node, ast.Import):
        return [a.name for a in node.names]
    base = folder[: len(folder) - node.level + 1] if node.level else []
    base = [*base, *(node.module.split(".") if node.module else [])]
    if not base:
        return []
    whole = ".".join(base)
    return [whole, *(f"{whole}.{a.name}" for a in node.names if a.name != "*")]


def _parsed(batch: pd.DataFrame) -> Iterator[tuple[str, ast.AST | None]]:
    for path, text in zip(batch["path"], batch["text"]):
        try:
            yield path, ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError):
            yield path, None


def _facts_of(path: str, tree: ast.AST | None) -> list[tuple]:
    if tree is None:
        return [(path, 0, 0, 0, "warning", None, "unparseable", None)]
    own: list[tuple] = []
    nodes = list(ast.walk(tree))
    for node in nodes:
        if isinstance(node, ast.Import):
            own += [(node.lineno, node.lineno, "import", None, a.name, None) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            own.append((node.lineno, node.lineno, "import", None, "." * node.level + (node.module or ""), None))
    own += [(n.lineno, n.end_lineno, "function", None, n.name, None) for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    bound = Bindings(nodes)
    for node in nodes:
        if isinstance(node, ast.Call) and _factory(node) is None and (service := bound.service(node)):
            own.append((node.lineno, node.lineno, "call", service, node.func.attr, _resource(node)))
    return [(path, i, *row) for i, row in enumerate(own)]


class PythonFacts:
    """The parser as an Arrow table function, ``python_facts(TABLE(files) PARTITION BY path)`` in SQL, for tables with path and text."""

    returns = FACTS

    def eval(self, files: pa.Table) -> Iterator[pa.Table]:
        rows = [row for path, tree in _parsed({c: files.column(c).to_pylist() for c in ("path", "text")}) for row in _facts_of(path, tree)]
        types = {"string": pa.string(), "int": pa.int32()}
        fields = [pa.field(n, types[t]) for n, t in (c.split() for c in FACTS.split(", "))]
        yield pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=pa.schema(fields))


def python_facts(files: DataFrame) -> DataFrame:
    """FACTS by parsing: imports with their leading dots, functions of the module, and SDK calls through bound names.

    ``value`` is the module, the function or the operation; a factory call itself is none. A file that doesn't
    parse gives a warning.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([row for path, tree in _parsed(batch) for row in _facts_of(path, tree)], columns=[c.split()[0] for c in FACTS.split(", ")])

    return dealt(files.select("path", "text"), "path").mapInPandas(run, FACTS)


def resource_kind(service: Column) -> Column:
    return F.coalesce(*(F.when(service == k, v) for k, v in RESOURCE_KINDS.items()), F.lit("resource"))


def imported_modules(files: DataFrame) -> DataFrame:
    """(path, module): absolute names of what each file (path, text) may import, relative ones resolved by its folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, tree in _parsed(batch):
                folder = path.split("/")[:-1]
                rows += [(path, m) for n in ast.walk(tree or ast.Module([], [])) if isinstance(n, _BRANCHES) for m in _modules(n, folder)]
            yield pd.DataFrame(rows, columns=["path", "module"])

    return dealt(files.select("path", "text"), "path").mapInPandas(run, "path string, module string").where("module <> ''").distinct()


def import_links(files: DataFrame) -> DataFrame:
    """(source, target, kind): files and the files of the tree that they import, by the longest part of a name that is a module.

    Each name is looked up by all its leading parts at once, which is an equi-join of a few rows a name.
    """
    dotted = F.replace(F.regexp_replace("path", r"\.py$", ""), F.lit("/"), F.lit("."))
    own = files.where("path like '%.py'").select(F.regexp_replace(dotted, r"\.__init__$", "").alias("prefix"), F.col("path").alias("target"))
    own = own.groupBy("prefix").agg(F.max("target").alias("target"))
    parts = F.split("module", r"\.", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    asked = imported_modules(files).select("path", "module", F.explode(prefixes).alias("prefix"))
    best = asked.join(own, "prefix").groupBy("path", "module").agg(F.max_by("target", F.length("prefix")).alias("target"))
    return best.select(F.col("path").alias("source"), "target", F.lit("imports").alias("kind")).where("source <> target").distinct()


def import_closure(files: DataFrame, seeds: DataFrame) -> DataFrame:
    """(unit, pos, path): the seeds (unit, path, ord) of each unit in their order, then what they import, at any depth, by path."""
    links = import_links(files)
    reached = closure(links, seeds.select(F.col("path").alias("root")))
    found = seeds.select("unit", F.col("path").alias("root")).join(reached, "root").select("unit", F.col("node").alias("path")).distinct()
    later = found.join(seeds.select("unit", "path"), ["unit", "path"], "left_anti")
    every = seeds.select("unit", F.struct(F.lit(0).alias("late"), F.col("ord").cast("long").alias("ord"), "path").alias("at"))
    every = every.unionByName(later.select("unit", F.struct(F.lit(1).alias("late"), F.lit(0).cast("long").alias("ord"), "path").alias("at")))
    ordered = every.groupBy("unit").agg(F.array_sort(F.collect_list("at")).alias("all"))
    return ordered.select("unit", F.posexplode("all").alias("pos", "at")).select("unit", "pos", "at.path")

