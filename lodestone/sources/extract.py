"""Extraction from source text: imports, exports, symbols, resolution.

Regular structure is matched by JVM expressions; languages that need a parser go through an Arrow kernel
that reads one file at a time.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut
from .blocks import LEXIS, Blocks
from .script import Script

# Declarations that an export may have, in the order in which they are reported.
EXPORT_KINDS = (("function", r"(?:async\s+)?function"), ("class", "class"), ("interface", "interface"), ("type", "type"), ("const", "const"), ("enum", "enum"))


def imports(text: Column) -> Column:
    """Distinct relative specifiers of import and export clauses, which may span lines."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"""(?:import|export)\s+[^;'"]*?from\s+['"](\.[^'"]+)['"]"""), F.lit(1)))


def exports(text: Column) -> Column:
    """array<struct<name, type>>: exported declarations by kind, then the default export."""
    each = [F.transform(F.regexp_extract_all(text, F.lit(rf"export\s+{word}\s+(\w+)"), F.lit(1)), _named(kind)) for kind, word in EXPORT_KINDS]
    default = F.when(text.rlike(r"export\s+default"), F.array(F.struct(F.lit("default").alias("name"), F.lit("default").alias("type"))))
    return F.concat(*each, F.coalesce(default, F.array().cast("array<struct<name:string,type:string>>")))


def _named(kind: str):
    return lambda name: F.struct(name.alias("name"), F.lit(kind).alias("type"))


def reexports(text: Column) -> Column:
    """Names that brace lists export: ``export { a, b as c }`` gives a and c."""
    lists = F.regexp_extract_all(text, F.lit(r"export\s*\{([^}]*)\}"), F.lit(1))
    names = F.flatten(F.transform(lists, lambda x: F.split(x, ",")))
    return F.array_distinct(F.filter(F.transform(names, lambda n: F.trim(F.regexp_replace(n, r"^.*\sas\s+", ""))), lambda n: n != ""))


def specifiers(text: Column) -> Column:
    """Every specifier, relative or not, of import, export and require."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"""from\s+['"]([^'"]+)['"]"""), F.lit(1)), F.regexp_extract_all(text, F.lit(r"""require\(\s*['"]([^'"]+)['"]"""), F.lit(1)), F.regexp_extract_all(text, F.lit(r"""import\s+['"]([^'"]+)['"]"""), F.lit(1))))


def package(specifier: Column) -> Column:
    """The package of a bare specifier; null for relative, absolute and built-in ones."""
    parts = F.split(specifier, "/")
    scoped = F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    bare = ~specifier.startswith(".") & ~specifier.startswith("/") & ~specifier.startswith("node:")
    return F.when(bare, F.when(specifier.startswith("@"), scoped).otherwise(F.get(parts, F.lit(0))))


def import_clauses(text: Column) -> Column:
    """array<struct<form, names, specifier>> of namespace, default, named and side-effect imports."""
    form = r"""import\s+(?:type\s+)?(\*\s+as\s+\w+|\w+|\{[^}]*\})\s+from\s+['"]([^'"]+)['"]"""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(form), F.lit(1)).alias("c"), F.regexp_extract_all(text, F.lit(form), F.lit(2)).alias("s"))
    kind = lambda c: F.when(c.startswith("*"), "namespace").when(c.startswith("{"), "named").otherwise("default")
    name = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"^\*\s+as\s+", ""), r"[{}]", ""))
    clauses = F.transform(found, lambda x: F.struct(kind(x["c"]).alias("form"), name(x["c"]).alias("names"), x["s"].alias("specifier")))
    effects = F.transform(F.regexp_extract_all(text, F.lit(r"""import\s+['"]([^'"]+)['"]"""), F.lit(1)), lambda s: F.struct(F.lit("side-effect").alias("form"), F.lit("").alias("names"), s.alias("specifier")))
    return F.concat(clauses, effects)


def joined_path(folder: Column, specifier: Column) -> Column:
    """``specifier`` seen from ``folder``, with . and .. walked."""
    parts = F.filter(F.split(F.concat_ws("/", folder, specifier), "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == "..", acc).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(walked, "/")


def resolve(uses: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, specifier, target): the first candidate path that is a file.

    A .js specifier is tried as .tsx and .ts first, then as it stands, then with .ts, .tsx and as a
    folder's index. Candidates are one equi-join with the paths; the first in order wins. Paths are often made
    of a few narrow columns, whose size says nothing of theirs: so they are sorted and never broadcast."""
    folder = F.regexp_replace("file_path", r"/?[^/]*$", "")
    path = joined_path(folder, F.col("specifier"))
    stem = F.regexp_replace(path, r"\.js$", "")
    js = F.col("specifier").endswith(".js")
    tried = F.array_compact(F.array(F.when(js, F.concat(stem, F.lit(".tsx"))), F.when(js, F.concat(stem, F.lit(".ts"))), path, *[F.concat(path, F.lit(x)) for x in (".ts", ".tsx", "/index.ts", "/index.tsx")]))
    rows = uses.select("file_path", "specifier", F.posexplode(tried).alias("pos", "target"))
    hits = rows.join(files.select(F.col("file_path").alias("target")).distinct().hint("merge"), "target")
    return hits.groupBy("file_path", "specifier").agg(F.min_by("target", "pos").alias("target"))


SYMBOLS = "file_path string, name string, kind string, exported boolean, line_start int, line_end int"
EDGES = "file_path string, source string, target string, edge_type string"


class _Python(ast.NodeVisitor):
    """Symbols and edges of one Python file; methods are named after their class."""

    def __init__(self):
        self.symbols: list[tuple] = []
        self.edges: list[tuple] = []
        self.scope: list[str] = []
        self.caller: str | None = None

    def _add(self, node: ast.AST, kind: str) -> str:
        name = ".".join([*self.scope, node.name])
        self.symbols.append((name, kind, not node.name.startswith("_"), node.lineno, node.end_lineno))
        if self.scope:
            self.edges.append((self.scope[-1], name, "HAS_METHOD"))
        return name

    def visit_ClassDef(self, node: ast.ClassDef) -> None:  # noqa: N802
        name = self._add(node, "class")
        self.edges += [(name, _dotted(b), "EXTENDS") for b in node.bases if _dotted(b)]
        self.scope.append(node.name)
        for child in node.body:
            self.visit(child)
        self.scope.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:  # noqa: N802
        if self.caller:
            return  # nested functions are not symbols of their own
        self.caller = self._add(node, "function")
        for child in node.body:
            self.visit(child)
        self.caller = None

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Call(self, node: ast.Call) -> None:  # noqa: N802
        target = _dotted(node.func)
        if self.caller and target and not hasattr(__builtins__, target) and target not in _BUILTIN:
            self.edges.append((self.caller, re.sub(r"^(self|cls)\.", "", target), "CALLS"))
        self.generic_visit(node)


_BUILTIN = frozenset(dir(__import__("builtins")))


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        inner = _dotted(node.value)
        return f"{inner}.{node.attr}" if inner else node.attr
    return None


#: Languages that ``script`` reads.
SCRIPTS = ("typescript", "tsx", "javascript", "jsx")
def parse(language: str, text: str) -> tuple[list[tuple], list[tuple]]:
    """(symbols, edges) of a file; what can't be parsed has none."""
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return [], []
        visitor = _Python()
        visitor.visit(tree)
        return visitor.symbols, visitor.edges
    if language in SCRIPTS:
        script = Script(text)
        return script.symbols, list(dict.fromkeys(script.edges))
    if language in LEXIS:
        blocks = Blocks(language, text)
        return sorted(blocks.symbols, key=lambda x: (x[3], -x[4])), blocks.edges
    return [], []


def unused_imports(files: DataFrame) -> DataFrame:
    """(file_path, form, specifier, note) of the imports of files (file_path, text) none of whose bound names
    occurs outside import lines; an import that binds none is told as a side effect."""
    body = F.split(F.regexp_replace("text", r"(?m)^\s*import\b.*$", ""), r"[^\w$]+")
    bound = F.filter(F.transform(F.split("names", r"\s*,\s*"), lambda n: F.trim(F.regexp_replace(n, r"^.*\bas\s+", ""))), lambda n: n != "")
    rows = files.select("file_path", body.alias("body"), F.inline(import_clauses(F.col("text"))))
    effect = F.col("form") == "side-effect"
    unused = rows.where(effect | ~F.arrays_overlap(bound, "body"))
    return unused.select("file_path", "form", "specifier", F.when(effect, "side effect only").otherwise("not used").alias("note"))


def export_ranges(files: DataFrame, most: int = 6, window: int = 60) -> DataFrame:
    """(file_path, start_line, end_line) around the first ``most`` lines that export, each bounded by the next
    such line, the window and the file's end."""
    lines = F.split("text", "\n")
    sites = F.filter(F.transform(lines, lambda x, k: F.when(x.startswith("export "), k + 1)), lambda k: k.isNotNull())
    rows = files.select("file_path", F.size(lines).alias("total"), sites.alias("sites"))
    each = rows.select("file_path", "total", "sites", F.posexplode(F.slice("sites", 1, most)).alias("pos", "start_line"))
    end = F.least(F.coalesce(F.get("sites", F.col("pos") + 1) - 1, F.col("total")), F.col("start_line") + window - 1, F.col("total"))
    return each.select("file_path", "start_line", end.cast("int").alias("end_line"))


FLOW = "file_path string, source string, target string, edge_type string"


def flows(files: DataFrame) -> DataFrame:
    """Data flow of scripts (file_path, language, text): PRODUCES, CONSUMES, DATA_FLOWS_TO and TRIGGERS, the last
    also from who emits an event to who listens for it, in whatever files; an edge once for each file. Each file is
    read once: what is found is written, since three readers follow."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [(path, *edge) for path, language, text in zip(*(part.column(c).to_pylist() for c in ("file_path", "language", "text")), strict=True) if language in SCRIPTS for edge in dict.fromkeys(Script(text or "").flow)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["file_path", "source", "target", "edge_type"])

    raw = cut(files.select("file_path", "language", "text").mapInArrow(run, FLOW))
    emitted = raw.where("edge_type = 'EMITS'").select("file_path", "source", F.col("target").alias("event"))
    heard = raw.where("edge_type = 'LISTENS'").select(F.col("source").alias("event"), "target").distinct()
    met = emitted.join(heard, "event").select("file_path", "source", "target", F.lit("TRIGGERS").alias("edge_type"))
    return raw.where("edge_type not in ('EMITS', 'LISTENS')").unionByName(met).distinct()


def parsed(files: DataFrame, edges: bool = False) -> DataFrame:
    """Symbols (or edges) of all files (file_path, language, text), by an Arrow kernel."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file_path", "source", "target", "edge_type"] if edges else ["file_path", "name", "kind", "exported", "line_start", "line_end"]
        types = [pa.string()] * 4 if edges else [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32()]
        for part in parts:
            rows = [(path, *row) for path, language, text in zip(*(part.column(c).to_pylist() for c in ("file_path", "language", "text")), strict=True) for row in parse(language or "", text or "")[1 if edges else 0]]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return files.select("file_path", "language", "text").mapInArrow(run, EDGES if edges else SYMBOLS)
