"""Chunks of Python sources: modules, classes, functions and methods, with their hierarchy and spans."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CHUNKS

#: Depth of the concrete syntax tree to which exact spans reach, counted from the module.
SPAN_DEPTH = 3
SMALL_TEXT, TEXT_WINDOW = 200, 100


def _id(path: str, kind: str, name: str, parent: str | None, start: int, end: int, code: str) -> str:
    payload = "\n    ".join(str(x) for x in (path, kind, name, parent, start, end, None, None, code)).strip()
    return "primary_" + hashlib.sha256(payload.encode("utf-8")).hexdigest()[:8]


def _unparsed_imports(node: ast.AST) -> list[str]:
    return [ast.unparse(n) for n in ast.walk(node) if isinstance(n, ast.Import | ast.ImportFrom)]


@dataclass
class Source:
    """A source text with its lines, their places in bytes, and exact spans by line range."""

    path: str
    raw: bytes
    text: str
    tree: ast.Module
    lines: list[bytes] = field(init=False)
    starts: list[int] = field(init=False)
    exact: dict[tuple[int, int], tuple[int, int]] = field(init=False)

    def __post_init__(self) -> None:
        self.lines = self.text.encode("utf-8").split(b"\n")
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)
        raw_starts = [0]
        for line in self.raw.split(b"\n"):
            raw_starts.append(raw_starts[-1] + len(line) + 1)
        self.exact = {}
        if self.raw[:1].strip():
            self.exact[1, len(self.lines)] = (0, len(self.raw))
        if len(raw_starts) == len(self.starts):
            self._spans(self.tree.body, 1, raw_starts)

    def _spans(self, body: list[ast.stmt], depth: int, at: list[int]) -> None:
        """Spans of definitions and imports as a concrete syntax tree has them; the later of equal line ranges stays."""
        for node in body:
            own = depth + bool(getattr(node, "decorator_list", None))
            plain = isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef | ast.Import) or isinstance(node, ast.ImportFrom) and node.module != "__future__"
            if plain and own <= SPAN_DEPTH:
                self.exact[node.lineno, node.end_lineno] = (at[node.lineno - 1] + node.col_offset, at[node.end_lineno - 1] + node.end_col_offset)
            if own + 2 <= SPAN_DEPTH and isinstance(getattr(node, "body", None), list):
                self._spans([s for s in node.body if isinstance(s, ast.stmt)], own + 2, at)

    def code(self, node: ast.AST) -> str:
        a, b = node.lineno - 1, node.end_lineno - 1
        if a == b:
            part = self.lines[a][node.col_offset : node.end_col_offset]
        else:
            part = b"\n".join([self.lines[a][node.col_offset :], *self.lines[a + 1 : b], self.lines[b][: node.end_col_offset]])
        return part.decode("utf-8").strip()

    def span(self, first: int, last: int) -> tuple[int, int]:
        return self.exact.get((first, last), (self.starts[first - 1], self.starts[last]))


def _chunk(path: str, kind: str, code: str, symbol: dict, span: tuple[int, int, int, int], tree: dict, language: str = "python", chunk: str = "", metadata: dict | None = None) -> dict:
    return {
        "chunk_id": chunk,
        "file_path": path,
        "language": language,
        "chunk_type": kind,
        "code": code,
        "ast": {"symbol_type": kind, "name": None, "parent": None, "docstring": None, "decorators": [], "imports": [], "node_type": None} | symbol,
        "span": {"start_byte": span[0], "end_byte": span[1], "start_line": span[2], "end_line": span[3], "char_count": None},
        "hierarchy": {"parent_id": None, "children_ids": [], "depth": 0, "is_primary": True, "is_extracted": False, "lineage": [], "sibling_index": 0} | tree,
        "metadata": metadata or {},
    }


def source_chunks(path: str, source: Source) -> list[dict]:
    """The module, then its classes, functions and methods in source order."""
    out: list[dict] = []
    counts: dict[str, int] = {}

    def emit(kind: str, name: str, parent: str | None, code: str, first: int, last: int, node: ast.AST, above: dict | None) -> dict:
        tree: dict = {}
        chunk = _id(path, kind, name, parent, first, last, code)
        if above:
            nth = counts.get(above["chunk_id"], 0)
            counts[above["chunk_id"]] = nth + 1
            up = above["hierarchy"]
            tree = {"parent_id": above["chunk_id"], "depth": up["depth"] + 1, "lineage": [*up["lineage"], above["chunk_id"]], "sibling_index": nth}
            up["children_ids"].append(chunk)
        symbol = {"name": name, "parent": parent, "docstring": ast.get_docstring(node), "decorators": [ast.unparse(d) for d in getattr(node, "decorator_list", [])], "imports": _unparsed_imports(node)}
        out.append(_chunk(path, kind, code, symbol, (*source.span(first, last), first, last), tree | {"children_ids": []}, chunk=chunk))
        return out[-1]

    def visit(node: ast.AST, above: dict) -> None:
        for child in ast.iter_child_nodes(node):
            inside = above
            if isinstance(child, ast.ClassDef):
                inside = emit("class", child.name, "module", source.code(child), child.lineno, child.end_lineno, child, above)
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                if isinstance(node, ast.Module):
                    emit("function", child.name, "module", source.code(child), child.lineno, child.end_lineno, child, above)
                elif isinstance(node, ast.ClassDef):
                    emit("method", child.name, node.name, source.code(child), child.lineno, child.end_lineno, child, above)
            visit(child, inside)

    module = emit("module", PurePosixPath(path).stem, None, source.text, 1, len(source.lines), source.tree, None)
    visit(source.tree, module)
    return out


def text_windows(path: str, raw: bytes) -> list[dict]:
    """A text file: one chunk up to 200 lines, else one for each 100; every span says line 1."""
    lines = raw.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    step = len(lines) if len(lines) <= SMALL_TEXT else TEXT_WINDOW
    out = []
    for i, a in enumerate(range(0, len(lines), step)):
        code = "\n".join(lines[a : a + step])
        n = len(lines[a : a + step])
        chunk = "text_" + hashlib.sha256(f"{code}_{i}".encode()).hexdigest()[:8]
        symbol = {"symbol_type": "text", "name": PurePosixPath(path).name}
        out.append(_chunk(path, "text", code, symbol, (None, None, 1, n), {}, "text", chunk, {"file_type": "text", "chunk_index": i, "total_lines": n}))
    return out


def python_chunks(path: str, raw: bytes | None) -> list[dict]:
    """Chunks of one Python file; none where it does not parse; text windows where it is no UTF-8 or cannot be walked."""
    raw = raw or b""
    try:
        text = raw.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
        return source_chunks(path, Source(path, raw, text, ast.parse(text)))
    except SyntaxError:
        return []
    except (UnicodeDecodeError, RecursionError, ValueError):
        return text_windows(path, raw)


def chunk_python(files: DataFrame) -> DataFrame:
    """Chunks of ``files(path, content)``: parsing is per file, in Arrow batches of whole files."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([c for p, raw in zip(part["path"], part["content"], strict=True) if p is not None for c in python_chunks(p, raw)], columns=[x.split()[0] for x in ("chunk_id", "file_path", "language", "chunk_type", "code", "ast", "span", "hierarchy", "metadata")])

    return files.select("path", "content").mapInPandas(run, CHUNKS)


def with_parents(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``parent_type`` and ``parent_name`` of the chunk that ``hierarchy.parent_id`` names in the same file; null at the top."""
    up = chunks.select(F.col("file_path"), F.col("chunk_id").alias("_up"), F.col("chunk_type").alias("parent_type"), F.col("ast.name").alias("parent_name")).dropDuplicates(["file_path", "_up"])
    return chunks.withColumn("_up", F.col("hierarchy.parent_id")).join(up, ["file_path", "_up"], "left").drop("_up")


class PythonChunks:
    """Table function ``python_chunks(path, content)``: id, type, name, parent id and lines of each chunk."""

    def eval(self, path: str, content: bytes):
        for c in python_chunks(path, content):
            yield c["chunk_id"], c["chunk_type"], c["ast"]["name"], c["hierarchy"]["parent_id"], c["span"]["start_line"], c["span"]["end_line"]


def register(spark: SparkSession) -> None:
    """Makes ``python_chunks`` a table function of SQL, for lateral joins."""
    spark.udtf.register("python_chunks", F.udtf(PythonChunks, returnType="chunk_id string, chunk_type string, name string, parent_id string, start_line bigint, end_line bigint"))


def line_spans(files: DataFrame, text: str = "text", key: str = "path") -> DataFrame:
    """(key, line, start_byte, end_byte): byte place of each line, spans starting at column 0, by prefix sums within the row."""
    lines = F.split(F.col(text), "\n", -1)
    sizes = F.transform(lines, lambda x: F.octet_length(x).cast("bigint") + 1)
    ends = F.aggregate(sizes, F.array().cast("array<bigint>"), lambda acc, n: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint")) + n))
    return files.select(key, F.posexplode(F.arrays_zip(sizes.alias("n"), ends.alias("e"))).alias("line", "x")).select(key, (F.col("line") + 1).cast("bigint").alias("line"), (F.col("x.e") - F.col("x.n")).alias("start_byte"), F.col("x.e").alias("end_byte"))
