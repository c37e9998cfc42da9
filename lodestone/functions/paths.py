"""Paths, names and requirement lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import split_newlines, strip

# Frameworks in the order in which a path is searched for them.
FRAMEWORKS = ("crewai", "langgraph", "langchain", "autogen", "llamaindex", "dspy", "haystack", "semantic_kernel", "fastapi", "flask", "django")
# Languages by suffix.
LANGUAGES = {".py": "python", ".md": "markdown", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml"}
# Endings that are no part of a repository's name.
NAME_ENDINGS = ("_test", "_copy", "_backup", "_temp", "_local")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """The last dot and what follows, of a name that neither starts nor ends with it; else empty."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def repo_name(url: Column) -> Column:
    """Last part of a URL without trailing slashes and ``.git``."""
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), r"\.git$", "")


def folder_repo_name(name: Column) -> Column:
    return F.regexp_replace(name, f"(?i)({'|'.join(NAME_ENDINGS)})$", "")


def framework(path: Column) -> Column:
    """The first known framework anywhere in the path; else the part after ``codebases``, or else ``repos``, up to ``_``; else unknown."""
    low = F.lower(path)
    out = None
    for name in FRAMEWORKS:
        out = (F.when if out is None else out.when)(low.contains(name), name)
    parts = F.split(F.translate(path, "\\", "/"), "/")
    after = F.when(F.array_contains(parts, "codebases"), F.array_position(parts, "codebases")).when(F.array_contains(parts, "repos"), F.array_position(parts, "repos"))
    part = F.element_at(F.split(F.get(parts, after.cast("int")), "_"), 1)
    return out.when(part.isNotNull() & (part != "") & ~part.isin("raw", "processed"), part).otherwise("unknown")


def language(existing: Column, path: Column) -> Column:
    """The language given, if any; else by suffix; else text."""
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.when(existing != "", existing), F.element_at(known, F.lower(suffix(path))), F.lit("text"))


def requirement(line: Column) -> Column:
    """A package's name: the line up to ``==``, ``>=`` or ``<=``."""
    return strip(F.element_at(F.split(line, "==|>=|<="), 1))


def requirements(content: Column, more: str = "", options: bool = True) -> Column:
    """Package names of a requirements file; comments and empty lines are no packages. ``more``: further cutting operators."""
    cut = "==|>=|<=" + more
    named = F.transform(F.filter(F.transform(split_newlines(content), strip), lambda x: (x != "") & ~x.startswith("#")), lambda x: strip(F.element_at(F.split(x, cut), 1)))
    return F.filter(named, lambda x: (x != "") & (F.lit(options) | ~x.startswith("-")))


def pruned(path: Column, excluded: tuple[str, ...]) -> Column:
    """Whether a directory of the path is excluded or hidden, or the file is hidden."""
    dirs = F.split(path, "/")
    inner = F.slice(dirs, F.lit(1), F.size(dirs) - 1)
    return F.exists(inner, lambda d: d.isin(*excluded) | d.startswith(".")) | file_name(path).startswith(".")
