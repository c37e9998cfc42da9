"""Questions about code by template, and when two pieces of code differ in purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Question templates by category, descriptions by word, and keywords of purpose.
TEMPLATES = {
    "class": (
        "How does the {name} class work in Python?",
        "What is the implementation of the {name} class?",
        "How to create a {name} class?",
        "Show me the {name} class implementation",
        "Explain the {name} class structure",
    ),
    "function": (
        "How does {name} function work in Python?",
        "What is the implementation of {name}?",
        "How to implement the {name} function?",
        "Show the code for {name} function",
        "Explain how {name} works",
    ),
    "method": (
        "How does the {name} method work in Python?",
        "What is the implementation of {name} method?",
        "How to implement the {name} method?",
        "Show me the {name} method code",
        "Explain the {name} method",
    ),
    "async_function": (
        "How does async {name} work in Python?",
        "What is the async implementation of {name}?",
        "How to implement async {name}?",
        "Show the async {name} code",
        "Explain async {name} function",
    ),
    "module": (
        "How to implement {name} module?",
        "What's the structure of {name}?",
        "Show the {name} module implementation",
        "Explain the {name} module",
        "How does {name} module work?",
    ),
    "workflow": (
        "How to create a {name} workflow?",
        "What's the pattern for {name}?",
        "Show the {name} workflow implementation",
        "Explain the {name} workflow",
        "How does the {name} workflow work?",
    ),
}
DESCRIPTIONS = (
    (("stategraph", "workflow"), "building a stateful workflow"),
    (("agent",), "creating an AI agent"),
    (("tool",), "implementing a tool"),
    (("async",), "async operations"),
    (("api", "request"), "API interactions"),
    (("database", "sql"), "database operations"),
    (("parse",), "parsing data"),
    (("format",), "formatting output"),
    (("template",), "creating templates"),
    (("filter",), "filtering data"),
    (("search",), "search functionality"),
    (("create", "build"), "building {name}"),
    (("",), "implementing {name}"),
)
KEYWORDS = ("parse", "format", "create", "delete", "update", "read", "write", "input", "output", "agent", "tool", "graph", "state", "workflow", "template", "filter", "search", "database", "api", "async")


def category(code: Column, symbol: Column) -> Column:
    """Template category: async functions and methods, then the symbol's own, then workflow words, then function."""
    low = F.lower(code)
    is_async = strip(code).startswith("async ") | F.substring(code, 1, 100).contains("async def")
    return (
        F.when(is_async & symbol.isin("function", "method"), "async_function")
        .when(symbol.isin(*TEMPLATES), symbol)
        .when(low.contains("graph") | low.contains("workflow") | low.contains("state"), "workflow")
        .otherwise("function")
    )


def question(code: Column, symbol: Column, name: Column, variation: Column | int = 0) -> Column:
    """The question of a variation number, taken modulo the number of templates; a null name is written None."""
    table = F.create_map(*(x for k, v in TEMPLATES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    variation = F.lit(variation) if isinstance(variation, int) else variation
    template = F.get(F.element_at(table, category(code, symbol)), F.pmod(variation, F.lit(5)).cast("int"))
    return F.replace(template, F.lit("{name}"), F.coalesce(name, F.lit("None")))


def questions(code: Column, symbol: Column, name: Column, n: int = 5) -> Column:
    """The first n questions, without those that repeat an earlier one whatever its case."""
    every = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: question(code, symbol, name, i))
    return every if n <= 5 else F.slice(every, 1, 5)


def keywords(code: Column) -> Column:
    low = F.lower(code)
    return F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: low.contains(k))


def different(keys1: Column, keys2: Column, symbol1: Column, symbol2: Column, most: float = 0.3) -> Column:
    """Keyword sets of a Jaccard overlap under ``most``; where one is empty, other symbol types."""
    overlap = F.size(F.array_intersect(keys1, keys2)) / F.size(F.array_union(keys1, keys2))
    return F.when((F.size(keys1) == 0) | (F.size(keys2) == 0), ~symbol1.eqNullSafe(symbol2)).otherwise(overlap < most)


def description(code: Column, name: Column, docstring: Column) -> Column:
    """What code is for: the first sentence of its docstring to 100 characters, else by the first word that it contains."""
    low = F.lower(code)
    out = F.when(docstring != "", F.substring(strip(F.substring_index(docstring, ".", 1)), 1, 100))
    for words, says in DESCRIPTIONS:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = out.when(hit, F.replace(F.lit(says), F.lit("{name}"), F.coalesce(name, F.lit("None"))))
    return out


def judge_score(answer: Column) -> Column:
    """The first character as a grade from 0 to 3, else 0."""
    first = F.substring(strip(answer), 1, 1)
    return F.when(first.isin("0", "1", "2", "3"), first.cast("int")).otherwise(0)


def prompt(template: str, query: Column, code: Column, most: int = 1000) -> Column:
    """``template`` with {query} and {code}, the code clipped."""
    return F.replace(F.replace(F.lit(template), F.lit("{query}"), query), F.lit("{code}"), F.substring(code, 1, most))
