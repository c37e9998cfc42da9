"""Python's text semantics as column expressions, and the tests for code, prose and binary content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.strip() takes off, and where str.splitlines() cuts.
BLANK = r"[\s\x1c-\x1f\x85]"
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """As ``str.strip()``: Unicode white space off both ends."""
    return F.regexp_replace(_col(c), rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


#: Unicode's spaces (Zs), without line ends and tabs; and the blanks of ASCII but the vertical tab.
SPACES = "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
ASCII_BLANKS = " \t\n\f\r"


def trim_spaces(c: Column | str) -> Column:
    """As SQL's ``trim``: spaces alone off both ends."""
    return F.trim(_col(c), F.lit(SPACES))


def rtrim_blanks(c: Column | str) -> Column:
    """As RE2 takes ``[\\s]+$`` off: blanks of ASCII off the right end."""
    return F.rtrim(_col(c), F.lit(ASCII_BLANKS))


def split_newlines(c: Column | str) -> Column:
    """As ``str.split('\\n')``: a final newline leaves an empty last line."""
    return F.split(_col(c), "\n", -1)


def splitlines(c: Column | str) -> Column:
    """As ``str.splitlines()``: all line boundaries; no empty line after the last of them."""
    parts = F.split(_col(c), LINE_ENDS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def clip(c: Column | str, n: int) -> Column:
    return F.substring(_col(c), 1, n)


def without_nul(c: Column | str) -> Column:
    """NUL characters removed; null stays null."""
    return F.regexp_replace(_col(c), "\\x00", "")


def any_of(patterns: tuple[str, ...], flags: str = "U") -> str:
    """One pattern that is found where any of ``patterns`` is."""
    return f"(?{flags})" + "|".join(f"(?:{p})" for p in patterns)


# Patterns that tell formatted text, code and prose apart.
FORMATTED = (
    r"^=+\s*[A-Za-z\s]+\s*=+$",
    r"^-+\s*[A-Za-z\s]+\s*-+$",
    r"^[=_-]{20,}$",
    r"\b(the|and|that|this|with|for|are|is|was|were|have|has|had)\b",
    r"[.!?]\s+[A-Z]",
    r"^\s*(Human|AI|Tool|System|User|Assistant)\s+(Message|Response|Input|Output)?\s*[:=-]",
    r"^\s*[A-Z][a-z]+\s*:",
)
FENCED_CODE = (
    r"^\s*(def|class|import|from|async|await|return|if|for|while|try|except|with)\b",
    r"^\s*@\w+",
    r"^\s*\w+\s*=\s*.+",
    r"^\s*\w+\(.+\)",
    r"^\s*print\(.+\)",
    r"^\s*\{.*\}",
    r"^\s*\[.*\]",
)
BARE_CODE = (
    r"^\s*(def\s+\w+\s*\(|class\s+\w+|import\s+\w+|from\s+\w+\s+import)",
    r"^\s*\w+\s*=\s*.+|^\s*\w+\s*\(.+\)",
    r"^\s*(if|for|while|with|try|except|finally|async|await)\s+",
    r"^\s*@\w+",
    r"^\s*return\b",
    r"^\s*print\(",
)
PROSE = (
    r"\b(the|and|that|this|with|for|are|is|was|were|have|has|had)\b",
    r"[.!?]\s+[A-Z]",
    r"\b(a|an|the)\s+\w+",
)
CODE_STARTS = (
    r"^\s*from langchain\.",
    r"^\s*import langchain",
    r"^\s*@tool\b",
    r"^\s*agent = create_agent\(",
    r"^\s*result = agent\.invoke\(",
)
EXECUTABLE = (
    r"\bdef\s+\w+\s*\([^)]*\)\s*:",
    r"\bclass\s+\w+\s*\(?[^:]*\)?\s*:",
    r"^\s*from\s+\w+\s+import\s+\w+",
    r"^\s*import\s+\w+",
    r"\breturn\b",
    r"\bprint\(",
    r"^\s*\w+\s*=\s*[^=\n]+$",
)
PROSE_MARKS = ("the", "and", "that", "this", "with", "for", "are", "is", "was")
AGENT_PATTERNS = ("class.*Agent", "def.*agent", "class.*Tool", "def.*tool", "class.*Workflow", "def.*workflow", "class.*Orchestrator", "def.*orchestrator", "@tool", "@agent", "@workflow")


def _lines(text: Column) -> Column:
    """Stripped lines that are not empty."""
    return F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x != "")


def _count(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda x: x.rlike(pattern)))


def formatted_lines(text: Column | str) -> Column:
    return _count(_lines(strip(text)), any_of(FORMATTED, "iuU"))


def fenced_code_lines(text: Column | str) -> Column:
    return _count(_lines(strip(text)), any_of(FENCED_CODE))


def is_actual_code(text: Column | str) -> Column:
    """False only where several lines look formatted and none looks like code."""
    return ~((formatted_lines(text) > 1) & (fenced_code_lines(text) == 0))


def looks_like_code_block(text: Column | str) -> Column:
    """Whether unfenced text is very clearly code, by its lines; texts under 50 characters are not."""
    text = strip(text)
    lines = _lines(text)
    code = _count(lines, any_of(BARE_CODE))
    prose = F.size(F.filter(lines, lambda x: (F.length(x) > 20) & x.rlike(any_of(PROSE, "iuU"))))
    strong = (code >= 2) & (prose <= F.floor(code / 2))
    short = (F.size(lines) <= 3) & (code >= 1) & (prose == 0)
    return (F.length(text) >= 50) & (strong | short | text.rlike(any_of(CODE_STARTS)))


def mentions_prose(text: Column | str) -> Column:
    """A common word anywhere, even within another word."""
    low = F.lower(_col(text))
    out = F.lit(False)
    for w in PROSE_MARKS:
        out = out | low.contains(w)
    return out


def looks_executable(text: Column | str) -> Column:
    text = _col(text)
    lines = _lines(text)
    kept = F.filter(lines, lambda x: ~x.startswith("#") & ~x.startswith('"""'))
    hits = _count(kept, any_of(EXECUTABLE))
    return is_actual_code(text) & ((hits >= 2) | ((hits >= 1) & (F.size(lines) <= 3)))


def printable_ratio(text: Column | str) -> Column:
    """Share of characters in printable ASCII, newline, return and tab; null for an empty text."""
    text = _col(text)
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, r"[^\x20-\x7E\n\r\t]", "")) / F.length(text))


def binary_text(text: Column | str, threshold: float = 0.3) -> Column:
    """Characters: under ``threshold`` printable. An empty text is not binary."""
    return F.coalesce(printable_ratio(text) < threshold, F.lit(False))


def binary_bytes(content: Column | str, sample: int = 1024, threshold: float = 0.8) -> Column:
    """Bytes: a NUL among the first ``sample``, or under ``threshold`` of them printable. Empty is not binary, null is."""
    head = F.decode(F.substring(_col(content), 1, sample), "ISO-8859-1")
    return F.when(_col(content).isNull(), True).otherwise(F.when(F.length(head) == 0, False).otherwise(head.contains("\u0000") | (printable_ratio(head) < threshold)))


def agent_patterns(text: Column | str) -> Column:
    """Whether any agent-like definition or decorator is in the text, whatever its case."""
    return _col(text).rlike(any_of(AGENT_PATTERNS, "i"))
