"""What a repository is built with: frameworks, agent patterns, structure, entry points and configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import file_name, folder_repo_name, repo_name
from ..functions.text import agent_patterns
from .stats import repo_size

# Keywords by framework, directories of agent code, and file patterns in order.
AGENTIC = {
    "langchain": ("langchain", "langsmith", "lc", "chain", "agent"),
    "autogen": ("autogen", "agent", "groupchat"),
    "crewai": ("crewai", "crew", "task", "agent"),
    "haystack": ("haystack", "pipeline", "node"),
    "llamaindex": ("llama_index", "query_engine", "index"),
    "semantic_kernel": ("semantic_kernel", "sk"),
    "transformers_agents": ("transformers_agents", "huggingface"),
    "camel": ("camel", "role_playing"),
    "agents": ("agent", "tool", "workflow", "orchestrator"),
}
AGENT_DIRECTORIES = ("agent", "workflow", "tool", "pipeline", "orchestrator")
ENTRY_POINTS = ("main.py", "app.py", "run.py", "cli.py", "server.py", "agent.py", "pipeline.py", "__main__.py")
CONFIG = (r"config.*\.py", r"settings.*\.py", r"\.env.*", r".*\.toml", r".*\.yaml", r".*\.yml", r".*\.json", r".*\.cfg", r".*\.ini")
CONFIG_EXCLUDED = (".git", "__pycache__", "node_modules")
SCANNED, SCANNED_FOR_PATTERNS = 50, 20


def first_python(files: DataFrame, n: int) -> DataFrame:
    """The first n Python files of ``files(relative_path, text)`` by path."""
    return files.where(F.col("relative_path").endswith(".py") & F.col("text").isNotNull()).orderBy("relative_path").limit(n)


def framework_hits(texts: DataFrame, packages: DataFrame, text: str = "text", package: str = "package") -> DataFrame:
    """(framework, how): by a package whose name holds a keyword, else by an import or class line of a text."""
    low = F.lower(text)
    uses, depends = [], []
    for name, words in AGENTIC.items():
        use = hit = F.lit(False)
        for w in words:
            use = use | low.contains(f"import {w}") | low.contains(f"from {w}") | low.rlike(f"class.*{w}")
            hit = hit | F.lower(package).contains(w)
        uses.append(F.max(use).alias(name))
        depends.append(F.max(hit).alias(name))

    def long(df: DataFrame, aggs: list, as_: str) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(n).alias("framework"), F.coalesce(F.col(n), F.lit(False)).alias(as_)) for n in AGENTIC))
        return df.agg(*aggs).select(F.inline(pairs))

    both = long(packages, depends, "d").join(long(texts, uses, "u"), "framework")
    return both.where("d or u").select("framework", F.when(F.col("d"), "dependency").otherwise("usage").alias("how"))


def agentic_detection(files: DataFrame, packages: DataFrame) -> DataFrame:
    """``framework_hits`` over the first 50 Python files, and custom agents by pattern in the first 20."""
    found = framework_hits(first_python(files, SCANNED), packages)
    own = first_python(files, SCANNED_FOR_PATTERNS).agg(F.coalesce(F.max(agent_patterns("text")), F.lit(False)).alias("hit")).where("hit")
    return found.union(own.select(F.lit("custom_agents"), F.lit("implementation")))


def structure(files: DataFrame) -> DataFrame:
    """One row: top-level directories but ``.git``, and whether one is named for agents, of ``files(relative_path)``."""
    top = F.when(F.col("relative_path").contains("/"), F.substring_index("relative_path", "/", 1))
    named = F.array_sort(F.array_remove(F.collect_set(top), ".git"))
    agentic = F.exists("directories", lambda d: F.lower(d).rlike("|".join(AGENT_DIRECTORIES)))
    return files.agg(named.alias("directories")).withColumn("has_agentic_structure", agentic)


def entry_points(files: DataFrame) -> DataFrame:
    """One row: the first five entry points, by pattern and then path."""
    order = F.array_position(F.array(*map(F.lit, ENTRY_POINTS)), file_name(F.col("relative_path")))
    found = files.select(order.alias("o"), "relative_path").where("o > 0").orderBy("o", "relative_path").limit(5)
    return found.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "relative_path"))), lambda x: x["relative_path"]).alias("entry_points"))


def config_files(files: DataFrame) -> DataFrame:
    """One row: the first ten configuration files by path; a file counts once for each pattern that it meets."""
    name = file_name(F.col("relative_path"))
    hits = F.filter(F.array(*(F.when(name.rlike(f"^{p}$"), F.lit(1)) for p in CONFIG)), lambda x: x.isNotNull())
    some = files.where(~F.col("relative_path").rlike("|".join(x.replace(".", r"\.") for x in CONFIG_EXCLUDED)))
    found = some.select("relative_path", F.explode(hits)).orderBy("relative_path").limit(10)
    return found.agg(F.array_sort(F.collect_list("relative_path")).alias("config_files"))


def basic(files: DataFrame, root: str, remote: str | None) -> DataFrame:
    """One row: name by the remote's URL or else the folder's, path, MB and number of files."""
    folder = root.rstrip("/").rsplit("/", 1)[-1]
    name = repo_name(F.lit(remote)) if remote and "/" in remote else folder_repo_name(F.lit(folder))
    return repo_size(files).select(name.alias("repo_name"), F.lit(root).alias("local_path"), "size_mb", "file_count", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("extracted_at"))
