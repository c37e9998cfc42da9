"""Dependency manifests and git."""

from __future__ import annotations

import os
import re
import subprocess

import pandas as pd
import tomllib
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import requirements
from ..functions.text import strip

# Files that mark a use of containers.
DOCKER = ("Dockerfile", "docker-compose.yml", "docker-compose.yaml")


@F.pandas_udf(T.ArrayType(T.StringType()))
def project_dependencies(text: pd.Series) -> pd.Series:
    """Names under project.dependencies of a TOML text, cut at == and >=; none where it does not parse."""

    def one(t: str | None) -> list[str]:
        try:
            return [re.split("==|>=", d)[0].strip() for d in tomllib.loads(t or "").get("project", {}).get("dependencies", [])]
        except (ValueError, AttributeError, TypeError):
            return []

    return text.map(one)


def python_packages(name: Column, text: Column) -> Column:
    """Packages of requirements.txt and pyproject.toml; other manifests give none."""
    none = F.array().cast("array<string>")
    return F.when(name == "requirements.txt", requirements(text, "|~=", options=False)).when(name == "pyproject.toml", project_dependencies(text)).otherwise(none)


def node_packages(text: Column) -> Column:
    """Keys of dependencies, then of devDependencies, repeats kept; none where the text is no JSON."""
    none = F.array().cast("array<string>")
    keys = [F.coalesce(F.json_object_keys(F.get_json_object(text, f"$.{k}")), none) for k in ("dependencies", "devDependencies")]
    return F.concat(*keys)


def dependencies(files: DataFrame) -> DataFrame:
    """One row (python_packages, nodejs_packages, docker) of the top-level ``files(relative_path, text)``."""
    name = F.col("relative_path")
    order = F.array_position(F.array(F.lit("requirements.txt"), F.lit("pyproject.toml")), name)
    some = files.where(name.isin("requirements.txt", "pyproject.toml", "package.json", *DOCKER))
    per = some.select(order.alias("o"), F.when(order > 0, python_packages(name, F.col("text"))).alias("p"), F.when(name == "package.json", node_packages(F.col("text"))).alias("n"), name.isin(*DOCKER).alias("d"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("o", "p"))))
    return per.agg(F.flatten(F.transform(pairs, lambda x: x["p"])).alias("python_packages"), F.coalesce(F.first("n", ignorenulls=True), F.array().cast("array<string>")).alias("nodejs_packages"), F.coalesce(F.max("d"), F.lit(False)).alias("docker"))


def commit_parts(line: Column) -> Column:
    """hash|author|email|date|subject as a struct; a subject is cut at its first bar, what is missing is empty."""
    parts = F.split(line, r"\|")
    return F.struct(*(F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(("hash", "author", "email", "date", "message"))))


def git(root: str, *args: str) -> str | None:
    """Output of a git command, or null whatever goes wrong."""
    try:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True, timeout=60).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        return None


def git_metadata(spark: SparkSession, root: str) -> DataFrame:
    """One row: remote, branch, latest commit, and the first ten branches and tags with their numbers."""
    raw = [(git(root, "config", "--get", "remote.origin.url"), git(root, "branch", "--show-current"), git(root, "log", "-1", "--pretty=format:%H|%an|%ae|%ad|%s"), git(root, "branch", "-a"), git(root, "tag", "-l"))]
    d = spark.createDataFrame(raw, "remote_url string, branch string, commit string, branches string, tags string")

    def items(c: str) -> Column:
        lines = F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "\n"), lambda x: F.replace(strip(x), F.lit("* "), F.lit("")))
        return F.filter(lines, lambda x: x != "")

    empty = F.lit("")
    return d.select(F.coalesce("remote_url", empty).alias("remote_url"), F.coalesce("branch", empty).alias("branch"), commit_parts(F.coalesce("commit", empty)).alias("latest_commit"), F.size(items("branches")).alias("branch_count"), F.slice(items("branches"), 1, 10).alias("branches"), F.size(items("tags")).alias("tag_count"), F.slice(items("tags"), 1, 10).alias("tags"))


def clone(url: str, to: str) -> str | None:
    """A shallow clone at ``to``, or the directory that is there already; null if git fails."""
    if os.path.isdir(to):
        return to
    done = subprocess.run(["git", "clone", "--depth", "1", url, to], capture_output=True, check=False)
    return to if done.returncode == 0 else None
