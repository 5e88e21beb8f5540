"""Files, ignore rules, version history and configuration as tables."""

from __future__ import annotations

import json
import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is never scanned.
EXCLUDED = ("**/node_modules/**", "**/.git/**", "**/.cache/**", "**/vendor/**", "**/dist/**", "**/build/**", "**/.env*", "**/*.log", "**/coverage/**", "**/.next/**", "**/target/**", "**/__pycache__/**", "**/*.pyc", "**/.DS_Store")
#: Extensions of source files, and folders that are skipped when sources are looked for.
EXTENSIONS = tuple("ts tsx js jsx mjs cjs py go rs java kt kts swift c cpp cc cxx h hpp rb php scala sc lua vue svelte".split())
SKIPPED = tuple("""node_modules vendor third_party venv .venv env .env site-packages __pycache__ .pytest_cache .mypy_cache eggs .eggs dist build target out bin .next .nuxt .output .git .svn .hg .idea .vscode .vs
coverage .nyc_output .coverage htmlcov __tests__ test tests testing __mocks__ __fixtures__ fixtures benchmark benchmarks perf performance example examples demo demos temp temp-build tmp .cache .temp .husky .github .gitlab""".split())


def glob_regex(glob: str) -> str:
    """A glob with *, ** and ? as a regular expression for a whole path."""
    marks = {"**/": "(?:.*/)?", "/**": "(?:/.*)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(marks.get(p, re.escape(p)) for p in re.split(r"(\*\*/|/\*\*|\*\*|\*|\?)", glob)) + "$"


@dataclass(frozen=True)
class IgnoreRule:
    pattern: str
    negated: bool = False
    folder: bool = False
    anchored: bool = False

    @property
    def regex(self) -> str:
        body = glob_regex(self.pattern)[1:-1]
        start = "^" if self.anchored or "/" in self.pattern else "^(?:.*/)?"
        return start + body + ("/.*$" if self.folder else "(?:/.*)?$")


def parse_ignore(text: str) -> list[IgnoreRule]:
    """The rules of an ignore file: blank lines and comments don't count, ! takes a rule back, a slash at the end means folders and one at the start the root."""
    rules = []
    for line in map(str.strip, text.splitlines()):
        if line and not line.startswith("#"):
            bare = line.removeprefix("!")
            rules.append(IgnoreRule(bare.strip("/"), line.startswith("!"), bare.endswith("/"), bare.startswith("/")))
    return rules


def ignored(path: Column, rules: list[IgnoreRule]) -> Column:
    """Whether the last rule that matches a path ignores it."""
    state = F.lit(False)
    for r in rules:
        state = F.when(path.rlike(r.regex), not r.negated).otherwise(state)
    return state


def ignore_globs(rules: list[IgnoreRule]) -> list[str]:
    """Rules as globs; those that take others back have none."""
    return [("" if r.anchored else "**/") + r.pattern + ("/**" if r.folder else "") for r in rules if not r.negated]


def excluded(path: Column, globs: tuple[str, ...] = EXCLUDED) -> Column:
    state = F.lit(False)
    for g in globs:
        state = state | path.rlike(glob_regex(g))
    return state


def scan(spark: SparkSession, root: str, glob: str = "*.md", rules: list[IgnoreRule] | None = None) -> DataFrame:
    """(path, content, modified_at) of the files below root whose name fits, without excluded, ignored, hidden and blank ones. Paths are relative to root."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(root.rstrip("/")) + "/", "")
    rows = raw.select(rel.alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified_at"))
    hidden = F.col("path").rlike(r"(^|/)\.")
    return rows.where(~hidden & ~excluded(F.col("path")) & ~ignored(F.col("path"), rules or []) & (F.trim("content") != ""))


def scan_sources(spark: SparkSession, root: str, rules: list[IgnoreRule] | None = None) -> DataFrame:
    """scan over all source files that stand in no skipped folder below the root."""
    inside = F.split(F.regexp_replace("path", "^/+", ""), "/")
    skipped = F.exists(F.slice(inside, 1, F.size(inside) - 1), lambda x: x.isin(*SKIPPED))
    return scan(spark, root, "*.{" + ",".join(EXTENSIONS) + "}", rules).where(~skipped)


def parse_log(text: str) -> Iterator[tuple[str, str, str, str]]:
    """(commit, author, at, file) from lines of `git log --name-only --pretty=format:%x00%H|%an|%aI`."""
    commit = author = at = ""
    for line in text.splitlines():
        if line.startswith("\x00"):
            commit, author, at = line[1:].split("|", 2)
        elif line.strip():
            yield commit, author, at, line.strip()


def git_log(spark: SparkSession, repo: str, most: int = 500, since: str = "6 months ago") -> DataFrame:
    """(commit, author, at, file) of a repository's last commits; empty where it is none."""
    done = subprocess.run(["git", "-C", repo, "log", f"--max-count={most}", f"--since={since}", "--name-only", "--pretty=format:%x00%H|%an|%aI"], capture_output=True, text=True)
    rows = list(parse_log(done.stdout)) if done.returncode == 0 else []  # `most` commits
    return spark.createDataFrame(rows, "commit string, author string, at string, file string").withColumn("at", F.to_timestamp("at"))


def read_config(path: str) -> dict:
    """Collections and their contexts, from JSON or, where a reader is installed, YAML; an absent file is an empty configuration."""
    if not Path(path).exists():
        return {"collections": {}}
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yml", ".yaml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("no reader for YAML is installed; keep the configuration as JSON") from e
        return yaml.safe_load(text) or {"collections": {}}
    return json.loads(text)


def write_config(path: str, config: dict) -> None:
    Path(path).write_text(json.dumps(config, indent=2, ensure_ascii=False), encoding="utf-8")


def collection_name_ok(name: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", name))


def add_collection(config: dict, name: str, root: str, pattern: str = "**/*.md") -> dict:
    if not collection_name_ok(name) or name in config.get("collections", {}):
        raise ValueError(f"collection {name!r} has no valid name or is there already")
    return config | {"collections": config.get("collections", {}) | {name: {"path": root, "pattern": pattern, "context": {}}}}


def rename_collection(config: dict, old: str, new: str) -> dict:
    if old not in config["collections"] or new in config["collections"] or not collection_name_ok(new):
        raise ValueError(f"can't rename {old!r} to {new!r}")
    return config | {"collections": {new if k == old else k: v for k, v in config["collections"].items()}}


def remove_collection(config: dict, name: str) -> dict:
    return config | {"collections": {k: v for k, v in config["collections"].items() if k != name}}


def set_context(config: dict, collection: str | None, prefix: str, text: str | None) -> dict:
    """Set, or with None remove, a context; without a collection the one that holds for all."""
    if collection is None:
        return config | {"global_context": text}
    c = config["collections"][collection]
    kept = {k: v for k, v in c.get("context", {}).items() if k != prefix} | ({prefix: text} if text is not None else {})
    return config | {"collections": config["collections"] | {collection: c | {"context": kept}}}


def context_rows(config: dict) -> list[tuple[str, str, str]]:
    """(collection, prefix, context), longest prefixes first within a collection."""
    rows = [(n, p, t) for n, c in config.get("collections", {}).items() for p, t in c.get("context", {}).items()]
    return sorted(rows, key=lambda r: (r[0], -len(r[1]), r[1]))
