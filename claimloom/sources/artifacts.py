"""Artefact listings, reports and settings."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.sources.jsonl import exists


def list_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size_bytes) of all files below, but for .gitkeep; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size_bytes"))
    return files.where(~F.endswith("path", F.lit("/.gitkeep"))).orderBy("path")


def folder_megabytes(spark: SparkSession, folder: str) -> DataFrame:
    return list_artifacts(spark, folder).agg((F.coalesce(F.sum("size_bytes"), F.lit(0)) / 1048576).alias("megabytes"))


def check_artifacts(spark: SparkSession, paths: dict[str, str]) -> dict[str, bool]:
    return {name: exists(spark, p) for name, p in paths.items()}


def load_report(spark: SparkSession, path: str) -> Any:
    """A JSON report, null if it is missing or no JSON; other files as text."""
    if not exists(spark, path):
        return None
    text = spark.read.text(path, wholetext=True).first()[0]
    if not path.endswith(".json"):
        return text
    try:
        return json.loads(text)
    except ValueError:
        return None


def report_of(name: str, allowed: dict[str, str], spark: SparkSession) -> Any:
    """A report by an allowed name; others raise KeyError."""
    return load_report(spark, allowed[name])


def report_json(df: DataFrame, keys: list[str]) -> str:
    """A small metric table as nested JSON, sorted and indented."""
    out: dict = {}
    for row in df.collect():
        at = out
        for k in keys:
            at = at.setdefault(str(row[k]), {})
        at |= {c: row[c] for c in df.columns if c not in keys}
    return json.dumps(out, indent=2, sort_keys=True, ensure_ascii=False)


def report_markdown(df: DataFrame) -> str:
    """A small table as Markdown; doubles to four places."""
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [df.columns, ["---"] * len(df.columns), *[[show(v) for v in row] for row in df.collect()]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


@dataclass(frozen=True)
class Settings:
    """Settings of a run. Environment variables CLAIMLOOM_<NAME> beat a file's values, which beat the defaults."""

    top_k: int = 5
    retrieval_mode: str = "bm25"
    rrf_k: int = 60
    bm25_k: int = 10
    dense_k: int = 10
    title_k: int = 0
    query_expansion: bool = False
    rerank: str = "none"
    gate_threshold: float | None = None
    support_threshold: float = 0.5
    refute_threshold: float = 0.5
    corpus_path: str | None = None
    reports: dict = field(default_factory=dict)


def coerce(value: Any, kind: str) -> Any:
    """Text to a setting's type: 1, true, yes, on are true; null, none and empty are None where allowed."""
    if isinstance(value, str):
        low = value.strip().lower()
        if "None" in kind and low in ("", "null", "none"):
            return None
        if "bool" in kind:
            return low in ("1", "true", "yes", "on")
        if "int" in kind:
            return int(low)
        if "float" in kind:
            return float(low)
    return value


def load_settings(values: dict[str, Any] | None = None, environment: dict[str, str] | None = None) -> Settings:
    env = os.environ if environment is None else environment
    found = {}
    for f in fields(Settings):
        if (name := f"CLAIMLOOM_{f.name.upper()}") in env:
            found[f.name] = coerce(env[name], str(f.type))
        elif values and f.name in values:
            found[f.name] = coerce(values[f.name], str(f.type))
    return replace(Settings(), **found)


def load_yaml(path: str) -> dict[str, Any]:
    """A flat or nested YAML mapping of plain scalars; {} for a missing file. Uses PyYAML where it is installed."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        out: dict[str, Any] = {}
        stack: list[tuple[int, dict]] = [(-1, out)]
        for line in text.splitlines():
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            depth = len(line) - len(line.lstrip())
            key, _, value = line.strip().partition(":")
            while stack[-1][0] >= depth:
                stack.pop()
            if value.strip():
                stack[-1][1][key] = value.strip().strip("'\"")
            else:
                stack[-1][1][key] = {}
                stack.append((depth, stack[-1][1][key]))
        return out
    return yaml.safe_load(text) or {}
