"""YAML configuration, parser overrides, regression fixtures, ranking snapshots and session state; never raises on bad files."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresift.operators.bm25 import SearchParams


def read_yaml(path: str | Path) -> Any:
    import yaml

    try:
        return yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError, yaml.YAMLError):
        return None


def search_params(path: str | Path, **explicit: Any) -> SearchParams:
    """Explicit arguments, then what the configuration says, then defaults."""
    data = read_yaml(path)
    data = data if isinstance(data, dict) else {}
    part = lambda k: data[k] if isinstance(data.get(k), dict) else {}
    wanted = {"mmr_enabled": part("mmr").get("enabled"), "mmr_lambda": part("mmr").get("lambda"), "hybrid_alpha": part("hybrid").get("alpha"), "rerank_top_k": part("rerank").get("top_k")}
    kinds = {"mmr_enabled": bool, "mmr_lambda": float, "hybrid_alpha": float, "rerank_top_k": int}
    found = {}
    for k, v in wanted.items():
        try:
            found |= {} if v is None else {k: kinds[k](v)}
        except (TypeError, ValueError):
            continue
    return SearchParams().changed(**(found | {k: v for k, v in explicit.items() if v is not None}))


@dataclass
class ParserOverrides:
    disabled: frozenset[str] = frozenset()
    key_files: dict[str, str] = field(default_factory=dict)
    labels: dict[str, str] = field(default_factory=dict)
    error: str | None = None


def parser_overrides(path: str | Path) -> ParserOverrides:
    if not Path(path).exists():
        return ParserOverrides()
    data = read_yaml(path)
    if data is None and Path(path).read_text(encoding="utf-8", errors="replace").strip():
        return ParserOverrides(error=f"{path} can't be parsed")
    if not isinstance(data, dict):
        return ParserOverrides(error=None if data is None else f"{path}: a mapping is needed")
    strings = lambda v: {k: x for k, x in v.items() if isinstance(k, str) and isinstance(x, str)} if isinstance(v, dict) else {}
    off = data.get("disabled_parsers")
    return ParserOverrides(frozenset(x.lower().lstrip(".") for x in off if isinstance(x, str)) if isinstance(off, list) else frozenset(), strings(data.get("key_files")), {k.lower().lstrip("."): v for k, v in strings(data.get("extension_labels")).items()})


def fixture(spark: SparkSession, path: str | Path) -> DataFrame:
    """``(qid, question, top_n, must_match)`` of a regression file; entries without a question are left out."""
    data = read_yaml(path)
    rows = []
    for i, q in enumerate(data if isinstance(data, list) else []):
        if isinstance(q, dict) and isinstance(q.get("question"), str):
            wanted = [{str(k): str(v) for k, v in m.items()} for m in q.get("must_match") or [] if isinstance(m, dict)]
            rows.append((i, q["question"], int(q.get("top_n", 8)), wanted))
    return spark.createDataFrame(rows, "qid long, question string, top_n int, must_match array<map<string,string>>")


def snapshot_name(name: str | None) -> str:
    """Letters, digits, dots, hyphens and underscores only."""
    return re.sub(r"[^A-Za-z0-9._-]+", "-", name or "").strip("-.") or "snapshot"


def write_snapshot(ranking: DataFrame, folder: str, name: str | None) -> str:
    """A ranking ``(question, rank, id, source_ref, kind, score)`` with scores rounded to four digits."""
    path = f"{folder}/{snapshot_name(name)}"
    ranking.withColumn("score", F.round("score", 4)).coalesce(1).write.mode("overwrite").parquet(path)
    return path


def latest_snapshot(folder: str) -> str | None:
    found = [p for p in Path(folder).iterdir() if p.is_dir()] if Path(folder).is_dir() else []
    return str(max(found, key=lambda p: p.stat().st_mtime)) if found else None


def save_state(path: str | Path, state: dict[str, Any]) -> None:
    """A small JSON state, replaced at once."""
    part = Path(f"{path}.tmp")
    part.write_text(json.dumps(state, ensure_ascii=False), encoding="utf-8")
    os.replace(part, path)


def load_state(path: str | Path) -> dict[str, Any] | None:
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None
    return data if isinstance(data, dict) else None


def watchlist(path: str | Path) -> list[str]:
    """Folders to watch: one a line, comments and repeats left out, ``~`` expanded."""
    try:
        lines = Path(path).read_text(encoding="utf-8").splitlines()
    except OSError:
        return []
    return list(dict.fromkeys(os.path.abspath(os.path.expanduser(x)) for x in (line.split("#", 1)[0].strip() for line in lines) if x))
