"""Rendering of small results as Markdown or JSON; a driver's work over the rows that a ranking kept."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresift.functions.text import condensed
from loresift.operators.store import hot_budget, hot_ranking

KINDS = {"rule": "Constraints", "fact": "Facts", "pattern": "Patterns"}
HINT = ("Constraints are project rules: keep to them unless told otherwise.", "Facts and patterns are observations: check them before acting.")
HOT_CHARS, HOT_PATTERNS, HOT_FACTS = 4000, 4, 8


def ref(e: Mapping[str, Any]) -> str:
    lines = e.get("source_lines")
    return "" if not e.get("source_ref") else e["source_ref"] + (f":{lines[0]}-{lines[1]}" if lines and len(lines) == 2 else "")


def as_json(rows: Iterable[Mapping[str, Any]]) -> str:
    """Entries without unset fields, scores rounded to four digits."""
    out = []
    for r in rows:
        d = {k: v for k, v in r.items() if v is not None and not (k == "kind" and v == "fact")}
        out.append(d | ({"score": round(d["score"], 4)} if "score" in d else {}))
    return json.dumps(out, ensure_ascii=False, indent=2)


def recall(rows: Iterable[Mapping[str, Any]]) -> str:
    """Numbered entries with all that is known about them."""
    blocks = []
    for i, e in enumerate(rows, 1):
        facts = {"id": e["id"], "kind": e["kind"], "tags": ", ".join(e.get("tags") or []), "source": e["source"], "source_ref": ref(e), "commit": (e.get("source_commit") or "")[:12], "drifted": (e.get("drifted_at") or "")[:10]}
        lines = [f"   - {k}: {v}" for k, v in facts.items() if v] + [f"   - {e['ts'][:10]}"] + ([f"   - score: {e['score']:.4f}"] if e.get("score") is not None else [])
        blocks.append("\n".join([f"{i}. {e['text']}", *lines]))
    return "\n\n".join(blocks) or "No entries found."


def for_context(entries: DataFrame) -> DataFrame:
    """Section entries as one line each, before they are collected."""
    return entries.withColumn("text", F.when(F.contains("source_ref", F.lit("#")), condensed(F.col("text"))).otherwise(F.col("text")))


def context(task: str, rows: Iterable[Mapping[str, Any]]) -> str:
    """Entries by kind, each kind in order of rank; kinds without entries are left out."""
    rows = list(rows)
    out = [f"# Context for: {task}", ""]
    for kind, title in KINDS.items():
        some = [e for e in rows if e["kind"] == kind]
        out += [f"## {title}", ""] if some else []
        for e in some:
            bits = [e["source"], e["ts"][:10], f"ref: {ref(e)}" if ref(e) else "", f"commit: {e['source_commit'][:12]}" if e.get("source_commit") else "", "DRIFTED" if e.get("drifted_at") else ""]
            out += [f"- {e['text']}", f"  ({' · '.join(filter(None, bits))})"]
        out += [""] if some else []
    if not rows:
        out += ["## Constraints", "", "No relevant entries found.", ""]
    return "\n".join([*out, "## Hint", "", *HINT, ""])


def unseen(siblings: Iterable[Mapping[str, Any]], tags: Iterable[tuple[str, int]], session: tuple[int, int] | None = None) -> str:
    """What a session hasn't shown yet: other sections, tags nearby, and how far it went (queries, files)."""
    lines = [f"- `{s['source_ref']}`" for s in siblings]
    near = ", ".join(f"`{t}` ({n})" for t, n in tags)
    lines += [f"- nearby tags: {near}"] if near else []
    if not lines:
        return ""
    lines += [f"- session: {session[0]} queries · {session[1]} files touched"] if session else []
    return "\n".join(["## Haven't seen yet", "", *lines, ""])


def hot(entries: DataFrame, now: str, room: int = HOT_CHARS, commit: str | None = None, project: str | None = None) -> tuple[str, dict[str, int]]:
    """A snapshot under a budget: all rules, then patterns, then facts as far as they fit; its text and counts.

    ``entries`` are ranked on the executors; of patterns and facts only what can fit is collected.
    """
    marks = " ".join(filter(None, [f"generated={now}", f"commit={commit[:12]}" if commit else "", f"project={project}" if project else ""]))
    parts = [f"<!-- hot {marks} -->\n\n# Project memory snapshot\n"]
    ranked = hot_ranking(entries)
    rules = [r["text"] for r in ranked.where("kind = 'rule'").orderBy("rank").collect()]
    parts += ["\n## Constraints\n", *[f"- {t}\n" for t in rules]] if rules else []
    used = sum(map(len, parts))
    if used > room:
        parts.append(f"\n> Rules take {used} of {room} characters; some could be merged or dropped.\n")
    counts = {"rules": len(rules)}
    for kind, title, most in (("pattern", "\n## Patterns\n", HOT_PATTERNS), ("fact", "\n## Facts\n", HOT_FACTS)):
        left = room - sum(map(len, parts))
        fit = hot_budget(ranked.where(F.col("kind") == kind), left, len(title), most).orderBy("rank").collect() if left > 0 else []
        parts += [title, *[f"- {r['text']}\n" for r in fit]] if fit else []
        counts[kind + "s"] = len(fit)
    text = "".join(parts)
    return text, {"chars": len(text), **counts}


def report(strict: Iterable[Mapping[str, Any]], soft: Iterable[Mapping[str, Any]], mrr: tuple[float, float], followed: tuple[float, int] | None = None) -> str:
    """Hit rate and recall by cut-off, strict beside soft, and the mean reciprocal rank."""
    s, w = sorted(strict, key=lambda r: r["k"]), {r["k"]: r for r in soft}
    lines = [f"Pairs analyzed: {s[0]['n'] if s else 0}"]
    lines += [f"Follow rate (n={followed[1]}): {followed[0]:.1%}"] if followed and followed[1] else []
    lines += [f"Hit@{r['k']}: {r['hit_rate']:.1%} strict / {w[r['k']]['hit_rate']:.1%} soft" for r in s if r["k"] in w]
    lines += [f"Mean Recall@{r['k']}: {r['mean_recall']:.2f} strict / {w[r['k']]['mean_recall']:.2f} soft" for r in s if r["k"] in w]
    return "\n".join([*lines, f"Mean MRR: {mrr[0]:.2f} strict / {mrr[1]:.2f} soft"])


def stats_text(row: Mapping[str, Any], by: Iterable[Mapping[str, Any]]) -> str:
    lines = [f"{k}: {v}" for k, v in row.items() if v is not None]
    return "\n".join(lines + [f"{r['axis']} {r['name']}: {r['n']}" for r in sorted(by, key=lambda r: (r["axis"], r["name"]))])
