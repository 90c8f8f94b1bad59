"""Session-aware asking: what a session has shown sinks, its neighbours rise, and its state goes on from question to question."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame

from loresift.functions.text import condensed
from loresift.operators import rank, render

#: Time after which a session without questions is over.
IDLE = timedelta(minutes=30)


def new_state(now: str) -> dict[str, Any]:
    return {"started_at": now, "queries": [], "seen_refs": [], "seen_tags": []}


def is_over(state: Mapping[str, Any] | None, now: str, idle: timedelta = IDLE) -> bool:
    """There is no usable state, or its last question is longer ago than ``idle``."""
    if not state or not isinstance(state.get("queries"), list):
        return True
    last = state["queries"][-1].get("ts") if state["queries"] else state.get("started_at")
    try:
        return datetime.fromisoformat(now) - datetime.fromisoformat(last) > idle
    except (TypeError, ValueError):
        return True


def pool_size(top_n: int) -> int:
    return max(top_n + rank.SUGGEST_FROM, 10)


def ask(pool: DataFrame, query: str, state: dict[str, Any], now: str, top_n: int = 3) -> dict[str, Any]:
    """The answer to one question and the state after it; the state given isn't changed.

    ``pool(query, doc, score, rank, source_ref, tags, text, kind, source, source_commit, ...)`` is one ranking of ``pool_size(top_n)`` rows.
    """
    spark = pool.sparkSession
    seen = spark.createDataFrame([(0, r) for r in state["seen_refs"]], "query int, source_ref string")
    tags = spark.createDataFrame([(0, t) for t in state["seen_tags"]], "query int, tag string")
    again = rank.session(pool, seen).withColumn("text", condensed_if_section())
    top = [r.asDict() for r in again.where(f"rank <= {int(top_n)}").orderBy("rank").collect()]
    near = [r.asDict() for r in rank.siblings(again, len(top), seen).orderBy("place").collect()]
    words = [(r["tag"], r["n"]) for r in rank.tag_suggestions(again, len(top), tags).orderBy("place").collect()]
    refs = [e["source_ref"] for e in top if e["source_ref"]]
    shown = [t.lower() for e in top for t in e["tags"] or []]
    after = {
        "started_at": state["started_at"],
        "queries": [*state["queries"], {"q": query, "ts": now, "returned_refs": refs}],
        "seen_refs": list(dict.fromkeys([*state["seen_refs"], *refs])),
        "seen_tags": list(dict.fromkeys([*state["seen_tags"], *(t for t in shown if t not in rank.NOISE_TAGS)])),
    }
    return {"query": query, "top": top, "siblings": near, "tags": words, "state": after, "is_new": not state["queries"]}


def condensed_if_section():
    from pyspark.sql import functions as F

    return F.when(F.contains("source_ref", F.lit("#")), condensed(F.col("text"))).otherwise(F.col("text"))


def files_seen(state: Mapping[str, Any]) -> int:
    return len({r.split("#", 1)[0] for r in state["seen_refs"]})


def page(answer: Mapping[str, Any]) -> str:
    """The answer as Markdown: numbered entries, what wasn't shown yet, and how the session went so far."""
    state = answer["state"]
    out = [f"<!-- ask: {'new session' if answer['is_new'] else str(len(state['queries'])) + ' queries'} -->", f"# Q: {answer['query']}", ""]
    for i, e in enumerate(answer["top"], 1):
        facts = [e["kind"], e["source"], f"ref: {render.ref(e)}" if render.ref(e) else "", f"commit: {e['source_commit'][:12]}" if e.get("source_commit") else "", f"score: {e['score']:.1f}"]
        out += [f"{i}. {e['text']}", f"   ({' · '.join(filter(None, facts))})", ""]
    if not answer["top"]:
        out += ["No entries found.", ""]
    out.append(render.unseen(answer["siblings"], answer["tags"]))
    earlier = [q["q"] for q in state["queries"][-3:-1]]
    if earlier and not answer["is_new"]:
        out += ["## So far in this session", "", "Asked: " + " · ".join(f'"{q}"' for q in earlier), f"Files touched: {files_seen(state)}", ""]
    return "\n".join(out)


def history(state: Mapping[str, Any] | None) -> str:
    """All questions of a session with the references each gave."""
    if not state or not state.get("queries"):
        return "No session.\n"
    out = [f"# Session since {state['started_at']}", ""]
    for i, q in enumerate(state["queries"], 1):
        out += [f'{i}. "{q["q"]}" ({q["ts"]})', *[f"   - {r}" for r in q["returned_refs"]]]
    return "\n".join([*out, "", f"Files touched: {files_seen(state)} · tags: {len(state['seen_tags'])}", ""])
