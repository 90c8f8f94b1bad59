"""Evaluation pairs from agents' logs: what was asked for, and which files were touched soon after.

``events(run_id, seq, event, tool_name, tool_input, cwd[, result])`` as the log sources give them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values (patterns below included): tools that name a file and in which argument, and folders that aren't anyone's own work.
FILE_ARGUMENTS = {"Read": "file_path", "Edit": "file_path", "Write": "file_path", "Grep": "path"}
VENDORED = (".venv", "node_modules", "__pycache__", ".tox", "site-packages", "dist", "build")
WORKTREES = "\\.claude/worktrees/[^/]+/"
COMMAND, WINDOW, SHORTEST = "loresift context", 20, 10


def asked(command: Column, name: str = COMMAND) -> Column:
    """The quoted query of a shell command that calls ``name``; null if it doesn't."""
    lead = name.replace(" ", "\\s+") + "\\s+"
    double = F.regexp_extract(command, lead + '"((?:[^"\\\\]|\\\\.)*)"', 1)
    single = F.regexp_extract(command, lead + "'((?:[^'\\\\]|\\\\.)*)'", 1)
    return F.nullif(F.trim(F.coalesce(F.nullif(double, F.lit("")), single)), F.lit(""))


def asked_tag(command: Column) -> Column:
    return F.nullif(F.regexp_extract(command, "--tag\\s+(\\S+)", 1), F.lit(""))


def normalised(path: Column) -> Column:
    """A path without ``.``, doubled slashes and any number of ``..``, which go no higher than its start."""

    def step(kept: Column, part: Column) -> Column:
        return F.when(part.isin("", "."), kept).when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(""), F.array_join(parts, "/"))


def working_folder(command: Column, base: Column) -> Column:
    """Where a command runs that may begin with ``cd``: an absolute folder, or one below ``base``."""
    to = F.regexp_extract(command, "^\\s*cd\\s+(\\S+)", 1)
    return F.when(to == "", base).when(to.startswith("/"), normalised(to)).otherwise(normalised(F.concat(base, F.lit("/"), to)))


def without_worktree(path: Column) -> Column:
    return F.regexp_replace(path, WORKTREES, "")


def relative(path: Column, root: Column) -> Column:
    """The path below ``root``, without worktree parts; null if it lies elsewhere or is vendored."""
    below = F.when(F.startswith(path, F.concat(root, F.lit("/"))), without_worktree(F.substring(path, F.length(root) + 2, F.length(path))))
    return F.when(~F.startswith(below, F.lit("..")) & (below != "") & ~F.arrays_overlap(F.split(below, "/"), F.array(*map(F.lit, VENDORED))), below)


def output_refs(text: Column) -> Column:
    """Paths a result printed: after ``ref:``, and in backticks if they look like one; anchors dropped."""
    plain = lambda p: without_worktree(F.substring_index(p, "#", 1))
    marked = F.transform(F.regexp_extract_all(text, F.lit("ref:\\s*([^\\s·)]+)"), 1), plain)
    quoted = F.filter(F.transform(F.regexp_extract_all(text, F.lit("`([^`]+)`"), 1), F.trim), lambda t: ~F.contains(t, F.lit(" ")) & (F.contains(t, F.lit("/")) | t.rlike("\\.\\w{1,4}$")))
    return F.filter(F.array_union(marked, F.transform(quoted, plain)), lambda p: p != "")


def extract(events: DataFrame, name: str = COMMAND, window: int = WINDOW, cwd: str | None = None, has_output: bool = True, tag: str | None = None) -> DataFrame:
    """Pairs ``(run_id, query, cwd, turn, gold_files, window_size, tag, followed, followed_soft, n_output_refs)``.

    A query counts once in a run, where it first stands in the wanted folder; only then short ones and
    those without any file in the next ``window`` tool calls are left out.
    """
    start = events.where("event = 'run_started'").groupBy("run_id").agg(F.min_by("cwd", "seq").alias("run_cwd"))
    calls = events.where("event = 'tool_called'").join(start, "run_id", "left")
    arg = None
    for tool, key in FILE_ARGUMENTS.items():
        value = F.try_element_at("tool_input", F.lit(key))
        arg = F.when(F.col("tool_name") == tool, value) if arg is None else arg.when(F.col("tool_name") == tool, value)
    command = F.when(F.col("tool_name") == "Bash", F.try_element_at("tool_input", F.lit("command")))
    calls = calls.withColumns({"file": arg, "command": command}).withColumn("query", asked(F.col("command"), name))
    ahead = Window.partitionBy("run_id").orderBy("seq").rowsBetween(1, window)
    calls = calls.withColumn("ahead", F.collect_set("file").over(ahead)).where("query is not null")
    base = F.coalesce(F.nullif("cwd", F.lit("")), "run_cwd", F.lit("/"))
    calls = calls.withColumn("folder", working_folder(F.col("command"), base))
    calls = calls.where(F.col("folder") == cwd) if cwd else calls
    first = F.row_number().over(Window.partitionBy("run_id", "query").orderBy("seq"))
    pairs = calls.withColumn("k", first).where("k = 1").where(F.length("query") >= SHORTEST)
    gold = F.array_sort(F.array_distinct(F.array_compact(F.transform("ahead", lambda p: relative(p, F.col("folder"))))))
    pairs = pairs.withColumn("gold_files", gold).where(F.size("gold_files") > 0)
    pairs = pairs.where(asked_tag(F.col("command")) == tag) if tag else pairs
    text = F.coalesce("result", F.lit("")) if has_output and "result" in events.columns else F.lit(None).cast("string")
    refs = output_refs(text)
    hit = F.arrays_overlap("gold_files", refs)
    soft = hit | F.exists("gold_files", lambda g: F.contains(text, F.substring_index(g, "/", -1)))
    return pairs.select("run_id", "query", F.col("folder").alias("cwd"), F.col("seq").cast("long").alias("turn"), "gold_files", F.lit(window).alias("window_size"), asked_tag(F.col("command")).alias("tag"), hit.alias("followed"), soft.alias("followed_soft"), F.coalesce(F.size(refs), F.lit(0)).alias("n_output_refs"))


def follow_rate(pairs: DataFrame, soft: bool = False) -> DataFrame:
    """``(rate, n)`` over pairs whose output is known; the rate is null if there are none."""
    c = "followed_soft" if soft else "followed"
    return pairs.agg(F.avg(F.col(c).cast("double")).alias("rate"), F.count(c).alias("n"))
