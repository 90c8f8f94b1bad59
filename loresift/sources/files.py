"""Source trees: files through Spark's binary reader, ignore rules, git history and the entries built from them."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresift.functions.refs import size_label, stable_id
from loresift.sources import parsers as P
from loresift.sources.config import ParserOverrides

# Folders that are never indexed, files worth an entry of their own, and names of extensions.
SKIP = (".git", ".venv", "__pycache__", "node_modules", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".idea", ".vscode", "dist", "build", ".next")
KEY_FILES = {
    "pyproject.toml": "Python project config",
    "package.json": "Node.js package manifest",
    "go.mod": "Go module definition",
    "Cargo.toml": "Rust package manifest",
    "Makefile": "Build automation",
    "Dockerfile": "Container image definition",
    "docker-compose.yml": "Docker Compose services",
    "docker-compose.yaml": "Docker Compose services",
    ".env.example": "Environment variables template",
    "README.md": "Project readme",
    "terraform": "Infrastructure as Code (Terraform)",
    "Pulumi.yaml": "Infrastructure as Code (Pulumi)",
}
LABELS = {
    "py": "Python", "ts": "TypeScript", "tsx": "TypeScript React", "js": "JavaScript", "jsx": "JavaScript React", "go": "Go", "rs": "Rust", "java": "Java", "rb": "Ruby", "tf": "Terraform",
    "yaml": "YAML config", "yml": "YAML config", "json": "JSON", "toml": "TOML config", "sql": "SQL", "sh": "Shell script", "md": "Markdown", "css": "CSS", "html": "HTML", "dockerfile": "Dockerfile",
}
SPLIT_SECTIONS, SPLIT_CHARS, SECTION_CHARS = 4, 1500, 4000
_EDITOR = r"(^|/)(\.#[^/]*|[^/]*~|~\$[^/]*|[^/]*\.sw[pxon])$"


def ignore_regex(line: str) -> tuple[str, bool] | None:
    """(regular expression on relative paths, excludes?) of one ignore rule; None for blanks and comments."""
    rule = line.rstrip("\n").rstrip()
    if not rule or rule.startswith("#"):
        return None
    keep, rule = rule.startswith("!"), rule.lstrip("!")
    folder, rule = rule.endswith("/"), rule.rstrip("/")
    anchored, rule = "/" in rule, rule.lstrip("/")
    out, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif rule.startswith("**", i):
            out, i = out + ".*", i + 2
        elif rule[i] == "[" and "]" in rule[i + 1 :]:
            end = rule.index("]", i + 1)
            out, i = out + "[" + rule[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(rule[i], re.escape(rule[i]))
            i += 1
    return ("^" if anchored else "(^|/)") + out + ("/" if folder else "(/|$)"), not keep


def ignored(path, rules: Sequence[str] = ()):
    """Whether a relative path is left out: skipped and hidden folders, and the rules, of which the last one decides."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    out = F.exists(folders, lambda p: p.isin(*SKIP) | p.startswith(".") | p.endswith(".egg-info"))
    by_rule = F.lit(False)
    for rx in filter(None, map(ignore_regex, rules)):
        by_rule = F.when(path.rlike(rx[0]), rx[1]).otherwise(by_rule)
    return out | by_rule


def watchable(path, rules: Sequence[str] = ()):
    """Worth reacting to: not ignored, no dot file and no editor's scratch file."""
    return ~ignored(path, rules) & ~path.rlike(r"(^|/)\.[^/]*$") & ~path.rlike(_EDITOR)


def read_tree(spark: SparkSession, root: str, rules: Sequence[str] = (), scope: str = ".") -> DataFrame:
    """``(path, ext, size, directory, mtime, hash, content)`` of the files below ``root``; hashes are of the raw bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.regexp_replace("path", "^[a-z]+:/*", "/")
    rel = F.substring(at, F.lit(len(str(Path(root).resolve()).rstrip("/")) + 2), F.length(at))
    rows = raw.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content").where(~ignored(F.col("path"), rules))
    if scope.strip("/") not in ("", "."):
        s = scope.strip("/")
        rows = rows.where((F.col("path") == s) | F.startswith("path", F.lit(s + "/")))
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")
    ext = F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1))
    return rows.select("path", ext.alias("ext"), "size", folder.alias("directory"), "mtime", F.sha2("content", 256).alias("hash"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def file_state(path: str | Path) -> dict[str, object]:
    """Whether a file is there, its size and when it was changed."""
    try:
        s = Path(path).stat()
    except OSError:
        return {"exists": False, "size": 0, "mtime": None}
    return {"exists": True, "size": s.st_size, "mtime": s.st_mtime}


def ignore_rules(root: str) -> list[str]:
    p = Path(root) / ".gitignore"
    return p.read_text(encoding="utf-8", errors="replace").splitlines() if p.exists() else []


def git(root: str, *args: str, wait: float = 2.0) -> str | None:
    """Output of a git command; nothing on failure or delay."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=wait)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def head(root: str, short: bool = False) -> str | None:
    out = git(root, "rev-parse", *(["--short"] if short else []), "HEAD")
    return out.strip() or None if out else None


def changed_files(spark: SparkSession, root: str, since: str) -> DataFrame:
    """``(status, path)``: A, M or D for each file that differs; a rename deletes one path and adds another."""
    rows = []
    for line in (git(root, "diff", "--name-status", since, wait=30) or "").splitlines():
        status, *paths = line.split("\t")
        if status[:1] in "RC" and len(paths) == 2:
            rows += ([("D", paths[0])] if status[0] == "R" else []) + [("A", paths[1])]
        elif paths:
            rows.append((status[:1], paths[0]))
    return spark.createDataFrame(rows, "status string, path string")


def renames(root: str) -> list[tuple[str, str]]:
    """Every rename of the history, oldest first."""
    out = git(root, "log", "--reverse", "--diff-filter=R", "--name-status", "--format=", "-M", wait=60) or ""
    return [(p[1], p[2]) for p in (x.split("\t") for x in out.splitlines()) if len(p) == 3 and p[0].startswith("R")]


_ENTRY = "source_ref string, kind_tag string, text string, tags array<string>, source_hash string"


def _content_entries(path: str, content: str, raw_hash: str, directory: str, disabled: frozenset[str] = frozenset()) -> Iterator[tuple]:
    """A file's entry, or for a long structured document an overview and one entry for each section."""
    import hashlib

    found = P.analyze(path, content, disabled=disabled)
    if not found:
        return
    base = ["index", "content", P.extension(path), *sorted(found.tags)]
    lead = f"{found.header} " if found.header else ""
    docs = [b.doc for b in found.blocks if b.doc]
    parts = P.sections(content)[1] if P.extension(path) in ("md", "mdx") else []
    if len(parts) >= SPLIT_SECTIONS and len(content) >= SPLIT_CHARS:
        titles = "; ".join(s.title for s in parts[:25]) + (f" + {len(parts) - 25} more" if len(parts) > 25 else "")
        yield path, "section-master", f"{lead}File `{path}` — {found.summary}. Sections: {titles}.", [*base, "section-master"], raw_hash
        for s in parts:
            body = s.content if len(s.content) <= SECTION_CHARS else s.content[:SECTION_CHARS].rstrip() + "\n\n[...truncated...]"
            subs = f" Subsections: {'; '.join(s.subsections[:10])}." if s.subsections else ""
            words = [t for t in re.split(r"[\W_]+", s.title.lower()) if len(t) > 2][:6]
            yield f"{path}#{s.slug}", "section", f'Section "{s.title}" of `{path}`.{subs}\n\n{body}', [*base, "section", *words], hashlib.sha256(s.content.encode()).hexdigest()
        return
    items = ", ".join(b.full_name for b in found.blocks[:30])
    text = f"{lead}File `{path}` — {found.summary}. Items: {items}." + (f"\nDocs: {' | '.join(docs)}" if docs else "")
    yield path, "content", text, base, raw_hash


def content_entries(tree: DataFrame, disabled: frozenset[str] = frozenset()) -> DataFrame:
    """Entries of all files that a parser understands, but for those of ``disabled`` extensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
        for b in batches:
            rows = [r for p, c, h, d in zip(*(x.to_pylist() for x in b.columns), strict=True) if c for r in _content_entries(p, c, h, d, disabled)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in _ENTRY.split(", ")])

    return tree.select("path", "content", "hash", "directory").mapInArrow(run, _ENTRY)


def directory_entries(tree: DataFrame, labels: Mapping[str, str] = LABELS, key_files: Mapping[str, str] = KEY_FILES) -> DataFrame:
    """An entry for each folder: files by label, total size and key files; its hash covers all paths and sizes."""
    table = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
    name = F.substring_index("path", "/", -1)
    t = tree.select("directory", "path", "size", F.coalesce(F.try_element_at(table, F.col("ext")), F.when(F.col("ext") != "", F.concat(F.lit("."), "ext")).otherwise("other")).alias("label"), F.when(name.isin(*key_files), name).alias("key"))
    by_label = t.groupBy("directory", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("directory").agg(F.sort_array(F.collect_list(F.struct("label", "n"))).alias("ls"))
    lines = F.sort_array(F.collect_list(F.struct("path", F.concat("path", F.lit("|"), F.col("size").cast("string"), F.lit("\n")).alias("line"))))
    whole = t.groupBy("directory").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.sort_array(F.collect_set("key")).alias("keys"), lines.alias("lines")).join(by_label, "directory")
    kinds = F.array_join(F.transform("ls", lambda x: F.concat(x["n"].cast("string"), F.lit(" × "), x["label"])), ", ")
    keys = F.when(F.size("keys") > 0, F.concat(F.lit(" Key files: "), F.array_join("keys", ", "), F.lit("."))).otherwise("")
    text = F.concat(F.lit("Directory `"), "directory", F.lit("` — "), F.col("n").cast("string"), F.lit(" files ("), kinds, F.lit("), "), size_label(F.col("total")), F.lit("."), keys)
    return whole.select(F.col("directory").alias("source_ref"), F.lit("directory").alias("kind_tag"), text.alias("text"), F.array(F.lit("index"), F.lit("directory")).alias("tags"), F.sha2(F.array_join("lines.line", ""), 256).alias("source_hash"))


def key_file_entries(tree: DataFrame, key_files: Mapping[str, str] = KEY_FILES, disabled: frozenset[str] = frozenset()) -> DataFrame:
    """An entry for each key file that no parser reads."""
    table = F.create_map(*[x for k, v in key_files.items() for x in (F.lit(k), F.lit(v))])
    name = F.substring_index("path", "/", -1)
    rows = tree.where(name.isin(*key_files) & ~F.col("ext").isin(*[x for x in P.PARSERS if x not in disabled]))
    return rows.select(F.col("path").alias("source_ref"), F.lit("key-file").alias("kind_tag"), F.concat(F.lit("Key file `"), "path", F.lit("` — "), F.element_at(table, name)).alias("text"), F.array(F.lit("index"), F.lit("key-file")).alias("tags"), F.col("hash").alias("source_hash"))


#: The summary has a reference of its own, so that its id isn't the root folder's.
SUMMARY_REF = ".#summary"


def build_entries(tree: DataFrame, now: str, commit: str | None = None, summary: bool = True, overrides: ParserOverrides | None = None) -> DataFrame:
    """All index entries of a tree, with stable identifiers; ``store.carry_provenance`` keeps what didn't change.

    ``overrides`` disable parsers and add key files and names of extensions.
    """
    o = overrides or ParserOverrides()
    labels, key_files = {**LABELS, **o.labels}, {**KEY_FILES, **o.key_files}
    rows = directory_entries(tree, labels, key_files).unionByName(key_file_entries(tree, key_files, o.disabled)).unionByName(content_entries(tree, o.disabled))
    if summary:
        total = tree.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("directory").alias("d"))
        text = F.concat(F.lit("Repository with "), F.col("n").cast("string"), F.lit(" files in "), F.col("d").cast("string"), F.lit(" directories."))
        rows = rows.unionByName(total.select(F.lit(SUMMARY_REF).alias("source_ref"), F.lit("summary").alias("kind_tag"), text.alias("text"), F.array(F.lit("index"), F.lit("summary")).alias("tags"), F.lit(None).cast("string").alias("source_hash")))
    none = F.lit(None).cast("string")
    return rows.select(
        stable_id(F.lit("index"), F.col("source_ref")).alias("id"), F.lit(now).alias("ts"), "text", F.array_distinct("tags").alias("tags"), F.lit("index").alias("source"), "source_ref",
        F.lit(None).cast("array<int>").alias("source_lines"), "source_hash", F.lit(commit).cast("string").alias("source_commit"),
        none.alias("verified_at"), none.alias("drifted_at"), none.alias("deleted_at"), F.lit("fact").alias("kind"),
    )


def affected(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """The files of every folder in which one of ``paths(path)`` lies: what a partial reindex has to read."""
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")
    return tree.join(paths.select(folder.alias("directory")).distinct(), "directory", "left_semi")


def reindexed(store: DataFrame, tree: DataFrame, changes: DataFrame, now: str, commit: str | None = None, overrides: ParserOverrides | None = None) -> DataFrame:
    """The store after ``changes(status, path)``: entries of changed and deleted files go with all of their sections, folders are summed up anew."""
    from loresift.functions.refs import file_of
    from loresift.operators.store import carry_provenance

    near = affected(tree, changes)
    new = carry_provenance(build_entries(near, now, commit, summary=False, overrides=overrides), store)
    touched = changes.select(F.col("path").alias("_file")).union(near.select("directory")).union(changes.select(F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("."))).union(near.select("path")).distinct()
    is_index = F.col("source") == "index"
    gone = store.where(is_index & (F.col("source_ref") != SUMMARY_REF)).join(touched, file_of(F.col("source_ref")) == F.col("_file"), "left_semi").select("id").distinct()
    return store.join(gone, "id", "left_anti").unionByName(new, allowMissingColumns=True)
