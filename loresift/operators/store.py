"""The entry store as set operations: upserts, scoped replacement, provenance, verification, review and snapshots."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from loresift.functions import text as T
from loresift.functions.refs import file_of, size_label
from loresift.operators import blocks

STALE_DAYS, DUPLICATE = 30, 0.8


def live(entries: DataFrame) -> DataFrame:
    return entries.where("deleted_at is null")


def with_prefix(entries: DataFrame, prefix: str) -> DataFrame:
    """Entries whose id starts with ``prefix``, deleted ones too; an empty prefix gives none."""
    return entries.where(F.startswith("id", F.lit(prefix)) if prefix else F.lit(False))


def tail(entries: DataFrame, n: int, tag: str | None = None) -> DataFrame:
    """The last ``n`` entries in store order, with the tag if one is given."""
    if tag is not None:
        entries = entries.where(F.exists("tags", lambda t: F.lower(t) == tag.lower()))
    return entries.orderBy(F.desc("pos")).limit(n).orderBy("pos")


def in_scope(ref: Column, scope: str) -> Column:
    """The reference's path is the scope or lies below it; ``.`` and '' are everything."""
    path, scope = file_of(ref), scope.strip("/")
    return F.lit(True) if scope in ("", ".") else (path == scope) | F.startswith(path, F.lit(scope + "/"))


def upsert(kept: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``new`` in place of the rows of ``kept`` that have its keys; repeating it changes nothing."""
    return kept.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replace_scope(kept: DataFrame, new: DataFrame, scope: str = ".", source: str = "index") -> DataFrame:
    """``new`` in place of all rows of ``source`` within the scope."""
    return kept.where(~((F.col("source") == source) & in_scope(F.col("source_ref"), scope))).unionByName(new)


def carry_provenance(new: DataFrame, old: DataFrame) -> DataFrame:
    """New rows with ``ts``, ``verified_at`` and ``drifted_at`` of the old row of their id, where the content is the same."""
    names = ("ts", "verified_at", "drifted_at")
    o = old.select("id", F.col("source_hash").alias("_hash"), *[F.col(c).alias(f"_{c}") for c in names])
    same = F.col("source_hash").isNotNull() & (F.col("source_hash") == F.col("_hash"))
    return new.join(o, "id", "left").withColumns({c: F.when(same, F.col(f"_{c}")).otherwise(F.col(c)) for c in names}).drop("_hash", *[f"_{c}" for c in names])


def verify(entries: DataFrame, files: DataFrame) -> DataFrame:
    """``(id, status)`` of live entries against ``files(path, hash)``: verified, drifted, missing or skipped.

    Anchors are part of the key, so that a section is compared with the hash of its own text.
    """
    f = files.select(F.col("path").alias("source_ref"), F.col("hash").alias("_now"))
    skipped = F.col("source_hash").isNull() | F.col("source_ref").isNull() | F.exists("tags", lambda t: t == "directory")
    status = F.when(skipped, "skipped").when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.col("source_hash"), "verified").otherwise("drifted")
    return live(entries).join(f, "source_ref", "left").select("id", status.alias("status"))


def verify_following(entries: DataFrame, files: DataFrame, renames: Sequence[tuple[str, str]]) -> DataFrame:
    """``verify`` that looks for missing files where they went: ``(id, status, new_ref)``.

    An entry whose file moved with the same content is ``renamed`` and has its new reference; if the content
    changed too it is ``drifted``, with the new reference as a hint.  Sections move with their files.
    """
    spark, base = entries.sparkSession, verify(entries, files)
    gone = live(entries).join(base.where("status = 'missing'").select("id"), "id", "left_semi").select("id", "source_ref", "source_hash")
    paths = [r["p"] for r in gone.select(file_of(F.col("source_ref")).alias("p")).distinct().collect()] if renames else []  # as many as files went missing
    moved = spark.createDataFrame(sorted(resolve_renames(paths, renames).items()), "_was string, _at string")
    to = F.concat("_at", F.substring(F.col("source_ref"), F.length("_was") + 1, F.length("source_ref")))
    there = gone.join(moved, file_of(F.col("source_ref")) == F.col("_was")).withColumn("new_ref", to)
    there = there.join(files.select(F.col("path").alias("new_ref"), F.col("hash").alias("_now")), "new_ref")
    there = there.select("id", "new_ref", F.when(F.col("_now") == F.col("source_hash"), "renamed").otherwise("drifted").alias("_status"))
    return base.join(there, "id", "left").select("id", F.coalesce("_status", "status").alias("status"), "new_ref")


def review_flags(entries: DataFrame, known_refs: DataFrame, now: str, days: int = STALE_DAYS) -> DataFrame:
    """``(id, drifted, missing_source, stale)`` of live entries that have any of the flags; ``known_refs(source_ref)`` exist."""
    here = known_refs.select("source_ref", F.lit(True).alias("_here")).distinct()
    e = live(entries).join(here, "source_ref", "left")
    old = F.try_to_timestamp("ts") < F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(days))
    flags = {
        "drifted": F.col("drifted_at").isNotNull(),
        "missing_source": (F.col("source") == "index") & (F.coalesce("source_ref", F.lit("")) != "") & F.col("source_hash").isNotNull() & F.col("_here").isNull(),
        "stale": F.col("verified_at").isNull() & (F.col("source") == "manual") & F.coalesce(old, F.lit(False)),
    }
    return e.select("id", *[v.alias(k) for k, v in flags.items()]).where("drifted or missing_source or stale")


#: 64-bit words of a set's sketch.
SKETCH = 8


def _sketch(hashes: Column) -> list[Column]:
    """The parity of the hashes that fall on each of ``64 * SKETCH`` bits: two sketches differ in no more bits than their sets in members."""
    own = lambda i: F.filter(hashes, lambda h: F.pmod(h, F.lit(SKETCH)) == i)
    flip = lambda s, h: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 8), F.lit(64)).cast("int")))
    return [F.aggregate(own(i), F.lit(0).cast("long"), flip).alias(f"s{i}") for i in range(SKETCH)]


def _long_sketches(batches):
    """Batches ``(doc, hs)`` as ``(doc, bits)``: parities on four to eight bits for each hash, a power of two of them, so that a longer sketch folds."""
    for batch in batches:
        n, flat = blocks.lengths(batch.column("hs")), batch.column("hs").flatten().to_numpy(zero_copy_only=False)
        size = 64 << np.ceil(np.log2(np.maximum(1, n / 16))).astype(np.int64)
        start = np.cumsum(size) - size
        odd = np.bincount(np.repeat(start, n) + (flat & np.repeat(size - 1, n)), minlength=int(size.sum())) & 1
        longs = pa.array(np.packbits(odd.astype(bool), bitorder="little").view("<i8"))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size // 64)], pa.int32()), longs)], names=["doc", "bits"])


def _apart(a: Column, b: Column) -> Column:
    """In how many bits two sketches of ``_long_sketches`` differ, the longer one folded; their sizes differ by a factor of two at most."""
    size = F.least(F.size(a), F.size(b))
    xor = lambda x, y: x.bitwiseXOR(y)
    fold = lambda x: F.when(F.size(x) <= size, x).otherwise(F.zip_with(F.slice(x, F.lit(1), size), F.slice(x, size + 1, size), xor))
    return F.aggregate(F.zip_with(fold(a), fold(b), xor), F.lit(0), lambda s, x: s + F.bit_count(x))


def near_duplicates(entries: DataFrame, threshold: float = DUPLICATE) -> DataFrame:
    """``(a, b, jaccard)``, a < b: manual live entries whose word sets reach the threshold.

    Entries of equal sets meet once, through the least id of their class, which then stands in for them: ``a`` or ``b`` may be one, and
    copies are joined with their class's first.  Other pairs must share one of the rarest words that the
    threshold leaves room to miss, so common words pair nothing; there they leave at once if their sketches differ in more bits
    than similar sets in words, and so do sketches as long as the sets need.  Words are hashes until then (equal hashes only add
    candidates); only what is left meets its sets.
    """
    blocks.small_batches(entries.sparkSession)
    room_for = (1 - threshold) / (1 + threshold)  # members in which similar sets may differ, of all members
    e = live(entries).where("source = 'manual'").select("pos", F.sort_array(T.word_set(F.col("text"))).alias("ws")).where(F.size("ws") > 0)
    e = e.withColumn("key", F.sha2(F.array_join("ws", " "), 256))  # words have no spaces
    copies = e.select("key", "pos").join(e.groupBy("key").agg(F.min("pos").alias("a")), "key").where("pos <> a").select("a", F.col("pos").alias("b"), F.lit(1.0).alias("jaccard"))
    sets = e.groupBy("key").agg(F.min("pos").alias("doc"), F.first("ws").alias("ws")).select("doc", "ws")
    hashed = sets.select("doc", F.transform("ws", lambda w: F.xxhash64(w)).alias("hs"))
    words = hashed.select("doc", F.explode("hs").alias("w"))
    df = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    ranks = words.join(df, "w").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("r")).withColumn("n", F.size("r"))
    room = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    ranks = ranks.select("doc", "n", F.filter(F.slice("r", 1, room), lambda x: x["df"] > 1)["w"].alias("ks"), *_sketch(F.col("r.w"))).where(F.size("ks") > 0)
    keys = ranks.select(F.explode("ks").alias("w"), F.struct("doc", "n", *[f"s{i}" for i in range(SKETCH)]).alias("x"))
    left, right = keys.select("w", F.col("x").alias("l")), keys.select("w", F.col("x").alias("r"))
    apart = sum((F.bit_count(F.col(f"l.s{i}").bitwiseXOR(F.col(f"r.s{i}"))) for i in range(SKETCH)), F.lit(0))
    near = (F.col("l.n") >= threshold * F.col("r.n") - 1e-9) & (F.col("r.n") >= threshold * F.col("l.n") - 1e-9)
    near = near & (apart <= (F.col("l.n") + F.col("r.n")) * room_for + 1e-6)
    pairs = left.join(right, "w").where(F.col("l.doc") < F.col("r.doc")).where(near).select(F.col("l.doc").alias("a"), F.col("r.doc").alias("b"), (F.col("l.n") + F.col("r.n")).alias("n")).distinct()
    if threshold > 0.5:  # else sizes differ by more than a fold
        long = hashed.mapInArrow(_long_sketches, StructType([hashed.schema["doc"], StructField("bits", ArrayType(LongType()))]))
        pairs = pairs.join(long.select(F.col("doc").alias("a"), F.col("bits").alias("sa")), "a").join(long.select(F.col("doc").alias("b"), F.col("bits").alias("sb")), "b")
        pairs = pairs.where(_apart(F.col("sa"), F.col("sb")) <= F.col("n") * room_for + 1e-6)
    pairs = pairs.select("a", "b")
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("ws").alias("wa")), "a").join(sets.select(F.col("doc").alias("b"), F.col("ws").alias("wb")), "b")
    same = F.size(F.array_intersect("wa", "wb")).cast("double")
    j = both.select("a", "b", (same / (F.size("wa") + F.size("wb") - same)).alias("jaccard")).where(F.col("jaccard") >= threshold)
    return copies.union(j)


def stats(entries: DataFrame) -> DataFrame:
    """One row: counts of all, live, deleted, drifted and verified entries, and the last times by source."""
    alive = F.col("deleted_at").isNull()
    last = lambda s: F.max(F.when(alive & (F.col("source") == s), F.col("ts")))
    return entries.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(alive).alias("live"),
        F.count_if(~alive).alias("deleted"),
        F.count_if(alive & F.col("drifted_at").isNotNull()).alias("drifted"),
        F.count_if(alive & F.col("verified_at").isNotNull()).alias("verified"),
        last("index").alias("latest_index_ts"),
        last("manual").alias("latest_manual_ts"),
    )


def counts_by(entries: DataFrame, *columns: str) -> DataFrame:
    """``(axis, name, n)`` of live entries for each of the columns, in one pass."""
    e = live(entries).select(F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("string").alias("name")) for c in columns])).alias("x"))
    return e.groupBy("x.axis", "x.name").agg(F.count(F.lit(1)).alias("n"))


def hot_order() -> list[Column]:
    """Without drift first, then lately verified, then new."""
    return [F.col("drifted_at").isNotNull().cast("int"), F.desc(F.coalesce("verified_at", F.lit(""))), F.desc("ts"), F.col("pos")]


def hot_ranking(entries: DataFrame) -> DataFrame:
    """Live rules, patterns and facts that aren't from the index, ranked within their kind."""
    e = live(entries).where("kind <> 'fact' or source <> 'index'")
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(*hot_order())))


def hot_budget(ranked: DataFrame, room: int, header: int, most: int) -> DataFrame:
    """Of ``ranked(kind, rank, text)`` the lines ``- text`` that fit into ``room`` characters of their kind's section, up to the first that doesn't."""
    w = Window.partitionBy("kind").orderBy("rank")
    used = F.sum(F.length("text") + 3).over(w.rowsBetween(Window.unboundedPreceding, 0)) + header
    return ranked.where(F.col("rank") <= most).withColumn("used", used).where(F.col("used") <= room)


def directory_summary(files: DataFrame) -> DataFrame:
    """``files(directory, path, label, size)`` to ``(directory, n_files, labels, total, size_label, hash)``.

    Labels are ``count × label`` by label; the hash is over the path-sorted lines ``path|size``.
    """
    by_label = files.groupBy("directory", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("directory").agg(F.sort_array(F.collect_list(F.struct("label", "n"))).alias("ls"))
    labels = F.array_join(F.transform("ls", lambda x: F.concat(x["n"].cast("string"), F.lit(" × "), x["label"])), ", ")
    lines = F.sort_array(F.collect_list(F.struct("path", F.concat("path", F.lit("|"), F.col("size").cast("string"), F.lit("\n")).alias("line"))))
    whole = files.groupBy("directory").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total"), lines.alias("lines"))
    return whole.join(by_label, "directory").select("directory", "n_files", labels.alias("labels"), "total", size_label(F.col("total")).alias("size_label"), F.sha2(F.array_join("lines.line", ""), 256).alias("hash"))


def snapshot_diff(old: DataFrame, new: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """``(query, id, change)`` between two rankings ``(query, id, rank, score)``: dropped, added, reordered or score_changed."""
    side = lambda df, p: df.select("query", "id", F.col("rank").alias(f"{p}rank"), F.col("score").alias(f"{p}score"))
    both = side(old, "o").join(side(new, "n"), ["query", "id"], "full_outer")
    change = F.when(F.col("nrank").isNull(), "dropped").when(F.col("orank").isNull(), "added").when(F.col("orank") != F.col("nrank"), "reordered").when(F.abs(F.col("oscore") - F.col("nscore")) > tolerance, "score_changed")
    return both.select("query", "id", change.alias("change")).where("change is not null")


def mtime_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, op)`` between two states ``(path, mtime)``: created, deleted or modified."""
    both = old.select("path", F.col("mtime").alias("o")).join(new.select("path", F.col("mtime").alias("n")), "path", "full_outer")
    op = F.when(F.col("o").isNull(), "created").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "modified")
    return both.select("path", op.alias("op")).where("op is not null")


def last_op(events: DataFrame) -> DataFrame:
    """``(path, op, first_seq)``: the last operation on every path of ``events(seq, path, op)``."""
    return events.groupBy("path").agg(F.max_by("op", "seq").alias("op"), F.min("seq").alias("first_seq"))


def missing_vectors(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct content hashes of ``texts(text)`` that ``cache(content_hash, vec)`` lacks."""
    return texts.select(F.sha2("text", 256).alias("content_hash")).distinct().join(cache.select("content_hash"), "content_hash", "left_anti")


def compacted(cache: DataFrame, active: DataFrame) -> DataFrame:
    """Rows of the cache whose hash is still in use."""
    return cache.join(active.select("content_hash").distinct(), "content_hash", "left_semi")


def constraint_holds(entry: dict[str, Column], wanted: Column) -> Column:
    """All given keys of the map ``wanted`` hold; a text part is found in any case, a tag only in its own."""
    w = lambda k: F.try_element_at(wanted, F.lit(k))
    tests = {
        "text_substring": F.contains(F.lower(entry["text"]), F.lower(w("text_substring"))),
        "source_ref": entry["source_ref"] == w("source_ref"),
        "source_ref_prefix": F.startswith(entry["source_ref"], w("source_ref_prefix")),
        "tag": F.array_contains(entry["tags"], w("tag")),
        "kind": entry["kind"] == w("kind"),
        "id": entry["id"] == w("id"),
    }
    out = F.lit(True)
    for key, test in tests.items():
        out = out & F.when(w(key).isNull(), True).otherwise(F.coalesce(test, F.lit(False)))
    return out


def resolve_renames(paths: Sequence[str], renames: Sequence[tuple[str, str]]) -> dict[str, str]:
    """Where each path went, in one pass over the renames in the order they happened."""
    now = {p: p for p in paths}
    at: dict[str, list[str]] = {}
    for p in paths:
        at.setdefault(p, []).append(p)
    for src, dst in renames:
        moved = at.pop(src, [])
        for p in moved:
            now[p] = dst
        at.setdefault(dst, []).extend(moved)
    return {p: q for p, q in now.items() if q != p}
