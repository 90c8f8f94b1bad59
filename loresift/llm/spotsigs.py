"""SpotSigs document fingerprints (operator 9); DataFrame functions only.

Every common word (an anchor), and the start of the text, begins a chain of the next two content words; a chain's
hash is a signature, and a document's fingerprint is its sorted set of signatures.  Sets are compared by
Jaccard; ``near_pairs`` finds all alike ones, partitioned and pruned by their lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loresift.llm.common import cut

# Common words of English, German, French and Spanish.
ANCHORS = (
    "the a an and of to in is was for on that with it by as at be are this from or "
    "der die das und ist ein eine von zu mit auf den im nicht "
    "le les un une et est des du dans que qui pour sur "
    "el los las y es en del se por para con"
).split()
START = "<s>"
#: Ranges of ids in ``with_next`` at least; there are twice as many as the square root of the rows, so neither a range nor the list of them grows large.
LEAST_RANGES = 64


def words(text: Column) -> Column:
    return F.concat(F.array(F.lit(START)), F.split(F.lower(text), "[\\s\\p{Punct}]+"))


def with_signatures(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with the sorted distinct signatures of the column ``text``, as 64-bit hashes.

    The content words are taken with their places; the anchors between one and the next all begin chains with the two
    content words that follow, however many anchors stand there.  If a text has anchors but no content word, all its words are the one signature.
    """
    anchors = [START, *ANCHORS]
    content = F.filter(F.transform("_w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: ~y["x"].isin(*anchors) & (y["x"] != ""))

    def chains(c: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get("_c", k - 1)["i"]).otherwise(-1)
        run = F.filter(F.slice("_w", before + 2, c["i"] - before - 1), lambda y: y != "")
        return F.transform(F.array_distinct(run), lambda a: F.xxhash64(a, c["x"], F.get("_c", k + 1)["x"]))

    bare = F.when((F.size("_c") == 0) & F.exists("_w", lambda y: y.isin(*ANCHORS)), F.xxhash64("_w"))
    out = docs.withColumn("_w", words(F.col(text))).withColumn("_c", content)
    found = F.concat(F.flatten(F.transform("_c", chains)), F.array_compact(F.array(bare)))
    return out.withColumn(name, F.sort_array(F.array_distinct(found))).drop("_w", "_c")


def fingerprint(sigs: Column) -> Column:
    return F.concat_ws(" ", sigs.cast("array<string>"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets; two empty sets are alike."""
    same = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same / (F.size(a) + F.size(b) - same))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, sigs)`` of every row; a null text counts as empty and has no signature."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return with_signatures(docs, "text", "sigs")


def _range_of(bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most the id: a step for groups of them, then one within its group."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    firsts = F.array(*[F.lit(g[0]) for g in groups])
    inner = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])
    at = F.size(F.filter(firsts, lambda b: b <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull() | (at == 0), 0).otherwise((at - 1) * step + F.size(F.filter(F.element_at(inner, F.greatest(at, F.lit(1))), lambda b: b <= F.col("doc_id"))))


def with_next(docs: DataFrame) -> DataFrame:
    """``fingerprints`` with ``next_text`` and ``next_sigs`` of the document that follows by descending id.

    After the last comes the first.  Ids are cut into ranges at their quantiles, so each task orders small ranges; a
    range's last document is followed by the top of the next range that has any.  Null ids come last; of equal ids any
    may follow the other, by a hash of their texts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.count()
    ranges = max(LEAST_RANGES, int(2 * rows**0.5))
    at = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("q")).first()["q"] or []
    part = _range_of(sorted({int(x) for x in at})).alias("part")
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    # the top of each range: the largest id, of equal ones the least hash
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), (-F.xxhash64("text").cast("decimal(20,0)")).alias("h"))
    tops = cut(docs.select(part, place.alias("m")).groupBy("part").agg(F.max("m").alias("m")))
    whole = Window.orderBy(F.desc("part"))  # numbers of the ranges, without texts
    follows = tops.select(F.col("part").alias("before"), F.coalesce(F.lead("part").over(whole), F.max("part").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("part"))
    first = docs.select("doc_id", "text", part, place.alias("m")).join(tops, ["part", "m"], "left_semi").dropDuplicates(["part"])
    first = with_signatures(first, "text", "sigs").join(follows, "part").select(F.col("before").alias("part"), F.struct("text", "sigs").alias("top"))
    first = cut(first)
    made = fingerprints(docs).withColumn("part", _range_of(sorted({int(x) for x in at})))
    by_id = Window.partitionBy("part").orderBy(*order)
    made = made.withColumn("next_text", F.lead("text").over(by_id)).withColumn("next_sigs", F.lead("sigs").over(by_id))
    made = made.join(first, "part", "left")
    return made.select("doc_id", "text", "sigs", F.coalesce("next_text", F.col("top.text")).alias("next_text"), F.coalesce("next_sigs", F.col("top.sigs")).alias("next_sigs"))


def edited(docs: DataFrame) -> DataFrame:
    """The fingerprint of every document and of its edited text, and how alike they are.

    The edited text has the document's last half (code points, rounded down) replaced by as many first ones of the
    next document, or all it has.  See ``with_next`` for the order, null and repeated ids.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = with_signatures(rows, "edited", "edited_sigs")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(a, b, jaccard)``, a < b: classes of equal fingerprints (by their least id) whose sets reach ``threshold``.

    Copies are not expanded.  Sets are partitioned by length, so that only neighbouring partitions can
    hold alike ones; within them two sets must share one of the rarest signatures that the threshold leaves
    room to miss, and their lengths' ratio must allow it.  Documents without signatures and null ids are left out.
    """
    sets = fingerprints(docs).where("doc_id is not null and size(sigs) > 0").groupBy("sigs").agg(F.min("doc_id").alias("doc_id"))
    sets = cut(sets.withColumn("n", F.size("sigs")))
    each = sets.select("doc_id", "n", F.explode("sigs").alias("s"))
    df = each.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    rank = each.join(df, "s").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("r"))
    room = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int")
    prefix = rank.withColumn("part", part).select("doc_id", "n", "part", F.explode(F.slice("r", 1, room.cast("int"))).alias("x")).where("x.df > 1").select("doc_id", "n", "part", "x.s")
    near = prefix.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), "s")
    pairs = near.join(prefix.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), "part", "s"), ["part", "s"])
    pairs = pairs.where((F.col("a") != F.col("b")) & (F.col("na") <= F.col("nb")) & (F.col("na") >= threshold * F.col("nb") - 1e-9)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("sigs").alias(f"s{x}"))
    found = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("jaccard", likeness(F.col("sa"), F.col("sb")))
    return found.where(F.col("jaccard") >= threshold - 1e-12).select("a", "b", "jaccard")
