from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loresift.operators import blocks, rank


def test_half_up_rounds_as_spark(spark):
    x = [0.12345, -0.12345, 0.00005, 0.03125, 2.00015, -0.00001, 1.00005, 0.5, 123456.00005, 1e12 + 0.00005, 1e17, 0.99995, -0.0]
    x += list(np.random.default_rng(1).integers(-99999, 99999, 500) / 1e5)
    got = [r["y"] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double").select("i", (F.round("v", 4) + 0.0).alias("y")).orderBy("i").collect()]
    assert blocks.half_up(np.array(x), 4).tolist() == got


@pytest.mark.parametrize("block", [1 << 14, 7])
def test_nearest_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(rank, "QUERY_BLOCK", block)
    monkeypatch.setattr(rank, "TILE", 3)
    g = np.random.default_rng(0)
    vecs = [list(map(float, v)) for v in g.integers(-9, 10, (300, 3)) / 40] + [[0.125, 0.25, 0.5]] * 40  # copies, ties and halves
    vecs += [None, [1.0, None, 1.0], [1.0, 2.0], []]
    df = spark.createDataFrame(list(enumerate(vecs)), "doc long, vec array<double>").repartition(3)
    q = df.where("doc % 20 = 0 or doc >= 338").select(F.col("doc").alias("query"), F.col("vec").alias("qvec"))
    docs = df.select("doc", F.col("doc").alias("pos"), "vec")
    pairs = docs.crossJoin(q).select("query", "doc", "pos", F.round(rank.dot(F.col("qvec"), F.col("vec")), 4).alias("score"))
    w = rank.Window.partitionBy("query").orderBy(F.desc("score"), "pos")
    want = pairs.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("query", "doc", "score", "rank")
    rows = lambda d: sorted(map(tuple, d.collect()), key=lambda r: (r[0], r[3]))
    assert rows(rank.nearest(docs, q, 10)) == rows(want)


def test_nearest_makes_no_row_for_each_pair(spark):
    df = spark.range(50).select(F.col("id").alias("doc"), F.col("id").alias("pos"), F.array(F.col("id").cast("double")).alias("vec"))
    plan = rank.nearest(df, df.select(F.col("doc").alias("query"), F.col("vec").alias("qvec")), 5)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("threshold", [0.4, 0.8])
def test_near_duplicate_entries_against_brute_force(spark, threshold):
    from loresift.operators import store

    g = np.random.default_rng(2)
    texts = {}
    for i in range(120):
        base = set(g.integers(0, 3000, int(g.choice([3, 12, 70, 400]))).tolist()) if i % 3 == 0 else set(texts[i - 1])
        drop = set(g.permutation(sorted(base))[: int(g.integers(0, max(1, len(base) // 4)))].tolist())
        texts[i] = (base - drop) | set(g.integers(3000, 3300, int(g.integers(0, 3))).tolist())
    rows = [(i, " ".join(f"word{x}" for x in sorted(t))) for i, t in texts.items()] + [(120, ""), (121, None), (122, "of it")]
    df = spark.createDataFrame(rows, "pos long, text string").withColumns({"source": F.lit("manual"), "deleted_at": F.lit(None).cast("string")})
    sets, first = {i: frozenset(t) for i, t in texts.items() if t}, {}
    want = set()
    for i, t in sets.items():
        if t in first:
            want.add((first[t], i, 1.0))
        else:
            want |= {(a, i, round(len(s & t) / len(s | t), 6)) for s, a in first.items() if len(s & t) / len(s | t) >= threshold}
            first[t] = i
    got = [(r["a"], r["b"], round(r["jaccard"], 6)) for r in store.near_duplicates(df, threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30


def test_long_sketches_bound_the_difference(spark):
    from pyspark.sql.types import ArrayType, LongType, StructField, StructType

    from loresift.operators import store

    g = np.random.default_rng(4)
    base = g.integers(-(1 << 62), 1 << 62, 1100)
    rows = [(0, base[:1000].tolist()), (1, base[:1100].tolist()), (2, g.integers(-(1 << 62), 1 << 62, 1000).tolist()), (3, base[:1030].tolist())]
    df = spark.createDataFrame(rows, "doc long, hs array<long>")
    s = df.mapInArrow(store._long_sketches, StructType([StructField("doc", LongType()), StructField("bits", ArrayType(LongType()))])).cache()
    far = {(r["x"], r["y"]): r["d"] for r in s.toDF("x", "a").crossJoin(s.toDF("y", "b")).select("x", "y", store._apart(F.col("a"), F.col("b")).alias("d")).collect()}
    assert far[0, 0] == 0 and far[0, 1] == far[1, 0] and far[0, 1] <= 100 and far[0, 3] <= 30
    assert far[0, 2] > 2000 / 9  # unlike sets of a thousand words leave as pairs of names, not with all their words


@pytest.mark.parametrize("size", [1 << 12, 3])
def test_search_of_many_queries_as_search(spark, monkeypatch, size):
    from loresift.operators import bm25
    from loresift.operators.bm25 import SearchParams

    monkeypatch.setattr(bm25, "DOC_BLOCK", size)
    monkeypatch.setattr(bm25, "MANY", size + 1)
    g = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "running", "the", "été", "s3", "boxes", "delta"]
    say = lambda n: " ".join(g.choice(words, n))
    docs = [(i % 3, i, i, say(int(g.integers(0, 15))) if i % 10 else None) for i in range(60)] + [(7, 90, 90, "alpha")]
    asked = [(i % 3, i, say(3)) for i in range(20)] + [(0, 30, "zzz"), (1, 31, None), (2, 32, "beta beta"), (8, 33, "alpha")]
    d, q = spark.createDataFrame(docs, "corpus int, doc long, pos long, text string"), spark.createDataFrame(asked, "corpus int, query long, text string")
    rows = lambda df: sorted((r["corpus"], r["query"], r["rank"], r["doc"], r["pos"], r["score"]) for r in df.collect())
    got = rows(bm25.search_many(d, q, SearchParams(top_n=7)))
    assert got == rows(bm25.search(d, q, SearchParams(top_n=7))) and len(got) > 100


def test_many_queries_shuffle_no_scores_of_pairs(spark):
    from loresift.operators import bm25

    d = spark.range(40).selectExpr("0 corpus", "id doc", "id pos", "'alpha beta' text")
    q = d.selectExpr("corpus", "doc query", "text")
    by_pair = lambda f: re.search(r"Aggregate \[corpus#\d+, query#\d+L?, doc#\d+L?\]", f(d, q)._jdf.queryExecution().optimizedPlan().toString())
    assert by_pair(bm25.search) and not by_pair(bm25.search_many)
    assert bm25.search_many(d, q).count() == 400


def test_near_duplicates_query_shuffles_no_texts_and_counts_labels_as_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    texts = {5: "alpha beta gamma", 10: "beta gamma alpha", 15: "alpha beta gamma delta epsilon", 20: "delta alpha beta gamma epsilon", 25: "alpha beta gamma delta epsilon zeta"}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, 1, 0), (10, 0, 0), (20, 1, 1), (25, 1, 1), (25, 0, 1)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    df = entry.queries()["near_duplicates"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(entry.oracle_sql()["near_duplicates"]).fetchall())
    assert "quality" not in df._jdf.queryExecution().executedPlan().toString()
