"""Operators on small tables against brute force, with nulls, empty and repeated rows, and clashing column names."""

from __future__ import annotations

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loresift.llm import chat, decontaminate, graph, line_dedup, lm, mixing, near_dedup, queries, spotsigs, token_output, toxicity, warc

SF = "/root/testdata/sf0.001"
ODD = [(None, None), (7, None), (8, ""), (9, " \n\t "), (10, "one"), (10, "one"), (None, "null id text here"), (11, "İ ü é 日本"), (12, "x " * 3000)]


def words(t):
    return (t or "").encode().lower().split()


def table(spark, rows):
    """Rows with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'en' as lang", "'src0' as source", "1 as n", "2 as rank", "'x' as regs", "3 as h1", "4 as component", "5 as pos", "6 as score", "7 as word")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 60)))) for i in range(60)]
    for i in range(60, 110):  # edits of earlier ones, near the threshold
        ws = docs[rng.randrange(len(docs))][1].split()
        for _ in range(rng.randint(0, 3)):
            ws[rng.randrange(len(ws))] = rng.choice(vocab)
        docs.append((i, " ".join(ws)))
    return docs


def brute_groups(docs, size):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_against_brute_force(spark, corpus, size):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(table(spark, corpus), shingle=size).collect()}
    assert got == brute_groups(corpus, size)


def test_near_duplicates_of_odd_rows(spark):
    rows = near_dedup.near_duplicates(table(spark, ODD), shingle=2).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r["component_id"], r["kept"]) == ((None, False) if r["doc_id"] is None else (r["doc_id"], True))
    assert near_dedup.near_duplicates(table(spark, []), shingle=2).count() == 0
    assert near_dedup.representatives(table(spark, ODD)).count() == len(ODD)


def test_near_copies_across_blocks(spark, monkeypatch):
    """A neighbourhood of several components, cut into blocks of two."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    base = [f"b{i}" for i in range(40)]
    docs = [(k, " ".join(f"x{k}{j}" if j // 3 == k % 13 or j % 11 == k % 7 else w for j, w in enumerate(base))) for k in range(24)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(table(spark, docs), shingle=2).collect()}
    assert got == brute_groups(docs, 2)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_that_have_not_settled_are_an_error(spark):
    with pytest.raises(RuntimeError):
        graph.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), most_rounds=1)


def test_decontamination_finds_substituted_passages(spark):
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.sample(vocab, rng.choice([8, 20, 40])))) for i in range(30)]
    docs, want = [], set()
    for d in range(60):
        body = [rng.choice(vocab) for _ in range(80)]
        if d % 2 == 0:
            i, t = items[d // 2]
            w = t.split()
            for k in range(3, len(w) - 3, 6):  # every sixth token differs
                w[k] = "changed"
            body[30:30] = [x.upper() + rng.choice([",", "", "!"]) for x in w]
            want.add((d, i))
        docs.append((d, " ".join(body)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.overlaps(table(spark, docs), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(100 * r["n_matched"] >= 80 * r["n_aligned"] for r in got)
    clean = decontaminate.clean(table(spark, docs), bench)
    assert {r["doc_id"] for r in clean.collect()} == {d for d in range(60) if d % 2} and "rank" in clean.columns


def test_decontamination_against_brute_force(spark):
    """Every pair and diagonal, on texts of few words; and a very long item that is copied whole."""
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("abcdefghij") for _ in range(n))
    items = [(i, text(rng.choice([4, 6, 13, 30]))) for i in range(12)] + [(12, long := " ".join(f"w{rng.randrange(3000)}" for _ in range(20_000)))]
    docs = []
    for d in range(40):
        part = items[rng.randrange(12)][1].split()
        docs.append((d, " ".join([text(20), *(w if rng.random() > 0.12 else "z" for w in part), text(rng.randint(0, 20))])))
    docs += [(40, "before " + long + " after"), (41, "a " * 20_000)]
    want = {}
    for d, t in docs:
        a = t.split()
        for i, u in items:
            b, best = u.split(), None
            if d >= 40 and i < 12 or len(b) * len(a) > 1e8:
                continue
            for k in range(1 - len(b), len(a)) if d < 40 and i < 12 else ():
                s, e = max(0, -k), min(len(b), len(a) - k)
                same = [b[x] == a[x + k] for x in range(s, e)]
                lo, hi = decontaminate.longest_overlap(np.array(same, bool), 80, 100)
                if hi - lo >= max(5, min(13, len(b))) and (best is None or sum(same[lo:hi]) > best):
                    best = sum(same[lo:hi])
            if best:
                want[d, i] = best
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.overlaps(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {k: r["n_matched"] for k, r in got.items() if k[0] < 40 and k[1] < 12} == want
    assert got[40, 12]["n_matched"] == 20_000 and got[40, 12]["doc_start"] == 1


def test_decontamination_blocks_and_odd_rows(spark, monkeypatch):
    items = [(i, " ".join(f"i{i}w{k}" for k in range(20))) for i in range(9)] + [(None, "x"), (50, None), (51, "")]
    docs = [(i, t) for i, t in items[:9]] + ODD
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = decontaminate.overlaps(table(spark, docs), bench).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 30)
    parts = decontaminate.overlaps(table(spark, docs), bench).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts)) and {(r["doc_id"], r["item_id"]) for r in whole} == {(i, i) for i in range(9)}
    assert decontaminate.overlaps(table(spark, []), bench).count() == 0 and decontaminate.overlaps(table(spark, docs), bench.limit(0)).count() == 0


def test_lm_counts_and_scores(spark):
    docs = [(i, " ".join(random.Random(i).choice(["the", "of", "and", f"r{i % 7}", "The"]) for _ in range(30))) for i in range(40)] + ODD
    out = lm.score(table(spark, docs), lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
    rows = out.collect()
    assert len(rows) == len(docs)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count: dict[bytes, int] = {}
    for i, t in docs:
        for w in [] if held(i) else [*words(t), b""]:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), len(words(t)) + 1, sum(count.get(w, 0) > 0 for w in [*words(t), b""]), round(sum(np.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), b""]), 5)) for i, t in docs)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in rows) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in rows)
    assert lm.score(table(spark, []), lambda: F.lit(False)).count() == 0
    assert lm.score(table(spark, ODD), lambda: F.lit(True)).where("train_tokens = 0").count() == len(ODD)


def test_lm_rarer_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 3)
    docs = table(spark, [(1, "a a a b b c d"), (2, "a b e"), (3, "zz a")])
    held = lambda: F.col("doc_id") == 3
    few = {r["doc_id"]: r for r in lm.score(docs, held).collect()}
    assert [few[i]["n_known"] for i in (1, 2, 3)] == [8, 4, 2]
    n, v = 12, 6
    assert few[3]["base_score"] == pytest.approx(sum(np.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in (0, 4, 2)), abs=1e-9)


def test_lm_beats_the_base_on_held_out_documents(spark):
    rows = queries.op2_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").groupBy().sum("base_score", "score").first()
    assert rows["sum(score)"] > rows["sum(base_score)"] * 0.95


def test_lm_takes_a_gradient_of_every_token(spark, monkeypatch):
    """Very long texts too, which are trained on whole, and every replica."""
    monkeypatch.setattr(lm, "REPLICA_TOKENS", 5_000)
    docs = table(spark, [(i, " ".join(f"w{i * j % 50}" for j in range(3_000 if i % 50 == 0 else 100))) for i in range(200)]).withColumn("learn", F.lit(True))
    v = lm.vocabulary(lm.word_counts(docs))
    made, was = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **k: (made.append((f, self)), was(self, f, *a, **k))[1])
    lm.train(lm.encoded(docs, v).where("word is null"), v)
    ((replica, dealt),) = [x for x in made if x[0].__name__ == "replica"]
    learned = []
    monkeypatch.setattr(lm.gru.Trainer, "_backward", lambda self, *a: learned.append(int(a[-1].sum())))
    assert len(list(replica(dealt.orderBy("r").toArrow().to_batches()))) == 7  # 31,800 tokens, 5,000 a replica
    assert sum(learned) == 196 * 101 + 4 * 3001 == v.tokens


def test_lm_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(lm, "REPLICA_TOKENS", 20_000)
    monkeypatch.setattr(lm, "FAN", 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    held = lambda: F.col("doc_id") % 5 == 1
    first, second = ({r["doc_id"]: (r["base_score"], r["score"]) for r in lm.score(docs.repartition(n), held).collect()} for n in (2, 6))
    assert first.keys() == second.keys()
    for i, (base, score) in first.items():
        assert second[i] == (pytest.approx(base, rel=1e-9), pytest.approx(score, rel=1e-6))


def test_token_blocks_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = [(i, f"text {i} with  two spaces\nand lines, é日本") for i in range(30)] + ODD
    path = str(tmp_path / "t")
    token_output.write(table(spark, docs), path)
    got = token_output.read(spark, path, with_ids=True).orderBy("start").collect()
    lib = Tokenizer.from_file(token_output.default_tokenizer())
    want = sorted((-(1 << 63) if i is None else i, [*lib.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in docs)
    assert sorted((-(1 << 63) if r["doc_id"] is None else r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == want
    at = 0
    for r, before in zip(got, [None, *got], strict=False):
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(r["ids"]) and r["n_tokens"] * 4 == len(r["ids"])
        assert before is None or (before["doc_id"] if before["doc_id"] is not None else -1) <= (r["doc_id"] if r["doc_id"] is not None else -1)
        at += r["n_tokens"]
    token_output.write(table(spark, []), str(tmp_path / "e"))
    assert token_output.read(spark, str(tmp_path / "e")).count() == 0


def test_damage_in_what_is_said_of_a_block_is_noticed(spark, tmp_path):
    from pyspark.errors import PySparkException

    token_output.write(table(spark, [(i, f"text {i} and more of it") for i in range(20)]), str(tmp_path / "t"))
    stored = spark.read.schema(token_output.BLOCKS).parquet(str(tmp_path / "t"))
    swapped = lambda c: F.concat(F.unhex(F.lit("2A")), F.substring(c, 2, 1 << 20))
    for k, change in enumerate(({"lengths": swapped("lengths")}, {"doc_ids": swapped("doc_ids")}, {"before": F.col("before") + 1}, {"n_docs": F.col("n_docs") + 1})):
        stored.withColumns(change).write.parquet(str(tmp_path / f"b{k}"))
        with pytest.raises(PySparkException, match="checksum"):
            token_output.read(spark, str(tmp_path / f"b{k}")).collect()


def test_encoder_is_the_library(spark):
    from tokenizers import Tokenizer

    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += ["", " ", "  a", "a  ", "a   b", "a \n b", "\n\n x", "a b c", "it's we're", " <|endoftext|> x", "x  y"]
    lib = Tokenizer.from_file(token_output.default_tokenizer())
    enc = token_output.Encoder(token_output.default_tokenizer())
    for lo in range(0, len(texts), 64):
        part = texts[lo : lo + 64]
        for t, got in zip(part, enc.encode(part), strict=True):
            assert got.tolist() == lib.encode(t, add_special_tokens=False).ids


def test_encoder_is_the_library_beside_other_white_space():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_output.default_tokenizer())
    enc = token_output.Encoder(token_output.default_tokenizer())
    texts = [f"a{pad}b" for s in "\u00a0\u2003\u3000\u0085\n\t\x1c" for pad in (f" {s} {s} ", f" {s}" * 4 + " ", f"{s} {s}", f" {s}", f"{s} ")]
    assert [x.tolist() for x in enc.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_keeps_what_it_met_again(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "REMEMBERED", 60)
    lib = Tokenizer.from_file(token_output.default_tokenizer())
    enc = token_output.Encoder(token_output.default_tokenizer())
    learned = []
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda: (learned.extend(enc.known.new), learn()))
    for k in range(12):
        texts = [f"the often met words {k}x{j} and  two\u00a0 spaces, {k}y{j}" for j in range(20)] + ["", None, "one", " <|endoftext|> x"]
        assert [x.tolist() for x in enc.encode(texts)] == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert learned.count("often") == 1 and len(enc.known) <= 60 + 2 * 20 + 10


def test_chat_collapse(spark):
    c = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"), (3, 1, "assistant", "x"), (4, 0, "user", "a"), (4, 1, "assistant", "b"), (4, 2, "user", "c"), (5, 3, "user", "q<|im_end|>"), (5, 3, "user", "q<|im_end|>"), (None, 0, "user", "lost"), (6, None, None, None)]
    c += [(7, i, "user", f"t{i}") for i in range(200)] + [(8, i, "user", f"t{i}") for i in range(199)]
    df = spark.createDataFrame(c, "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit(1)).withColumn("pos", F.lit(2))
    got = {r["conv_id"]: (r["n_turns"], r["text"]) for r in chat.collapse(df).collect()}
    assert set(got) == {2, 3, 5, 6, 7} and got[7][0] == 200
    assert got[2] == (3, "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n")
    assert got[5][1] == "<|im_start|>user\nq< |im_end|><|im_end|>\n" and got[7][1].index("t9<") < got[7][1].index("t10<")
    assert chat.collapse(df.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rows = queries.op5_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    bad, good = rows[rows.toxic == 1].score, rows[rows.toxic == 0].score
    assert np.mean([(b > good).mean() + 0.5 * (b == good).mean() for b in bad]) > 0.65 and rows[rows.predicted == 1].toxic.mean() > 0.8


def test_toxicity_of_odd_rows(spark):
    docs = table(spark, [(i, "you idiot fool" if i % 2 else "fine words here") for i in range(40)] + ODD)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (7, None), (8, 0)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled_sample(docs, labels))
    s = toxicity.score(docs, model)
    assert s.count() == 40 + len(ODD) and s.where("score < 0 or score > 1 or score is null").count() == 0
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.where("doc_id < 7").collect()} == {0, 2, 4, 6}
    none = toxicity.fit(toxicity.labelled_sample(docs, labels.limit(0)))
    assert toxicity.score(docs, none).where("score < 0.3").count() == 40 + len(ODD) and toxicity.score(docs.limit(0), none).count() == 0


def test_line_dedup(spark):
    a = "Opening line of the first text.\nA shared passage of more than five words stands here.\nAnd a second shared line with several words.\nEnd."
    b = "Something else begins this one here.\nA SHARED passage of more than five words stands here.\nAnd a second shared line with several words.\nOther end of it."
    docs = [(1, a), (2, b), (3, a), (4, "short\nshort"), (5, "short"), *ODD]
    got = {(r["doc_id"], r["text"]): (r["n_lines"], r["n_removed"]) for r in line_dedup.deduplicated(table(spark, docs)).collect()}
    assert got[1, a] == (4, 0) and got[2, "Something else begins this one here.\nOther end of it."] == (4, 2)
    assert got[3, ""] == (4, 4) and got[4, "short\nshort"] == (2, 0) and got[5, "short"] == (1, 0) and (None, "null id text here") in got
    assert line_dedup.deduplicated(table(spark, docs)).count() == len(docs) and line_dedup.deduplicated(table(spark, [])).count() == 0


def test_line_dedup_meets_every_holder(spark):
    a, b, c = ("%s is a line of more than five words" % x for x in ("Alpha", "Beta", "Gamma"))
    # in another order than in the first holder, but in line with the second
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.deduplicated(table(spark, [(1, f"{a}\n{b}"), (2, f"{b}\n{a}"), (3, f"{b}\nown\n{a}")])).collect()}
    assert got == {1: 0, 2: 1, 3: 2}
    # short lines with a first holder each, together in a third document only
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.deduplicated(table(spark, [(1, "one two three"), (2, "four five six"), (3, "one two three\nfour five six"), (4, "x\none two three\nfour five six\ny")])).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 2}
    # common lines in line with the 10th holder only; lines that are repeated in both
    docs = [(i, f"{a}\n{i}\n{b}\n{c}") for i in range(9)] + [(9, f"{c}\n{b}\n{a}"), (10, f"{c}\nx\n{b}\ny\n{a}")]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.deduplicated(table(spark, docs)).collect()}
    assert got[10] == 3
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.deduplicated(table(spark, [(1, f"p\n{a}\n{b}\n{a}\n{b}\nq"), (2, f"r\n{a}\n{b}\n{a}\n{b}\ns")])).collect()}
    assert got == {1: 0, 2: 4}
    # rows that share an id have runs of their own
    got = line_dedup.deduplicated(table(spark, [(1, "one two three\nfour five six"), (2, "one two three\nfour five six"), (2, "four five six\none two three")])).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 2, 2]


def test_warc_derivatives(spark):
    p = spark.createDataFrame([(1, "http://a/", "<p>x</p>"), (None, None, None), (2, "http://b\r\nX: y/", "")], "page_id long, url string, html string").withColumn("record", F.lit(1))
    rows = warc.derivatives(p).collect()
    assert len(rows) == 6 and {r["record_type"] for r in rows} == {"metadata", "conversion"}
    for r in rows:
        (rec,) = warc.parse(bytes(r["record"]))
        assert rec.get("WARC-Refers-To") == r["refers_to"] and len(rec.block) == r["content_length"]
    assert warc.derivatives(p.limit(0)).count() == 0


def test_warc_files(spark, tmp_path):
    responses = [warc.response(f"http://h/{i}", f"<title>T{i}</title><p>text {i}</p>", key=i) for i in range(20)]
    df = spark.createDataFrame([(warc.serialise(r),) for r in responses] + [(None,)], "record binary").repartition(3)
    names = warc.write_files(df, str(tmp_path / "in"))
    assert names and all(n.endswith(".warc.gz") for n in names)
    back = warc.read_files(spark, str(tmp_path / "in"))
    assert sorted(bytes(r["record"]) for r in back.collect()) == sorted(map(warc.serialise, responses))
    out = warc.derived(back)
    warc.write_files(out, str(tmp_path / "out"))
    again = warc.read_files(spark, str(tmp_path / "out"))
    assert sorted(bytes(r["record"]) for r in again.collect()) == sorted(warc.serialise(d) for r in responses for d in warc.derive(r))
    assert {r["refers_to"] for r in out.collect()} == {r.get("WARC-Record-ID") for r in responses}


def test_warc_against_records_made_one_by_one(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = sorted(warc.serialise(d) for r in pages.collect() for d in warc.derive(warc.response(r["url"], r["html"], key=r["page_id"])))
    assert sorted(bytes(r["record"]) for r in warc.derivatives(pages).collect()) == want


def test_mixing_reports_targets_that_are_not_met(spark):
    cells = spark.createDataFrame([("a", "en", "prose", 10), ("b", "de", "prose", 10)], "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="off its target"):
        mixing.calibrated(cells, {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "de": 0.9}})
    docs = spark.createDataFrame([(1, "a b", "en", "s", 1)], "doc_id long, text string, lang string, source string, _mix_source int")
    assert mixing.sample(docs).columns == docs.columns and mixing.sample(docs).count() == 1


def test_mixing_meets_its_targets(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i % 5)), ["en", "de"][i % 3 == 0], f"s{i % 4}") for i in range(4000)] + [(None, None, None, None), (5, "", "en", "s0")], "doc_id long, text string, lang string, source string").withColumn("prob", F.lit(1))
    targets = {"source": {"s0": 0.4, "s1": 0.3, "s2": 0.2, "s3": 0.1}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"prose": 1.0}}
    rows = mixing.mixed(docs, targets).toPandas()
    assert len(rows) == 4002 and rows.prob.max() == 1
    w = rows.n_tokens * rows.prob
    for axis in ("source", "lang"):
        share = w.groupby(rows[axis]).sum() / w.sum()
        assert all(abs(share[k] - v) < 1e-3 for k, v in targets[axis].items())
    kept = mixing.sample(docs, targets)
    assert kept.columns == docs.columns and kept.count() == int(rows.kept.sum()) and mixing.mixed(docs.limit(0)).count() == 0
    wide = mixing.calibrated(mixing.described(docs).groupBy(*mixing.AXES).agg(F.sum("n_tokens").alias("tokens")), None, rounds=3, max_cells=1).toPandas()
    small = mixing.calibrated(mixing.described(docs).groupBy(*mixing.AXES).agg(F.sum("n_tokens").alias("tokens")), None, rounds=3).toPandas()
    both = wide.merge(small, on=list(mixing.AXES))
    assert len(both) == len(small) == len(wide) and np.allclose(both.prob_x, both.prob_y, atol=1e-6)


def test_mixing_wide_leaves_missing_groups_out(spark):
    cells = spark.createDataFrame([(s, x, "prose", 10 * (i + 1)) for i, (s, x) in enumerate((s, x) for s in ("s0", "s1", "s2") for x in ("en", "de"))] + [("s3", "en", "prose", 0)], "source string, lang string, topic string, tokens long")
    for targets in ({"source": {"s0": 0.6, "s1": 0.4}}, {"source": {"s0": 1.0}, "lang": {"de": 1.0}}, {"source": {}}):
        wide, small = (mixing.calibrated(cells, targets, rounds=3, max_cells=n).toPandas().set_index(list(mixing.AXES)).prob.sort_index() for n in (1, 100))
        assert np.allclose(wide, small, atol=1e-6) and wide["s2", "en", "prose"] == 0 and wide["s3", "en", "prose"] == 1


def test_spotsigs_edited(spark):
    docs = [(5, "the quick brown fox"), (9, "é" * 7), (1, "Of mice and men, of war"), (3, None), (4, "")]
    got = {r["doc_id"]: r for r in spotsigs.edited(table(spark, docs)).collect()}
    order = sorted(((i, t or "") for i, t in docs), reverse=True)
    for k, (i, t) in enumerate(order):
        nxt, half = order[(k + 1) % len(order)][1], len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert 0 <= got[i]["near_edited"] <= 1 and (got[i]["fingerprint"] == got[i]["edited_fingerprint"]) == (got[i]["near_edited"] == 1)
    same = spotsigs.edited(table(spark, ODD + [(20, "the one cat"), (21, "the one cat")])).collect()
    assert len(same) == len(ODD) + 2 and len({r["fingerprint"] for r in same if r["doc_id"] in (20, 21)}) == 1
    assert spotsigs.edited(table(spark, [])).count() == 0


def brute_signatures(text):
    import re

    w = ["<s>", *re.split(r"[\s!-/:-@\[-`{-~]+", text.lower())]
    anchors = {"<s>", *spotsigs.ANCHORS}
    out = set()
    for i, x in enumerate(w):
        after = [y for y in w[i + 1 :] if y and y not in anchors][:2]
        if x in anchors and after:
            out.add((x, *after))
    return out or ({tuple(w)} if any(x in spotsigs.ANCHORS for x in w) else set())


def test_spotsigs_against_brute_force(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["the", "of", "and", "in", "cat", "dog", "bird", "fox,", "Fish"]) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(60, "the of " * 4000), (61, "the " * 4000 + "cat"), (62, "cat dog " * 4000)]
    got = {r["doc_id"]: r for r in spotsigs.edited(table(spark, docs)).collect()}
    for k, (i, t) in enumerate(order := sorted(docs, reverse=True)):
        nxt, half = order[(k + 1) % len(order)][1], len(t) // 2
        own, edited, after = brute_signatures(t), brute_signatures(t[: len(t) - half] + nxt[:half]), brute_signatures(nxt)
        like = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
        assert len(got[i]["fingerprint"].split()) == len(own) and len(got[i]["edited_fingerprint"].split()) == len(edited)
        assert got[i]["near_edited"] == pytest.approx(like(own, edited)) and got[i]["near_next"] == pytest.approx(like(own, after))


def test_spotsigs_ranges_join_up(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "LEAST_RANGES", 7)
    docs = [(i * 3, f"the word{i} of thing{i}") for i in range(50)]
    rows = {r["doc_id"]: r["next_text"] for r in spotsigs.with_next(table(spark, docs)).collect()}
    assert rows == {i * 3: docs[(k := i - 1)][1] if i else docs[-1][1] for i in range(50)}


def test_spotsigs_pairs_against_brute_force(spark, corpus):
    docs = [(i, t.replace(" w1", " the w1").replace(" w2", " of w2")) for i, t in corpus]
    sets = {r["doc_id"]: frozenset(r["sigs"]) for r in spotsigs.fingerprints(table(spark, docs)).collect()}
    first: dict[frozenset, int] = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    ids = sorted(first.values())
    want = {(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-12}
    assert {(r["a"], r["b"]) for r in spotsigs.near_pairs(table(spark, docs)).collect()} == want


def test_oracles(spark, duck):
    from test_oracles import rows

    from loresift.llm import oracles

    for name, sql in oracles.oracle_sql().items():
        mine, theirs = queries.queries()[name](spark, SF).toPandas(), duck.sql(sql).df()
        assert rows(mine) == rows(theirs), name


def test_pipeline(spark):
    import corpus_pipeline

    from loresift.llm.common import cut, table as load

    docs = load(spark, SF, "documents")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(cut(stage(spark, kept[-1], SF)))
        assert kept[-1].columns == docs.columns
    raw, tox, near, clean, mix = ({r["doc_id"]: r["text"] for r in k.collect()} for k in kept)
    assert set(mix) <= set(clean) <= set(near) <= set(tox) <= set(raw)
    groups = brute_groups(list(tox.items()), 5)
    assert set(near) == {i for i, (_, c) in groups.items() if i == c}
    passages = [r["text"] for r in load(spark, SF, "benchmark").collect()]
    assert not any(p in t for t in clean.values() for p in passages) and len(clean) > 0.8 * len(near)
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) == set(mix)


def test_queries_and_files():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)] + ["pipeline"]
    assert set(queries.queries()) <= set(entry.queries())
    for p in (Path(queries.__file__).parent.parent).rglob("*.py"):
        if p.parent.name != "llm":
            assert "loresift.llm" not in p.read_text()
