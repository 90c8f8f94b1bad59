"""Brute force, round trips and edge cases of what runs without Spark."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loresift.llm import decontaminate, fst, gru, line_dedup, rangecoder, setsketch, toxicity, warc, wordhash


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aA bé\n\t\x0b.,", max_size=40)), max_size=6), st.sampled_from([7, 1 << 20]))
def test_words_are_what_bytes_split_gives(texts, chunk):
    was, wordhash.CHUNK = wordhash.CHUNK, chunk
    try:
        seen: dict[bytes, int] = {}
        rows = 0
        for lo, hi, h, off in wordhash.hashed(pa.array(texts, pa.string())):
            for r in range(lo, hi):
                words = (texts[r] or "").encode().lower().split()
                got = h[off[r - lo] : off[r - lo + 1]].tolist()
                assert len(got) == len(words)
                for w, x in zip(words, got, strict=True):
                    assert seen.setdefault(w, x) == x
                rows += 1
        assert rows == len(texts) and len(set(seen.values())) == len(seen)
    finally:
        wordhash.CHUNK = was


def test_shingles_are_distinct_and_short_texts_have_one():
    (_, _, h, off), = wordhash.hashed(pa.array(["a b a b", "a", "", "b a b a b"]))
    v, o = wordhash.shingles(h, off, 2)
    assert np.diff(o).tolist() == [2, 1, 0, 2]
    assert set(v[o[0] : o[1]]) == set(v[o[3] : o[4]])


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    a, b = x[:2000], x[500:2500]
    off = np.array([0, len(a), len(a) + len(b), len(a) + len(b) + len(np.union1d(a, b))])
    r = setsketch.registers(np.concatenate([a, b, np.union1d(a, b)]), off)
    assert (setsketch.merge(r[0], r[1]) == r[2]).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    guess = setsketch.joint_jaccard(r[:1], r[1:2], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(guess - true) < 0.1
    assert (setsketch.registers(np.empty(0, np.uint64), np.array([0, 0])) == 0).all()


def test_small_sets_share_an_exact_bucket():
    rng = np.random.default_rng(4)
    for _ in range(3000):
        pool = np.unique(rng.integers(0, 1 << 63, 12).astype(np.uint64))
        a, b = (np.sort(rng.choice(pool, rng.integers(1, 11), replace=False)) for _ in range(2))
        same, both = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * same >= 80 * both and min(len(a), len(b)) < 8:
            assert len(np.intersect1d(setsketch.small_keys(a), setsketch.small_keys(b)))


def test_every_element_visits_every_register():
    value = np.random.default_rng(5).integers(0, 1 << 63, 20).astype(np.uint64)
    r = setsketch.registers(value, np.arange(21))
    assert (r > 0).all() and len(np.unique(r, axis=0)) == 20


def test_registers_agree_as_often_as_sets_do():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, (40, 300)).astype(np.uint64)
    same = 0
    for row in x:
        r = setsketch.registers(np.concatenate([row[:250], row[50:]]), np.array([0, 250, 500]))
        same += (r[0] == r[1]).mean()
    assert abs(same / 40 - 200 / 300) < 0.03


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 999), max_size=400))
def test_blocks_round_trip(ids):
    assert rangecoder.decode(rangecoder.encode(np.array(ids, int), 1000), 1000).tolist() == ids


def test_blocks_compress_and_notice_damage():
    rng = np.random.default_rng(0)
    ids = rng.choice(50257, 60_000, p=(w := 1 / np.arange(1, 50258)) / w.sum())
    block = rangecoder.encode(ids, 50257)
    entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids.tolist()).values()) / 8
    assert (rangecoder.decode(block, 50257) == ids).all() and len(block) < 2 * len(ids) and len(block) / len(ids) < entropy * 1.35
    repeated = np.tile(ids[:50], 20_000)
    assert len(rangecoder.encode(repeated, 50257)) < len(repeated) / 4  # orders 1 and 2 at work
    for at in (5, 17, len(block) // 2):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            rangecoder.decode(bytes(bad), 50257)
    with pytest.raises(ValueError):
        rangecoder.decode(block[:10], 50257)
    with pytest.raises(ValueError):
        rangecoder.encode(np.array([0]), rangecoder.MOST_IDS + 1)
    wide = [0, 100_000, 7, 131_071] * 50
    assert rangecoder.decode(rangecoder.encode(np.array(wide), 1 << 17), 1 << 17).tolist() == wide


def test_successors_of_a_context_are_learned():
    """An id is one of three given the last: 1.58 bits an id."""
    rng = np.random.default_rng(0)
    follow, ids = rng.integers(0, 5000, (5000, 3)), np.zeros(1 << 18, int)
    which = rng.integers(0, 3, len(ids))
    for i in range(1, len(ids)):
        ids[i] = follow[ids[i - 1], which[i]]
    block = rangecoder.encode(ids, 50257)
    assert 8 * len(block) / len(ids) < 3 and (rangecoder.decode(block, 50257) == ids).all()


def test_weights_of_a_lane_add_up():
    m = rangecoder.Model(1000, 8)
    rng = np.random.default_rng(1)
    for _ in range(60):
        m.begin(False)
        found, w, w0 = m.look()
        assert (w.sum(axis=0) + w0 == 4096).all() and (w0 >= 4).all() and (w >= 0).all()
        sym = rng.integers(0, 5, 8)
        m.learn(sym, found == sym)


def test_a_candidate_of_both_orders_has_one_weight():
    m = rangecoder.Model(1000, 8)
    for sym in [5, 7] * 20:
        m.begin(False)
        found, w, _ = m.look()
        ids = np.full(8, sym)
        m.learn(ids, found == ids)
    m.begin(False)
    found, w, _ = m.look()
    assert (((found == 5) & (w > 0)).sum(axis=0) == 1).all() and (w[found == 5].max(initial=0) > 2048)


@pytest.mark.parametrize("size", [50257, 1 << 17])
def test_blocks_of_hard_ids_come_back(size):
    """Carries through many words, the rarest ids in a row, long lanes."""
    rng = np.random.default_rng(3)
    for ids in (np.full(300_000, size - 1), np.r_[np.zeros(200_000, int), rng.integers(0, size, 100_000)], np.tile([0, size - 1, 1], 70_000), rng.integers(0, size, 1), rng.integers(0, 3, 257)):
        assert (rangecoder.decode(rangecoder.encode(ids, size), size) == ids).all()


def test_gradients_are_those_of_the_loss():
    lay = gru.Layout(6, 3, np.array([0, 2, 6]))
    p = {k: v.astype(np.float64) for k, v in gru.new_params(lay, np.array([5.0, 4, 3, 2, 1, 1]), np.array([2.0, 1, 1]), hidden=3, seed=1).items()}
    rng = np.random.default_rng(0)
    p = {k: v + rng.normal(0, 0.3, v.shape) for k, v in p.items()}
    rows, off = rng.integers(0, 9, 14).astype(np.int32), np.array([0, 6, 14])
    was, gru._F = gru._F, np.float64
    try:
        t = gru.Trainer(p, lay)
        grads: dict[str, np.ndarray] = {}

        def keep(name, grad, where=slice(None)):
            grads.setdefault(name, np.zeros_like(p[name]))[where] += grad

        t._step = keep
        t.learn(rows, off, lanes=2)
        loss = lambda q: -gru.log_likelihood(q, rows, off, lay).astype(np.float64).sum() / 256
        for name in p:
            for at in list(np.ndindex(*p[name].shape))[:: max(1, p[name].size // 6)]:
                up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
                up[name][at] += 1e-4
                down[name][at] -= 1e-4
                assert grads[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-4, abs=2e-5)
    finally:
        gru._F = was


def test_state_is_carried_and_lanes_do_not_mix():
    lay = gru.Layout(8, 2, np.array([0, 4, 8]))
    p = gru.new_params(lay, np.ones(8), np.ones(2), hidden=4)
    rng = np.random.default_rng(3)
    p = {k: (v + rng.normal(0, 0.5, v.shape)).astype(np.float32) for k, v in p.items()}
    docs = [rng.integers(0, 10, n).astype(np.int32) for n in (1, 40, 17, 3, 90)]
    off = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    together = gru.log_likelihood(p, np.concatenate(docs), off, lay)
    alone = np.concatenate([gru.log_likelihood(p, d, np.array([0, len(d)]), lay) for d in docs])
    assert np.allclose(together, alone, atol=1e-5)


def test_model_probabilities_sum_to_one():
    lay = gru.Layout(5, 2, np.array([0, 2, 5]))
    p = gru.new_params(lay, np.array([3.0, 2, 1, 1, 1]), np.array([1.0, 2]), hidden=3)
    first = np.array([1, 6, 3], np.int32)
    total = sum(math.exp(gru.log_likelihood(p, np.append(first, x).astype(np.int32), np.array([0, 4]), lay)[-1]) for x in range(7))
    assert total == pytest.approx(1, abs=1e-4)


def brute_overlap(same, num, den):
    best = (0, 0)
    for i in range(len(same)):
        for j in range(i + 1, len(same) + 1):
            if same[i] and same[j - 1] and den * sum(same[i:j]) >= num * (j - i) and j - i > best[1] - best[0]:
                best = (i, j)
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), max_size=25))
def test_longest_overlap(bits):
    assert decontaminate.longest_overlap(np.array(bits, bool), 80, 100) == brute_overlap(bits, 80, 100)


@pytest.mark.parametrize("vocab", ["ab", "abcdef"])
def test_hits_have_every_diagonal_of_equal_seeds(vocab, monkeypatch):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    for trial in range(25):
        monkeypatch.setattr(decontaminate, "PAIRS", 7 if trial % 2 else 1 << 20)
        index = decontaminate.Index([(i, text(rng.randint(0, 30))) for i in range(4)])
        for _, _, h, off in wordhash.hashed(pa.array([text(rng.randint(0, 60)) for _ in range(5)]), wordhash.PLAIN):
            got = {tuple(x) for x in index.hits(h, off).tolist()}
            for r in range(5):
                for i in range(4):
                    for k, mask in enumerate(decontaminate.MASKS):
                        a, b = (decontaminate.seeds(x, mask, k).tolist() for x in (h[off[r] : off[r + 1]], index.h[index.off[i] : index.off[i + 1]]))
                        assert {(r, i, x - y) for x in range(len(a)) for y in range(len(b)) if a[x] == b[y]} <= got


def test_long_and_repetitive_texts_need_little_memory():
    import tracemalloc

    rng = random.Random(7)
    copied, same = " ".join(f"w{rng.randrange(3000)}" for _ in range(20_000)), "x " * 20_000
    index = decontaminate.Index([(1, copied), (2, "x " * 1000), (3, same)])
    tracemalloc.start()
    for text in (copied, same):
        for _, _, h, off in wordhash.hashed(pa.array([text]), wordhash.PLAIN):
            assert len(index.hits(h, off))
    assert decontaminate.longest_overlap(np.ones(20_000, bool), 80, 100) == (0, 20_000)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_spaced_seeds_ignore_masked_positions():
    h = np.arange(20, dtype=np.uint64)
    for k, mask in enumerate(decontaminate.MASKS):
        other = h.copy()
        for i, c in enumerate(mask):
            if c == "0":
                other[i] = 99
        assert decontaminate.seeds(h, mask, k)[0] == decontaminate.seeds(other, mask, k)[0]
        other[0] = 98
        assert decontaminate.seeds(h, mask, k)[0] != decontaminate.seeds(other, mask, k)[0]
    assert len(decontaminate.seeds(h[:3], "11111", 0)) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=14), st.lists(st.integers(1, 6), max_size=14))
def test_patience_aligns_in_order(a, b):
    m = line_dedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in m)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:], strict=False))
    once = {x for x in a if a.count(x) == 1 and b.count(x) == 1}
    if a == b:
        assert len(m) == len(a)
    if len(once) == len(set(a)) == len(a) and a == sorted(a) and b == sorted(b) and len(b) == len(set(b)):
        assert len(m) == len(set(a) & set(b))


def test_blocks_of_lines_need_enough_words():
    assert line_dedup.blocks([(0, 0), (1, 1), (5, 7)], {0: 3, 1: 2, 7: 4}, 5) == [0, 1]


def test_composition_counts_like_its_parts():
    a, b = fst.within("N", 2, ("I",), "negated"), fst.between("Q", ("I",), "quoted")
    c = fst.compose(a, b, ("N", "Q", "I"))
    rng = random.Random(0)
    for _ in range(200):
        word = [rng.choice("NQIx") for _ in range(8)]
        states = [a.start, b.start, c.start]
        for s in word:
            got = []
            for k, t in enumerate((a, b, c)):
                states[k], marks, _ = t.step(states[k], s)
                got.append(marks)
            assert got[0] | got[1] == got[2]


def test_trie_reads_the_longest_pattern():
    rng = random.Random(3)
    for _ in range(200):
        patterns = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 5))): (rng.choice([0.5, 1.0, 2.5]), rng.random() < 0.4) for _ in range(6)}
        t = fst.trie(patterns, "insult")
        for _ in range(20):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))
            fits = [p for p, (_, whole) in patterns.items() if word == p or (not whole and word.startswith(p))]
            marks, weight = fst.read(t, [*word, fst.END])
            assert bool(marks) == bool(fits)
            assert weight == pytest.approx(patterns[max(fits, key=len)][0] if fits else 0.0)


def brute_clause(tokens, scorer):
    """Kinds and weights by looking at every token's surroundings."""
    w, out = toxicity.WEIGHTS, []
    read_as = [scorer.of_word(t) for t in tokens]
    symbols = [s for s, _ in read_as]
    for i, (s, own) in enumerate(read_as):
        if s not in toxicity.HITS:
            continue
        before = lambda c, n: c in symbols[max(0, i - n) : i]  # noqa: B023, E731
        after = lambda c, n: c in symbols[i + 1 : i + 1 + n]  # noqa: B023, E731
        marks = {"targeted": [before("P", 4), after("P", 3)], "threat": [s == "V" and before("M", 5)], "negated": [before("N", 3)], "reported": [before("R", 6), symbols[:i].count("Q") % 2 == 1, after("R", 4)]}
        kind = next((k for k in ("negated", "reported", "threat", "targeted") if any(marks[k])), "plain")
        out.append((s, toxicity.KINDS.index(kind), own + sum(w[k] * sum(v) for k, v in marks.items())))
    return out


def test_clauses_against_brute_force():
    scorer = toxicity.Scorer(toxicity.Model({"idiot": (5.0, True), "fool": (2.0, False), "dolt": (3.0, True)}, toxicity.PRIOR))
    rng = random.Random(4)
    words = ["idiot", "fools", "dolt", "you", "not", "said", "will", "kill", "and", "the", '"', "er"]
    for _ in range(400):
        tokens = [rng.choice(words) for _ in range(rng.randint(0, 25))]
        got, want = scorer.clause(tokens), brute_clause(tokens, scorer)
        assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_clauses_are_read_whole_and_once():
    scorer = toxicity.Scorer(toxicity.Model({"idiot": (5.0, True)}, toxicity.PRIOR))
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["idiot ", "you ", "x ", ". ", "! ", "; ", "\n", "word ", "preidiot "]) for _ in range(rng.randint(0, 40)))
        import re

        parts = [toxicity._TOKEN.findall(c) for c in re.split(r"[.!?;\n]", text)]
        hit = lambda ts: any(scorer.of_word(t)[0] in toxicity.HITS for t in ts)
        assert [ts for ts in scorer.clauses(text) if hit(ts)] == [ts for ts in parts if hit(ts)]


def test_grammar_marks_clauses():
    s = toxicity.Scorer(toxicity.Model({"idiot": (5.0, True), "lowei": (4.5, False)}, toxicity.PRIOR))
    n = len(toxicity.KINDS)
    name = lambda text: [toxicity.KINDS[k % n] for k in np.flatnonzero(s.features(text)[: 4 * n])]
    assert name("an idiot") == ["plain"] and name("You are such an idiot") == ["targeted"] and name("idiot, you") == ["targeted"]
    assert name("he is not an idiot") == ["negated"] and name('she said "what an idiot"') == ["reported"] and name("what an idiot, she said") == ["reported"]
    assert name("I will kill the lights") == ["threat"] and name("kill the lights") == ["plain"] and name("Kill! you") == ["plain"]
    assert name("LOWEIschaft here") == ["plain"] and name("idiotic") == [] and name("preidiot") == []
    assert s.score("he is not an idiot") < s.score("an idiot") < s.score("you idiot and idiot, idiot")
    assert 0 <= s.score("") < 0.3 and s.score("clean words") == s.score("")
    assert s.score("filler " * 200_000 + "you idiot") > s.score("")


def test_warc_round_trip_and_links():
    page = '<html lang="EN"><head><title>A &amp; B</title><style>x{}</style></head><body><p>Hi &lt;you&gt;<br>there</p><script>bad()</script><a href="/x?a=1&amp;b">l</a><!-- no --></body></html>'
    r = warc.response("http://h.org/p/", page, key=7)
    (got,) = warc.parse(warc.serialise(r))
    assert got == r and warc.payload(got) == page
    meta, conv = warc.derive(got)
    assert conv.block.decode() == "Hi <you>\nthere\nl" and b"outlink: http://h.org/x?a=1&b" in meta.block and b"title: A & B" in meta.block
    for d in (meta, conv):
        assert d.get("warc-refers-to") == r.get("WARC-Record-ID") and d.get("WARC-Source-Payload-Digest") == r.get("WARC-Payload-Digest")
        assert d.get("WARC-Block-Digest") == warc.digest(d.block) and int(d.get("Content-Length")) == len(d.block)
    assert warc.derive(meta) == [] and list(warc.parse(b"")) == []
    with pytest.raises(ValueError):
        list(warc.parse(warc.serialise(r)[:-40]))
    assert warc.plain_text("<p>open <script>never closed") == "open" and warc.plain_text("") == ""
    r.headers += [("WARC-IP-Address", "10.0.0.1"), ("WARC-Concurrent-To", "<urn:a>"), ("WARC-Concurrent-To", "<urn:b>")]
    for d in warc.derive(r):
        assert d.get("WARC-Source-Block-Digest") == r.get("WARC-Block-Digest") and d.get("WARC-IP-Address") == "10.0.0.1"
        assert [v for k, v in d.headers if k == "WARC-Source-Concurrent-To"] == ["<urn:a>", "<urn:b>"]
    assert b"http-status: HTTP/1.1 200 OK" in meta.block and b"http-header: Content-Type: text/html; charset=utf-8" in meta.block


def test_warc_pages_of_unclosed_tags_take_linear_time():
    import time

    start = time.time()
    for piece in ("<script", "<script>", "<!-- ", "<p ", "<a ", "<a href=x ", "<title>", "<head>", "<noscript>x", "</script "):
        page = piece * 60_000
        warc.derive(warc.response("http://h/", page))
    links = "".join(f'<a href="/p{i}">x</a>' for i in range(30_000))
    meta, _ = warc.derive(warc.response("http://h/", links))
    assert meta.block.count(b"outlink: ") == 30_000 and time.time() - start < 60
    assert warc.visible("a<!--x-->b<script>y</script>c<head>d<style>z</style>e") == "a b c<head>d e"


def test_warc_files_by_member_or_whole():
    import gzip

    a, b = (warc.serialise(warc.response(f"http://h/{i}", f"<p>{i}</p>")) for i in (1, 2))
    for data in (a + b, gzip.compress(a) + gzip.compress(b), gzip.compress(a + b)):
        assert warc.unpacked(data) == a + b and len(list(warc.parse(warc.unpacked(data)))) == 2
    with pytest.raises((ValueError, OSError)):
        warc.unpacked(gzip.compress(a)[:-9])
