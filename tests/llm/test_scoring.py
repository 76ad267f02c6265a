import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import bloom_lm, importance, lexical_search

ODD_TEXTS = [None, "", " ", "\n", "a", "A a\n\nb  c \t d", "é À ß 漢字 😀 x", "x" * 5000, "word " * 3000, "\x00\x1f\x85   y"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def texts(seed, n, most=40):
    """Texts with words of very different frequency, some twice, and a hot one."""
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.paretovariate(0.7)), 400)}"
    out = [" ".join(word() for _ in range(rng.randrange(1, most))) for _ in range(n)]
    return out + out[: n // 5] + ["The same text, Again and again 7"] * (n // 3)


# -- language-model scores


def trained(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 != 1


def brute_lm(rows, order, mu):
    """With the exact counts of n-grams, quantised as the operator does."""
    grams = [Counter() for _ in range(order)]
    cut = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if w]
    for i, t in rows:
        if trained(i):
            seq = [0, *cut(t), 1]
            for n in range(order):
                grams[n].update(tuple(seq[k - n : k + 1]) for k in range(n, len(seq)))
    counts = Counter({g: c for g, c in grams[0].items() if g != (0,)})
    total, distinct = sum(counts.values()), len(counts)
    level = lambda c: int(np.searchsorted(bloom_lm.LEAST, c, "right")) - 1
    least = lambda c: int(bloom_lm.LEAST[level(c)])
    most = lambda c: int(bloom_lm.GREATEST[level(c)]) if c else 0
    out = []
    for i, t in rows:
        seq = [0, *cut(t), 1]
        base = score = 0.0
        for k in range(1, len(seq)):
            c = counts[(seq[k],)]
            base += math.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
            p = (least(c) + 0.5) / (total + 0.5 * (distinct + 1))
            for n in range(1, min(order - 1, k) + 1):
                before = most(grams[n - 1][tuple(seq[k - n : k])])
                p = (min(least(grams[n][tuple(seq[k - n : k + 1])]), before) + mu * p) / (before + mu)
            score += math.log10(p)
        known = sum(counts[(w,)] > 0 for w in seq[1:])
        out.append((i, len(seq) - 1, known, total, base, score))
    return out


def same_rows(got, expected):
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got, expected = sorted(map(tuple, got), key=order), sorted(expected, key=order)
    assert [r[:4] for r in got] == [r[:4] for r in expected]
    return np.array([r[4] for r in got]) - [r[4] for r in expected], np.array([r[5] for r in got]) - [r[5] for r in expected]


@pytest.mark.parametrize("order,frequent", [(2, 1 << 20), (3, 5)])
def test_lm_scores_against_exact_counts(spark, monkeypatch, order, frequent):
    """The filter gives what exact counts give, but for its false positives; with few frequent words most are joined by shuffle."""
    monkeypatch.setattr(bloom_lm, "MU", (32.0,))
    monkeypatch.setattr(bloom_lm, "LEARN_BYTES", 3000)
    monkeypatch.setattr(bloom_lm, "SCORE_BYTES", 2000)
    rows = [(i, t) for i, t in enumerate(texts(1, 60) + ODD_TEXTS)] + [(None, "the same text"), (3, "rare-word a"), (3, "rare-word a")]
    docs = frame(spark, rows).withColumn("levels", F.lit("x")).withColumn("learnt", F.lit(1))
    training = ~bloom_lm.held_out(F.col("doc_id"))
    model = bloom_lm.Model(docs.filter(training), order, frequent=frequent)
    base, score = same_rows(bloom_lm.score(docs, model, training).collect(), brute_lm(rows, order, 32.0))
    assert np.abs(base).max() < 1e-6
    assert (np.abs(score) < 1e-6).mean() > 0.6 and np.abs(score).mean() < 0.5


def test_lm_passes_change_nothing(spark):
    rows = [(i, t) for i, t in enumerate(texts(2, 80) + ODD_TEXTS)]
    docs = frame(spark, rows).repartition(3)
    training = ~bloom_lm.held_out(F.col("doc_id"))
    found = []
    for mb in (128, 0.0005):
        model = bloom_lm.Model(docs.filter(training), filter_mb=mb)
        found.append(sorted(map(tuple, bloom_lm.score(docs, model, training).collect())))
    assert len(model.runs) > 2
    assert found[0] == found[1]


def test_lm_many_blocks_take_no_further_passes(spark, monkeypatch):
    """However many runs of blocks there are, texts are written once; longer n-grams come back to their places too."""
    monkeypatch.setattr(bloom_lm, "SCORE_BYTES", 2000)
    written = []
    monkeypatch.setattr(bloom_lm, "stored", lambda df, name, write=bloom_lm.stored: (written.append(name), write(df, name))[1])
    rows = [(i, t) for i, t in enumerate(texts(8, 80) + ODD_TEXTS)] + [(None, "the same text"), (3, "rare-word a")]
    docs = frame(spark, rows).repartition(3)
    training = ~bloom_lm.held_out(F.col("doc_id"))
    found = []
    for mb in (128, 0.0005):
        model = bloom_lm.Model(docs.filter(training), 3, filter_mb=mb)
        written.clear()
        found.append(sorted(bloom_lm.score(docs, model, training).collect(), key=str))
    assert len(model.runs) > 2 and len(written) == 2
    assert found[0] == found[1]


def test_lm_filter_never_reads_too_low():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    n = rng.zipf(1.5, len(h)).clip(1, 10**12)
    level = np.searchsorted(bloom_lm.LEAST, n, "right") - 1
    part = bloom_lm.part_of(h, 16)
    blocks = [(p, *bloom_lm.block_of(h[part == p], level[part == p], 16)) for p in range(16)]
    held = bloom_lm.Filter(16, sum(b[1] for b in blocks), blocks)
    assert (held.levels(h) >= level).all()
    assert (held.levels(h) > level).mean() < 0.015
    assert (held.levels(rng.integers(0, 2**63, 100_000).astype(np.uint64)) > 0).mean() < 0.015
    assert (bloom_lm.LEAST[1:] <= bloom_lm.GREATEST[1:]).all() and (bloom_lm.LEAST[:9] == np.arange(9)).all()


def test_lm_levels_are_read_by_few_probes(monkeypatch):
    """What took many probes is asked of the filter once a task, and gives what the filter gives; memory has a bound."""
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    level = rng.integers(0, 30, len(h))
    held = bloom_lm.Filter(1, *(lambda bits, block: (bits, [(0, bits, block)]))(*bloom_lm.block_of(h, level, 1)))
    asked, plain = [], held.levels(h)
    monkeypatch.setattr(held, "_read", lambda h, level, read=held._read: (asked.append(len(h)), read(h, level))[1])
    for most in (1 << 20, 500, 0):
        monkeypatch.setattr(bloom_lm, "MEMORY", most)
        memory = bloom_lm.Remembered(held)
        for some in (h[::2], h, h[:0], h):
            asked.clear()
            assert (memory.levels(some) == held.levels(some)).all()
        assert len(memory.h) <= most
        assert sum(asked) - len(h) == len(h) - min(most, int((plain >= bloom_lm.WORTH).sum()))


def test_lm_tokens_against_python():
    """Every word has a hash of its own, also where one begins another or has null bytes at its end."""
    rows = [*ODD_TEXTS, " ".join("x" * n for n in range(1, 70)), "\x00 \x00\x00 a\x00 a", " q\x1cq   z "]
    seen = bloom_lm.Tokens.of(pa.array(["left out", *rows], pa.string()).slice(1))
    numbers, expected = {}, []
    for t in rows:
        expected += ["begin", *(t or "").encode().lower().split(), "end"]
    got = seen.hashes[seen.which].tolist()
    assert [numbers.setdefault(w, h) for w, h in zip(expected, got, strict=True)] == got
    assert len(set(numbers.values())) == len(numbers)
    assert numbers["begin"] == bloom_lm.BEGIN and numbers["end"] == bloom_lm.END
    assert (seen.hashes[1:] > seen.hashes[:-1]).all()


def test_lm_probabilities_sum_to_one_at_most():
    """Over all words after one history, with any levels that counts may have."""
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 60, 50)
    total = int(counts.sum()) * 4
    of = lambda c: np.searchsorted(bloom_lm.LEAST, c, "right") - 1
    words = rng.multinomial(total, np.ones(50) / 50)
    level = np.zeros((4, 50), np.uint8)
    level[0], level[1], level[3] = of(words), of(counts), of(counts.sum())
    p = 10 ** bloom_lm.log_probabilities(level, np.full(50, 3), total, 50, np.array([1.0, 100.0]), False)
    assert (p > 0).all() and (p.sum(1) <= 1).all() and (p.sum(1) > 0.7).all()


def test_lm_empty_tables(spark):
    none, some = frame(spark, []), frame(spark, [(1, "a b"), (2, None)])
    no = F.lit(False)
    assert bloom_lm.score(none, bloom_lm.Model(some), no).collect() == []
    got = bloom_lm.score(some, bloom_lm.Model(none), no).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]


def test_lm_is_better_than_single_words_on_what_it_never_saw(spark):
    rng = random.Random(4)
    follows = {w: [rng.randrange(300) for _ in range(4)] for w in range(300)}

    def walk():
        out = [rng.randrange(300)]
        while len(out) < 60:
            out.append(rng.choice(follows[out[-1]]))
        return " ".join(f"v{w}" for w in out)

    docs = frame(spark, [(i, walk()) for i in range(600)])
    training = ~bloom_lm.held_out(F.col("doc_id"))
    out = bloom_lm.score(docs, bloom_lm.Model(docs.filter(training)), training).filter(~training)
    base, score = out.agg(F.sum("base_score"), F.sum("score")).first()
    assert score > 0.5 * base


# -- importance resampling


def brute_resampled(docs, target, width, buckets, percent, least, seed=2024):
    cut = lambda t: PLAIN.findall((t or "").translate(LOWER))
    runs = lambda w: [" ".join(w[i : i + n]) for n in range(1, width + 1) for i in range(len(w) - n + 1)]
    of = lambda t: [zlib.crc32(x.encode()) % buckets for x in runs(cut(t))]
    s, t = Counter(b for _, x in docs for b in of(x)), Counter(b for x in target for b in of(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    rows = []
    for i, x in docs:
        bag = of(x)
        weight = sum(map(gain, bag))
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(bag), weight, score, None, len(cut(x))])
    may = sorted((r for r in rows if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize("width,most", [(1, 100_000), (3, 100_000), (2, 0), (1, 20)])
def test_resampling(spark, width, most):
    docs = [(i, t) for i, t in enumerate(texts(5, 90) + ODD_TEXTS)] + [(None, "the same text " * 9), (4, "a b"), (4, "a b")]
    target = texts(6, 10)[:12] + [None, "Été 漢字 x"]
    items = frame(spark, [(t,) for t in target], "text string")
    named = frame(spark, docs).withColumn("__words", F.lit(1)).withColumn("score", F.lit("x"))
    got = importance.resampled(named, items, width, 500, 30, 15, most=most)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_resampled(docs, target, width, 500, 30, 15), key=key)


def test_resampling_of_empty_tables(spark):
    some, none = frame(spark, [(1, "a " * 30), (2, "b")]), frame(spark, [], "text string")
    assert importance.resampled(frame(spark, []), none).collect() == []
    got = {r.doc_id: (r.n_features, r["rank"]) for r in importance.resampled(some, none, percent=100).collect()}
    assert got == {1: (30, 1), 2: (1, None)}


def test_crc_is_composed():
    rng = random.Random(7)
    words = [rng.randbytes(rng.choice([0, 1, 2, 7, 255, 256, 70_000])) for _ in range(200)]
    a, b = words[:100], words[100:]
    crc = lambda w: np.array([zlib.crc32(x) for x in w], np.uint32)
    got = importance.composed(crc(a), crc(b), np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]


# -- ranked lexical search


def brute_search(docs, items, top):
    cut = lambda t: PLAIN.findall((t or "").translate(LOWER))
    bags = [(i, Counter(cut(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(cut(t))
    out = []
    for item, terms in wanted.items():
        found = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * n // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in terms if b[t]
            )
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(found)[:top])]
    return out


@pytest.mark.parametrize("block", [500_000, 10])
def test_search(spark, block):
    docs = [(i, t) for i, t in enumerate(texts(8, 300) + ODD_TEXTS)] + [(None, "w1 w2 w3"), (4, "w9 w8"), (4, "w9 w8")]
    items = [(i, t) for i, t in enumerate(texts(9, 20)[:20])] + [(50, None), (51, "..."), (None, "w1"), (3, "w399 again 7"), (52, "été nowhere")]
    named = frame(spark, docs).repartition(5).withColumn("n", F.lit("x")).withColumn("terms", F.lit(1))
    got = lexical_search.search(named, frame(spark, items, "item_id long, text string"), 15, block)
    assert sorted(map(tuple, got.collect())) == sorted(brute_search(docs, items, 15))


def test_search_of_empty_tables(spark):
    items, docs = "item_id long, text string", frame(spark, [(1, "a")])
    assert lexical_search.search(docs, frame(spark, [], items)).collect() == []
    assert lexical_search.search(frame(spark, []), frame(spark, [(1, "a")], items)).collect() == []


def vectors_of(seed, n, width):
    rng = np.random.default_rng(seed)
    rows = [np.sort(rng.permutation(width)[: rng.integers(0, 9)]) for _ in range(n)]
    rows = [np.flatnonzero(rng.random(width) < 2.0 / (1 + np.arange(width))) if i % 2 else r for i, r in enumerate(rows)]
    rows += [rows[3]] * (n // 3)
    ends = np.append(0, np.cumsum([len(r) for r in rows]))
    term = np.concatenate(rows).astype(np.int64)
    return rng.permutation(len(rows)), rng.integers(51, 300, len(rows)), ends, term, rng.integers(1, 9, len(term))


def test_trie_shares_paths_and_bounds_hold():
    doc_id, m, ends, term, tf = vectors_of(1, 600, 40)
    trie = lexical_search.Trie(doc_id, m, ends, term, tf, leaf=8)
    size = trie.hi - trie.lo
    leaves = np.flatnonzero(~trie.inner)
    assert sorted(trie.doc_id) == sorted(doc_id) and size[leaves].sum() == len(doc_id)
    for node in np.flatnonzero(trie.inner):
        below = trie.child[trie.children[node] : trie.children[node + 1]]
        assert (trie.parent[below] == node).all() and size[below].sum() == size[node] and len(below) > 1
    for node in leaves[size[leaves] > 8]:  # only equal vectors are left undivided
        paths = {tuple(trie.term[trie.ends[i] : trie.ends[i + 1]]) for i in range(trie.lo[node], trie.hi[node])}
        assert len(paths) == 1
    rng = np.random.default_rng(3)
    for _ in range(20):
        terms = np.sort(rng.permutation(45)[: rng.integers(1, 12)])
        weight = rng.integers(0, 5000, 45)
        of = np.zeros(45, np.int64)
        of[terms] = weight[terms]
        bound = trie.bounds(terms, weight[terms])
        for node in range(len(size)):
            assert trie.scores(node, of).max() <= bound[node]


def test_search_leaves_out_what_cannot_win():
    doc_id, m, ends, term, tf = vectors_of(5, 4000, 200)
    trie = lexical_search.Trie(doc_id, m, ends, term, tf, leaf=16)
    df = np.bincount(term, minlength=200)
    weight = np.floor(1000 * np.log((2 * len(doc_id) + 2) / (2 * df + 1))).astype(np.int64)
    looked = 0
    for i in range(20):
        terms = np.random.default_rng(i).permutation(200)[:8]
        of, best = np.zeros(200, np.int64), lexical_search.Best(5)
        of[terms] = weight[terms]
        looked += lexical_search.searched(trie, terms, weight[terms], of, best)
        every = trie.scores(0, of)
        order = np.lexsort((trie.doc_id, -every))[:5]
        assert best.score.tolist() == every[order].tolist() and best.doc_id.tolist() == trie.doc_id[order].tolist()
    assert looked < 20 * len(doc_id) / 2
