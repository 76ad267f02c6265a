import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from strandloom.llm import (
    bpe, decontamination, line_dedup, minhash_dedup, pii, posting_lists, quality, queries, secret_scan, sharding, tagger, url_filter,
)
from strandloom.llm.shingles import shingle_set, words_of
from strandloom.llm.tagger import Tagger

#: Worn forms of personal data that training never sees.
UNSEEN_FORMS = {"at": ["{at}", " <at> "], "dot": ["{dot}", "<.>"], "ip": ["{.}", "(dot)"], "card": ["|", "\u2013"], "phone": ["|", "\u2013"]}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def words(seed, n):
    rng = random.Random(seed)
    return [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(n)]


ODD_TEXTS = [None, "", " ", "\n", "a", "A a\n\nb  c \t d", "é À ß 漢字 😀 x", "x" * 5000, "word " * 3000, "\x00\x1f\x85   y"]


# -- line dedup


def brute_lines(rows):
    held = defaultdict(set)
    cut = lambda t: (t or "").split("\n")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    for i, t in rows:
        for line in cut(t):
            held[key(line)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v - {None}) >= 5}
    keep = [[x for x in cut(t) if gone.get(key(x), i) == i] for i, t in rows]
    return [(i, len(cut(t)), len(cut(t)) - len(k), "\n".join(k)) for (i, t), k in zip(rows, keep, strict=True)]


def test_line_dedup(spark):
    long = "This line is long enough to count, as é is one point."
    rows = [(i, f"own {i}\n  {long.upper().replace('É', 'é') if i % 2 else long}\t\nshort\n{long}") for i in range(7)]
    rows += [(20 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(30, long[:39])] + rows[2:3]
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r["__n_lines"], r["__n_dropped"], r.text or "") for r in got) == sorted(brute_lines(rows))


def test_line_dedup_keeps_other_columns_whatever_their_names(spark):
    rows = [(1, "a\nb", "p", 2)]
    got = line_dedup.dedup_lines(frame(spark, rows, "doc_id long, text string, pos string, keep int")).first()
    assert (got.pos, got.keep, got.text) == ("p", 2, "a\nb")
    clash = [(i, f"{'x' * 50}\n{i}", "own", 7) for i in range(6)]
    clash = frame(spark, clash, "doc_id long, text string, __n_lines string, __row int")
    kept = line_dedup.dedup_lines(clash, counts=False)
    assert kept.columns == clash.columns and {(r["__n_lines"], r["__row"]) for r in kept.collect()} == {("own", 7)}
    assert {(r["__n_lines"], r["__row"]) for r in line_dedup.dedup_lines(clash).collect()} == {(2, 7)}
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    nulls = line_dedup.dedup_lines(frame(spark, [(None, "a"), (None, None)])).collect()
    assert sorted((r.text is None, r["__n_dropped"]) for r in nulls) == [(False, 0), (True, 0)]


# -- sharding


def brute_slot(doc_id, crc, copy):
    name = f"{'none' if doc_id is None else doc_id}:{crc}:{copy}"
    return int(hashlib.md5(name.encode()).hexdigest()[:8], 16) % sharding.SLOTS


def brute_rebalance(held, size, shards):
    """held: shard by slot. Shards keep their largest slots up to the mean; the rest go, largest first, to the least loaded."""
    mean, load, new, moving = sum(size.values()) / shards, [0] * shards, {}, []
    for shard in set(held.values()):
        total = 0
        for minus, slot in sorted((-size.get(s, 0), s) for s, x in held.items() if x == shard):
            total -= minus
            if shard < shards and (total <= mean or not minus):
                new[slot] = shard
                load[shard] -= minus
            else:
                moving.append((minus, slot))
    for minus, slot in sorted(moving):
        to = load.index(min(load))
        new[slot] = to
        load[to] -= minus
    return new


def test_shards_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 40)
    rng = random.Random(4)
    rows = [(i, "x" * rng.choice([0, 5, 50, 500])) for i in range(3000)] + [(None, None), (None, ""), (5, "é"), (5, "é")]
    rows += [(7, "hot" * 60)] * 2000  # many copies of one row
    got = [tuple(r) for r in sharding.shard_documents(frame(spark, rows)).collect()]
    made, times = [], defaultdict(int)
    for i, t in rows:
        data = (t or "").encode()
        key = (i, len(data) + 1, zlib.crc32(data))
        made.append((*key, times[key], brute_slot(i, key[2], times[key])))
        times[key] += 1
    size = defaultdict(int)
    for r in made:
        size[r[4]] += r[1]
    at = brute_rebalance({s: s % 16 for s in range(sharding.SLOTS)}, size, 16)
    by_shard = defaultdict(list)
    for r in made:
        by_shard[at[r[4]]].append(r)
    want = []
    for shard, inside in by_shard.items():
        inside.sort(key=lambda r: (r[4], r[0] is not None, r[0] or 0, r[2], r[1], r[3]))
        want += [(*r[:3], r[4], shard, n) for n, r in enumerate(inside)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    load = defaultdict(int)
    for r in got:
        load[r[4]] += r[1]
    assert set(load) == set(range(16)) and max(load.values()) - min(load.values()) <= 1100
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def test_a_map_is_used_again_and_edited_only_where_slots_move(spark, tmp_path):
    docs = frame(spark, [(i, "x" * (i % 90)) for i in range(4000)])
    path = f"{tmp_path}/map"
    first = sorted(map(str, sharding.shard_documents(docs, map_path=path).collect()))
    assert sorted(map(str, sharding.shard_documents(docs, map_path=path).collect())) == first
    versions = {r.version: r["count"] for r in spark.read.parquet(path).groupBy("version").count().collect()}
    assert versions == {1: sharding.SLOTS, 2: sharding.SLOTS}
    fewer = sharding.shard_documents(docs, shards=15, map_path=path)  # every shard that goes gives up its slots
    assert {r.shard for r in fewer.select("shard").distinct().collect()} == set(range(15))
    with pytest.raises(ValueError):
        sharding.shard_documents(docs, slots=64, map_path=path)


def test_rebalancing_moves_few_slots_and_keeps_versions(spark, tmp_path):
    docs = frame(spark, [(i, "x" * (i % 90)) for i in range(4000)])
    weights = sharding.slot_weights(sharding.with_slots(sharding.distinct_rows(docs)))
    path = f"{tmp_path}/map"
    first = sharding.save_map(sharding.first_map(spark, 16), path)
    second = sharding.save_map(sharding.rebalance(first, weights, 16), path)
    third = sharding.save_map(sharding.rebalance(second, weights, 17), path)
    assert [m.first().version for m in (first, second, third)] == [1, 2, 3]
    assert spark.read.parquet(path).count() == 3 * sharding.SLOTS
    moved = second.alias("a").join(third.alias("b"), "virtual_slot").filter("a.shard <> b.shard").join(weights, "virtual_slot")
    to_new, all_moved = (moved.filter(c).agg(F.sum("bytes")).first()[0] for c in ("b.shard = 16", "true"))
    total = weights.agg(F.sum("bytes")).first()[0]
    assert to_new >= 0.9 * all_moved and all_moved < 1.1 * total / 17


# -- urls


def brute_rule(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_urls(spark, monkeypatch):
    rng = random.Random(2)
    hosts = ["com", "example.com", "www.example.com", "a.b.www.example.com", "xexample.com", "x.net", "net", "EXAMPLE.Com", "a.com", "org", "", "example.com.", "net\0foo", "foo\0net", "\1.net", "net\1\2x", "\0"]
    paths = ["", "/", "/en/", "/en/x?/fr/", "/en", "/es/1", "/fr/#x", "?q=/en/", "/en/a/b"]
    urls = [None, "", "example.com/en/", "http://", "://com/"] + [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    rules = [*url_filter.RULES, ("b.www.example.com", "/en/a", "block"), ("x.net", "", "allow"), ("example.com", "/", "block")]
    pages = frame(spark, [(i % 350, u) for i, u in enumerate(urls)], "page_id long, url string")
    want = sorted((i % 350, *brute_rule(u, rules)) for i, u in enumerate(urls))
    want = sorted(map(str, want))
    for block in (200_000, 3):  # one block of rules, and several
        monkeypatch.setattr(url_filter, "BLOCK", block)
        assert sorted(str(tuple(r)) for r in url_filter.judge_urls(pages, rules).collect()) == want
    assert url_filter.judge_urls(frame(spark, [], "page_id long, url string"), rules).count() == 0


# -- secrets


def brute_secrets(text):
    out = []
    for n, r in enumerate(secret_scan.RULES):
        pattern = r"[0-9a-f]+" if r.kind == "hex" else r.pattern
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), n, m.end()))
    return sorted(out)


def test_secrets(spark):
    rng = random.Random(8)
    bits = ["password", "API_KEY", "apikey", "Token", "secret", "=", ": ", '"', "'", " ", "é", "AKIA", "ABCDEFGH1234567", "0123456789abcdef" * 2,
            "x.y/z=", "passwd:abcdefgh", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890", "\n"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))) for i in range(300)]
    rows += [(900 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "token=abcdefgh"), (3, "token=abcdefgh"), (3, "token=abcdefgh")]
    got = secret_scan.scan(frame(spark, rows)).collect()
    found = sorted(str((r.doc_id, [tuple(s) for s in r.spans])) for r in got)
    assert found == sorted(str((i, brute_secrets(t))) for i, t in rows)
    assert secret_scan.scan(frame(spark, [])).count() == 0


def test_many_secrets_in_one_text(spark):
    n = 100_000
    text = "".join(f"token=abcdefgh{i % 7} é " for i in range(n))
    frame(spark, [(1, "token=abcdefgh")]).select("*").count()
    began = time.time()
    spans = secret_scan.scan(frame(spark, [(1, text)])).select(F.size("spans"), F.element_at("spans", -1)["end"]).first()
    assert tuple(spans) == (n, len(text) - 3) and time.time() - began < 20
    short = [(n, "token=abcdefgh " * n) for n in (0, 1, 199, 200, 201, 399, 400, 401)]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_scan.scan(frame(spark, short)).collect()}
    assert got == {i: brute_secrets(t) for i, t in short}


def test_trigram_queries():
    q = secret_scan.trigram_query
    assert q("abcd") == [frozenset({"abc", "bcd"})]
    assert q("(abc|xyzz)[0-9]+") == [frozenset({"abc"}), frozenset({"xyz", "yzz"})]
    assert q("ab?c+[0-9a-f]{32}") is None and q("[0-9a-f]{32,}") is None
    assert q("x_?key") == [frozenset({"_ke", "key", "x_k"}), frozenset({"key", "xke"})]


# -- near duplicates


def brute_groups(rows, plan):
    sets = {i: set(shingle_set(words_of(t), plan.width).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= plan.percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("plan", [minhash_dedup.Plan(), minhash_dedup.Plan(3, 85, 6)])
def test_near_groups_are_brute_force(spark, plan):
    rng = random.Random(6)
    base = words(1, 120)
    rows = [(i, " ".join(words(100 + i, rng.randint(0, 60)))) for i in range(40)]
    for i in range(330):  # one large group whose members aren't all near each other
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(3000, "one two"), (2999, "ONE  two\n"), (3001, "one")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_groups(frame(spark, rows), plan).collect()}
    want = brute_groups(rows, plan)
    assert got == want
    assert len({c for _, c in want.values()}) > 20


def test_near_groups_of_odd_tables(spark):
    assert minhash_dedup.near_groups(frame(spark, [])).count() == 0
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None), (3, None)]
    got = sorted((r.doc_id, r.component_id) for r in minhash_dedup.near_groups(frame(spark, rows)).collect())
    assert got == [(1, 1), (1, 1), (2, 2), (3, 3)]


# -- contained benchmark items


def test_contained_items_of_few_words_and_in_passes(spark, monkeypatch, tmp_path):
    """The SQL too has items under five words; many passes over the documents find what one does."""
    base = words(21, 3000)
    items = [(i, " ".join(base[i * 30 : i * 30 + n])) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 20, 28])] + [(20, None), (21, ", ."), (22, "One, two")]
    docs = [(i, " ".join(base[i * 17 : i * 17 + 90])) for i in range(150)] + [(900, "one two"), (901, "Two"), (902, None)]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    order = lambda df: sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in df)
    got = order(decontamination.op8_contained_items(spark, str(tmp_path)).collect())
    monkeypatch.setattr(decontamination, "MOST_BITS", 1 << 11)
    assert order(decontamination.op8_contained_items(spark, str(tmp_path)).collect()) == got
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    rows = db.execute(decontamination.OP8_SQL).fetchall()
    assert sorted(r[:4] for r in rows) == got and {i for _, i, *_ in got} >= {0, 1, 2, 3, 22}


def test_bitmaps_pass_few_strangers(spark):
    rng = np.random.default_rng(5)
    hashes = np.unique(rng.integers(0, 2**64, 200_000, np.uint64))
    rows = spark.createDataFrame([(5, 3, 8, int(h)) for h in hashes.view(np.int64)], "width int, part int, need long, hash long")
    [(_, _, need, top, bits, bitmap)] = decontamination._bitmaps(rows)
    assert need == 8 and top == hashes.max()
    assert len(decontamination.passing(hashes, bits, bitmap)) == len(hashes)
    assert len(decontamination.passing(rng.integers(0, 2**64, 100_000, np.uint64), bits, bitmap)) < 7000


def test_contained_items(spark):
    item = " ".join(words(7, 30))
    worn = item.split()
    worn[3] = "other"
    gone = item.split()
    gone[10] = gone[20] = "other"
    far = " ".join(words(8, 3000))
    rows = [
        (1, far + " " + item + " " + far), (2, item.upper().replace(" ", "!\n")), (3, " ".join(worn)), (4, " ".join(gone)), (5, far),
        (6, None), (7, ""), (None, item), (8, " ".join(item.split()[:15]) + " x " + " ".join(item.split()[12:])), (9, "tiny item"), (9, "tiny item"),
    ]
    items = frame(spark, [(1, item), (2, None), (3, "..."), (4, "tiny item"), (None, item)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontamination.contained_items(frame(spark, rows), items).collect())
    assert got == [(1, 1, 26, 26), (2, 1, 26, 26), (3, 1, 26, 22), (8, 1, 26, 25), (9, 4, 1, 1)]
    assert decontamination.contained_items(frame(spark, []), items).count() == 0
    assert decontamination.contained_items(frame(spark, rows), items.limit(0)).count() == 0


# -- nearest neighbours


def test_nearest_is_nearly_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[700:760] = x[5]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [None] * 16), (None, rows[0][1]), (9080, [float("inf")] * 16)]
    v = spark.createDataFrame(rows + odd + rows[:1], "vec_id long, embedding array<double>")
    plan = posting_lists.Plan(list_size=(64, 64), block=100)
    got = posting_lists.nearest(v, v.filter("vec_id % 20 = 0"), 20, plan).toPandas()
    hits = 0
    for q, f in got.groupby("query_id"):
        f = f.sort_values("rank")
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -s))[:20]
        assert f["rank"].tolist() == list(range(1, 21))
        assert np.allclose(f["score"], s[f["vec_id"]], atol=1e-12) and f["score"].is_monotonic_decreasing
        hits += len(set(best) & set(f["vec_id"]))
    assert set(got["query_id"]) == set(range(0, 1500, 20)) and hits >= 0.9 * 20 * 75


def test_nearest_of_few(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in posting_lists.nearest(v, v.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert posting_lists.nearest(v.limit(0), v.limit(0)).count() == 0


def test_nearest_of_odd_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 0.0]), (2, [1e-200, 3.0]), (3, [-1e200, 5.0]), (4, [1.0]), (5, [1.0, 2.0, 3.0]), (6, [])]
    rows += [(1, [2e200, 0.0]), (1, [1e200, 0.0]), (7, [0.0, 1e200])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id, r.score) for r in posting_lists.nearest(v, v.filter("vec_id in (2, 4)")).orderBy("rank").collect()]
    assert got == [(2, 0, 3e200), (2, 7, 3e200), (2, 3, 14.0), (2, 1, 1.0)]
    huge = [(r.vec_id, r.score) for r in posting_lists.nearest(v, v.filter("vec_id = 0")).orderBy("rank").collect()]
    assert [i for i, _ in huge] == [1, 7, 2, 3] and huge[0][1] == float("inf") and huge[3][1] == -float("inf")
    clash = v.filter("vec_id in (0, 7)").withColumn("score", F.lit("own")).withColumn("list", F.lit(3))
    assert posting_lists.nearest(clash, clash).count() == 2


def test_centroids_are_balanced_and_lists_pruned():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 12)) * 0.2 + rng.standard_normal((30, 12))[rng.integers(0, 30, 6000) ** 2 % 30]
    c = posting_lists.balanced_centroids(x, 200, 5)
    n = np.bincount(posting_lists.closest(np.unique(x, axis=0), c), minlength=len(c))
    assert n.max() <= 2 * len(x) / 200 and n.min() > 0 and 150 < len(c) < 400
    plan = posting_lists.Plan()
    shares = [plan.probes(plan.lists(n, n))[1] / plan.lists(n, n) for n in (500, 5000, 50_000, 3_000_000)]
    assert shares == sorted(shares, reverse=True) and shares[0] < 1


def test_nearest_beside_a_large_group_of_equal_vectors(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((3000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] = x[0]
    q = x[0] + rng.standard_normal((40, 8)) * 0.25  # near the group, not in it
    frame_of = lambda m, first: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m, first)], "vec_id long, embedding array<double>")
    points = posting_lists.balanced_centroids(x, 375, 5)
    assert len(np.unique(points, axis=0)) == len(points)
    got = posting_lists.nearest(frame_of(x, 0), frame_of(q, 10000), 20, posting_lists.Plan(list_size=(8, 8))).toPandas()
    hits = 0
    for i, one in enumerate(q):
        s = np.einsum("vd,d->v", x, one)
        edge = np.sort(s)[-20] - 1e-9  # equal vectors are as good as each other
        hits += (got[got["query_id"] == 10000 + i]["score"] >= edge).sum()
    assert hits >= 0.97 * 20 * 40


# -- personal data


PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute_pii(text):
    out = []
    for n, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = (True, n == 1 and max(int(x) for x in m[0].split(".")) <= 255, 13 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15)[n]
            if ok:
                out.append((n, *m.span()))
    return out


def test_base_spans_are_brute_force():
    rng = random.Random(1)
    sets = ["0123456789", ".@+- ", "ab.@", "1.", "4 -", "é٣", "+1 ()"]
    for _ in range(20000):
        s = "".join(rng.choice(rng.choice(sets)) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(s) == brute_pii(s), s
    assert pii.base_spans("a" * 300_000 + "@" * 1000 + "1" * 300_000) == []


def test_pii_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "a@b.co"), (50, "é a@b.co 10.0.0.1"), (50, "é a@b.co 10.0.0.1")]
    got = pii.find(frame(spark, rows)).collect()
    spans = sorted(str((r.doc_id, [tuple(s) for s in r.base])) for r in got)
    assert spans == sorted(str((i, [(pii.KINDS[k], a, b) for k, a, b in brute_pii(t or "")])) for i, t in rows)
    assert pii.find(frame(spark, [])).count() == 0 and pii.find(frame(spark, [(1, "none")])).first().added == []


def test_tagger_gradients():
    t = Tagger(3)
    rng = np.random.default_rng(0)
    t.params = {k: v.astype(np.float64) + rng.standard_normal(v.shape) * 0.3 for k, v in t.params.items()}
    ids, y = rng.integers(0, 130, (5, 3)).astype(np.uint8), rng.integers(0, 3, (5, 3))
    _, grads = t.gradients(ids, y)
    for k, p in t.params.items():
        at = (ids[2, 0], 1) if k.startswith("table") else tuple(0 for _ in p.shape)
        was, ends = p[at], []
        for e in (1e-5, -1e-5):
            p[at] = was + e
            ends.append(t.gradients(ids, y)[0])
        p[at] = was
        assert abs((ends[0] - ends[1]) / 2e-5 - grads[k][at]) < 1e-5, k


def naive_states(ids, table, u):
    """One sequence, one character and one cell at a time."""
    n = len(u)
    h, c, out = [0.0] * n, [0.0] * n, []
    for x in ids:
        z = [table[x][j] + sum(h[k] * u[k][j] for k in range(n)) for j in range(4 * n)]
        gate = lambda j: min(1.0, max(0.0, 0.25 * z[j] + 0.5))  # noqa: E731, B023
        c = [gate(n + j) * c[j] + gate(j) * np.tanh(z[3 * n + j]) for j in range(n)]
        h = [gate(2 * n + j) * np.tanh(c[j]) for j in range(n)]
        out.append(h)
    return np.array(out)


def brute_tags(t, text):
    """Every window by itself, its emissions faded into the next one's, and the best path over the whole text."""
    p, steps = {k: v.astype(np.float64) for k, v in t.params.items()}, tagger.STRIDE
    e = np.zeros((len(text) + 1, t.tags))
    for at in range(0, len(text) + 1, steps):
        ids = np.zeros(tagger.SIZE, np.uint8)
        part = tagger.char_ids(text[at : at + tagger.SIZE])
        ids[: len(part)] = part
        states = np.concatenate([naive_states(ids, p["table"], p["u"]), naive_states(ids[::-1], p["table_back"], p["u_back"])[::-1]], 1)
        for i, x in enumerate(states @ p["out"] + p["bias"]):
            share = min(1, (i + 0.5) / tagger.FADE) if at else 1
            share = min(share, (tagger.SIZE - i - 0.5) / tagger.FADE)
            if at + i < len(text):
                e[at + i] += share * x
    best, came = p["move"][0] + e[0], []
    for x in e[1 : len(text)]:
        way = best[:, None] + p["move"]
        came.append(way.argmax(0))
        best = way.max(0) + x
    tags = [int((best + p["move"][:, 0]).argmax())]
    for back in reversed(came):
        tags.append(int(back[tags[-1]]))
    return np.array(tags[::-1])


def test_one_path_over_the_whole_text_is_brute_force(monkeypatch):
    monkeypatch.setattr(tagger, "SIZE", 20)
    monkeypatch.setattr(tagger, "STRIDE", 14)
    monkeypatch.setattr(tagger, "FADE", 6)
    monkeypatch.setattr(tagger, "WINDOWS", 3)  # windows of one text in several blocks
    monkeypatch.setattr(tagger, "CHARACTERS", 90)
    rng = np.random.default_rng(5)
    t = Tagger(3)
    t.params = {k: (v + rng.standard_normal(v.shape) * 0.5).astype(np.float32) for k, v in t.params.items()}
    texts = ["", "a", "b" * 14, "".join(map(chr, rng.integers(32, 200, 75))), "mail a@b.c or 1.2.3.4 " * 8, "x" * 20, ""]
    shares = []
    for bias in (-1.5, -0.5, 0.0, 0.3, 1.5):  # from hardly any certain position to certain ones only
        t.params["bias"][0] = bias
        zeros = 0
        for text, got in zip(texts, t.tags_of(texts), strict=True):
            assert len(got) == len(text)
            if text:
                assert (brute_tags(t, text) == got).all()
                zeros += (got == 0).sum()
        shares.append(zeros / sum(map(len, texts)))
    assert any(0.1 < x < 0.9 for x in shares) and shares[0] < shares[-1]


def pii_rows(n):
    rng = random.Random(3)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        first = rng.choice("45") + d(14)
        return first + next(x for x in "0123456789" if pii.luhn(first + x))

    kinds = [lambda: f"{rng.choice(['ann', 'joe', 'li'])}.{d(2)}@mail{d(1)}.example.com", lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
             card, lambda: f"+1 ({d(3)}) 555-{d(4)}"]
    return [(i, " ".join([*words(i, 8), rng.choice(kinds)(), *words(i + 1, 8)])) for i in range(n)]


def test_added_spans_of_forms_that_training_never_saw(spark):
    rows = pii_rows(900)
    x, y = pii.labelled_windows(frame(spark, rows[:600]))
    assert len(x) <= pii.SAMPLE_DOCS * pii.SAMPLE_WINDOWS
    t = Tagger(5)
    t.fit(x, y)
    texts = [pii.rewritten(text, random.Random(i), UNSEEN_FORMS, 1.0) for i, text in rows[600:]]
    found, wanted, right, made = defaultdict(int), defaultdict(int), 0, 0
    for (text, spans), (base, added) in zip(texts, pii.tag_texts(t, [text for text, _ in texts]), strict=True):
        new = [s for s in spans if not any(s[1] < e and b < s[2] for _, b, e in base)]
        meets = lambda s, others: any(s[0] == k and s[1] < e and b < s[2] for k, b, e in others)
        for s in new:
            wanted[s[0]] += 1
            found[s[0]] += meets(s, added)
        right += sum(meets(s, new) for s in added)
        made += len(added)
    assert right >= 0.9 * made and sum(found.values()) >= 0.6 * sum(wanted.values())
    assert all(found[k] > 0 for k in range(4)), found
    clean = [" ".join(words(7000 + i, 60)) for i in range(200)]
    assert sum(len(added) for _, added in pii.tag_texts(t, clean)) == 0


def test_added_spans_stay_clear_of_base():
    text = "call 10.0.0.1 or 99[.]30[.]1[.]2 now 1.2"
    base = pii.base_spans(text)
    tags = np.zeros(len(text), np.uint8)
    tags[5:13] = tags[16:33] = tags[37:40] = 2
    assert pii.added_spans(text, tags, base) == [(1, 17, 32)]
    long = "1.2.3.4 " * 20_000
    spans = pii.base_spans(long)
    assert len(spans) == 20_000 and pii.added_spans(long, np.ones(len(long), np.uint8), spans) == []


def test_repeated_rows_do_not_grow_the_training_sample(spark):
    one = frame(spark, [(1, "mail a.b@c.de now")] * 3000 + [(2, "ip 1.2.3.4 now")])
    x, y = pii.labelled_windows(one)
    assert 0 < len(x) <= 2 * pii.SAMPLE_WINDOWS and (y > 0).any()


# -- quality


def test_quality(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.8
        w = words(i, rng.randint(20, 200))
        rows.append((i, " ".join(w if good else [x.upper() + "$$" for x in w])))
        labels.append((i, int(good)))
    rows += [(9000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "x")]
    docs, known = frame(spark, rows), frame(spark, [*labels, (None, 1), (4, None)], "doc_id long, quality int")
    got = quality.score(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r["__score"] <= 1 for r in got)
    held = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    right = [(r["__score"] >= 0.7) == bool(dict(labels)[r.doc_id]) for r in got if r.doc_id in held]
    assert len(right) > 100 and np.mean(right) > 0.95
    assert {r.doc_id for r in docs.filter(quality.held_out(F.col("doc_id"))).collect()} >= held
    assert quality.score(docs.limit(0), known).count() == 0
    assert quality.score(docs, known.limit(0)).first()["__score"] > 0.7


def test_chunks_cover_whole_texts_and_batching_changes_nothing():
    net = quality.train([], [])
    rng = np.random.default_rng(0)
    net.out[:] = rng.standard_normal(quality.FILTERS)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 5, 511, 512, 513, 3000, 40_000)]
    together = net.logits(texts)
    assert np.allclose(together, [net.logits([t])[0] for t in texts], atol=1e-4)
    spoiled = texts[-1][:39_000] + b"\xff" * 1000
    assert abs(net.logits([spoiled])[0] - together[-1]) > 1e-6


def naive_logit(net, text):
    """One window, one chunk and one filter at a time."""
    data = text + b"\0" * quality.WIDTH if text else b"\0" * (quality.WIDTH + 1)
    size, total = max(len(text), 1), 0.0
    for at in range(0, size, quality.CHUNK):
        n = min(quality.CHUNK, size - at)
        z = net.out_bias[0]
        for f in range(quality.FILTERS):
            best = max(
                sum(float(net.embed[data[at + i + k]] @ net.filters[k * quality.EMBED : (k + 1) * quality.EMBED, f]) for k in range(quality.WIDTH))
                for i in range(n)
            )
            z += max(best + net.bias[f], 0) * net.out[f]
        total += z * n
    return total / size


def test_the_network_is_its_naive_form_and_has_its_gradients(monkeypatch):
    monkeypatch.setattr(quality, "CHUNK", 20)
    rng = np.random.default_rng(2)
    net = quality.train([], [])
    for k in quality.NAMES:
        shape = getattr(net, k).shape
        setattr(net, k, rng.standard_normal(shape) * 0.5)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 5, 19, 20, 21, 67)]
    assert np.allclose(net.logits(texts), [naive_logit(net, t) for t in texts], atol=1e-5)
    data = rng.integers(0, 256, (4, 20 + quality.WIDTH - 1)).astype(np.uint8)
    size, y, share = np.array([20, 3, 11, 20]), np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 0.5, 1])
    _, grads = quality.gradients(net, data, size, y, share)
    for k in quality.NAMES:
        p = getattr(net, k)
        at = np.unravel_index(int(np.argmax(np.abs(grads[k]))), p.shape)
        was, ends = p[at], []
        for e in (1e-6, -1e-6):
            p[at] = was + e
            ends.append(quality.gradients(net, data, size, y, share)[0])
        p[at] = was
        assert abs((ends[0] - ends[1]) / 2e-6 - grads[k][at]) < 1e-6, k


def test_scores_of_tables_with_clashing_names_and_repeated_rows(spark):
    rows = [(i, f"text {i}" if i % 2 else "$$$ " * 9, "own", "q") for i in range(40)] + [(1, "text 1", "own", "q")] * 500
    docs = frame(spark, rows, "doc_id long, text string, __score string, quality string")
    known = frame(spark, [(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = quality.score(docs, known)
    assert sorted(got.columns) == sorted(docs.columns) and got.count() == len(rows) and 0 <= got.first()["__score"] <= 1
    other = quality.score(docs, known, to="__score_")
    assert other.columns == [*docs.columns, "__score_"] and {r["__score"] for r in other.collect()} == {"own"}
    assert len(quality.training_chunks(docs, known)) <= 40


# -- tokens


def test_bpe_is_tiktoken_and_comes_back(spark):
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCAB))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = [*ODD_TEXTS, "x  ", "  x y", "it's we'll 12 ½²", "ab" * 900 + " z", "zzz\x00 \x00q", "<|endoftext|> a", " " * 900, "a  b", "aaa\n bbb \n"]
    rows = list(enumerate([*odd, *odd, " ".join(words(1, 400))]))
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(frame(spark, rows), "text", "ids"), "ids", "back").collect()}
    for i, t in rows:
        assert np.frombuffer(got[i].ids, "<u4").tolist() == library.encode_ordinary(t or ""), t
        assert bytes(got[i].back) == (t or "").encode()
    again = {r.doc_id: r for r in bpe.round_trip(frame(spark, rows), "text", "ids", "back").collect()}
    assert all(again[i].ids == got[i].ids and again[i].back == got[i].back for i, _ in rows)
    assert bpe.encode(frame(spark, []), "text", "ids").count() == 0


def test_long_words_are_contracted_as_the_library_would():
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCAB))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pick = random.Random(8)
    alphabets = ["ab", "the", "aeiou", "etaoinshrdlu", "=-", "ää", "ha", "abcdefghijklmnopqrstuvwxyz"]
    made = ["".join(pick.choices(a, k=n)) for a in alphabets for n in (bpe.LONG_WORD, bpe.LONG_WORD + 1, 300, 1500)]
    made += ["a" * n for n in (65, 66, 127, 20_001, 500_000)] + ["banana" * 30, "é" * 90, "ab" * 33]
    codec = bpe.Codec(public_tokenizers.path(bpe.VOCAB), public_tokenizers.PATTERN)
    for word, ids in zip(made, codec.contract([w.encode() for w in made]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library._core_bpe.encode_single_piece(word.encode()), word[:40]


# -- queries over a small table


def test_queries_with_sql_agree(spark, tmp_path):
    long = "A line that is long enough to be counted by the rule."
    item = " ".join(words(5, 20))
    docs = [(i, f"{long}\ntoken = abcdefgh{i}\n{' '.join(words(i % 9, 40))}\n{item if i % 7 == 0 else ''}", "en", "s", 1) for i in range(40)]
    docs += [(100, None, None, None, None), (101, "", "en", "s", 0)]
    tables = {
        "documents": spark.createDataFrame(docs, DOCS),
        "benchmark": frame(spark, [(0, item)], "item_id long, text string"),
        "pages": frame(spark, [(0, "http://www.example.com/en/a"), (1, None), (2, "x")], "page_id long, url string"),
    }
    con = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, str(tmp_path))
        cur = con.execute(sql)
        cols = [d[0] for d in cur.description]
        assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, cur.fetchall())), name


def test_digests(spark, tmp_path):
    frame(spark, [(1, "Hi a@b.co"), (2, None)]).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.QUERIES["op1_bilstm_crf"](spark, str(tmp_path)).collect()}
    assert rows[1].n_email == 1 and rows[1].base_sha256 == hashlib.sha256(b"email:3:9").hexdigest() and "email:3:9" in rows[1].spans
    assert rows[2].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[2].spans == ""
    tokens = {r.doc_id: r for r in queries.QUERIES["op10_byte_bpe"](spark, str(tmp_path)).collect()}
    assert tokens[1].decoded_sha256 == hashlib.sha256(b"Hi a@b.co").hexdigest() and tokens[2].n_tokens == 0
    near = {r.doc_id: r.kept for r in queries.QUERIES["op2_odd_sketches"](spark, str(tmp_path)).collect()}
    assert near == {1: True, 2: True}
