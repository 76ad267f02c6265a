import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strandloom.operators import graph, lineage, neighbors
from strandloom.operators.components import connect
from strandloom.operators.simjoin import bad_barcodes, similar_pairs
from tests.test_fuzzy import brute, edits

ONE = "TCAGGGACCTTATTGCGAGAGTTGGAAGCAGTGTTA"
TWO = "TCAGGACCTTATTGCGACAGTTTGGAAGCAGTGTTA"


def records(spark, barcodes, ids=None):
    ids = ids or [f"r{i}" for i in range(len(barcodes))]
    rows = [(i, x, b) for i, (x, b) in enumerate(zip(ids, barcodes, strict=True))]
    return spark.createDataFrame(rows, "record_index long, id string, barcode string")


def mutated(b, n):
    b = list(b)
    for _ in range(n):
        i = random.randrange(len(b))
        what = random.choice("sid")
        if what == "s":
            b[i] = random.choice("ACGT")
        elif what == "i":
            b.insert(i, random.choice("ACGT"))
        elif len(b) > 30:
            del b[i]
    return ("".join(b) + "ACGTACGTACGT")[:36]


@pytest.fixture(scope="module")
def many():
    random.seed(5)
    base = ["".join(random.choice("ACGT") for _ in range(36)) for _ in range(25)]
    return base + [mutated(random.choice(base), random.randint(1, 3)) for _ in range(90)] + ["A" * 36, "T" * 36, "A" * 35 + "T"]


def pairs(df):
    return {(r.a, r.b) for r in df.collect()}


def test_complete_is_brute_force(spark, many):
    r = records(spark, many)
    d = set(many)
    assert pairs(similar_pairs(r, r)) == {(a, b) for a in d for b in d if edits(a, b) <= 3}


def test_compat_is_its_formula(spark, many):
    r = records(spark, many)
    d = set(many)
    seen = lambda a, b: any(a[i : i + 9] == b[j : j + 9] for i in (0, 9, 18) for j in range(27))
    assert pairs(similar_pairs(r, r, recall="compat")) == {(a, b) for a in d for b in d if seen(a, b) and edits(a, b) <= 3}


def test_compat_finds_one_pair_one_way_only(spark):
    r = records(spark, [ONE, TWO])
    got = pairs(similar_pairs(r, r, recall="compat"))
    assert (ONE, TWO) in got and (TWO, ONE) not in got
    assert {(ONE, TWO), (TWO, ONE)} <= pairs(similar_pairs(r, r))


def test_infix(spark, many):
    few = many[:60]
    r = records(spark, few)
    found = pairs(similar_pairs(r, r, "infix"))
    d = set(few)
    shares = lambda a, b: any(a[i : i + 9] in b for i in (0, 9, 18, 27))
    assert found == {(a, b) for a in d for b in d if shares(a, b) and brute(a, b, 3)[2] >= 0}
    shifted = records(spark, [ONE, ONE[3:] + "CCC"])
    assert (ONE, ONE[3:] + "CCC") in pairs(similar_pairs(shifted, shifted, "infix"))


def test_no_pair_is_lost_by_places_or_screening(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("ACGT") for _ in range(36)) for _ in range(12)] + ["T" * 36, "AC" * 18, "ACG" * 12]

    def worn(b):  # up to three edits anywhere, and cut from a longer stretch: parts shift by up to three
        b = list("".join(rng.choice("ACGT") for _ in range(3)) + b + "".join(rng.choice("ACGT") for _ in range(6)))
        start = rng.randrange(4)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(3, 36)
            rng.choice([lambda: b.insert(i, rng.choice("ACGT")), lambda: b.pop(i), lambda: b.__setitem__(i, rng.choice("ACGTN"))])()
        return "".join(b[start : start + 36])

    d = sorted({*base, *[worn(rng.choice(base)) for _ in range(90)]})
    r = records(spark, d)
    found = pairs(similar_pairs(r, r, "infix"))
    shares = lambda a, b: any(a[i : i + 9] in b for i in (0, 9, 18, 27))  # noqa: E731  # as three errors leave one part whole
    met = [(a, b) for a in d for b in d if shares(a, b)]
    assert found == {(a, b) for a, b in met if brute(a, b, 3)[2] >= 0} and len(found) > 2 * len(d)
    assert pairs(similar_pairs(r, r)) == {(a, b) for a, b in met if edits(a, b) <= 3}


@pytest.mark.parametrize("match", ["global", "infix"])
def test_hot_parts_are_dealt_out_and_lose_nothing(spark, match):
    rng = random.Random(3)
    hot = ["T" * 9 + "".join(rng.choice("ACGT") for _ in range(27)) for _ in range(120)] + ["T" * 36, "T" * 35 + "A", "T" * 17 + "G" + "T" * 18]
    r = records(spark, hot + [mutated(h, 2) for h in hot[:40]])
    few = pairs(similar_pairs(r, r, match, hot=7))
    assert few == pairs(similar_pairs(r, r, match)) and len(few) > 160
    assert pairs(similar_pairs(r, r, match, "compat", hot=7)) == pairs(similar_pairs(r, r, match, "compat"))


def test_odd_barcodes_meet_nothing(spark):
    r = records(spark, ["acgt" * 9, None, "ACG", "N" * 36, "R" + "A" * 35])
    assert pairs(similar_pairs(r, r)) == {("N" * 36, "N" * 36)}
    with pytest.raises(ValueError):
        similar_pairs(r, r, "fuzzy")
    assert {b.barcode for b in bad_barcodes(r).collect()} == {"acgt" * 9, None, "ACG", "R" + "A" * 35}
    with pytest.raises(Exception, match="not a barcode"):
        similar_pairs(r, r, on_bad_base="fail").collect()


def test_counts_are_of_ids_and_rows_are_kept(spark):
    r = records(spark, [ONE, ONE, TWO, "A" * 36], ["x", "x", "y", "z"])
    got = sorted((x.record_index, x.neighbors) for x in neighbors.neighbor_counts(r).collect())
    assert got == [(0, 2), (1, 2), (2, 2), (3, 1)]
    assert {(h.neighbors, h.barcodes) for h in neighbors.histogram(neighbors.neighbor_counts(r)).collect()} == {(2, 3), (1, 1)}
    profile = {p.barcode: (p.cost0, p.cost3) for p in neighbors.cost_profile(r).collect()}
    assert profile[ONE] == (1, 1)


def test_dense_histogram_overflows_into_its_last_bucket(spark):
    counts = spark.createDataFrame([(1,), (1,), (9,), (3,)], "neighbors long")
    dense = neighbors.dense_histogram(counts, 4)
    assert [r.barcodes for r in dense.orderBy("bucket").collect()] == [0, 2, 0, 2]
    assert neighbors.as_line(dense).first().value == "0,2,0,2"
    assert [r.barcodes for r in neighbors.patched(dense, 1, 7).orderBy("bucket").collect()] == [0, 7, 0, 2]
    pct = neighbors.percentages(dense).orderBy("bucket").collect()
    assert [round(p.pct) for p in pct] == [0, 50, 0, 50]
    assert round(sum(p.weighted_pct for p in pct)) == 100 and pct[1].weighted_pct_but_last == 100


def test_dictionary(spark):
    r = records(spark, [ONE, ONE], ["x", "y"])
    rows = neighbors.dictionary(r).collect()
    assert len({x.kmer for x in rows}) == 27 and sorted(x.id for x in rows) == ["x"] * 27 + ["y"] * 27
    assert [x.id for x in neighbors.dictionary(r, keep="last").collect()] == ["y"] * 27


def test_new_or_inherited_goes_by_other_ids(spark):
    r = records(spark, [ONE, TWO, "A" * 36, "C" * 36, "C" * 36], ["x", "y", "z", "c", "d"])
    got = {x.id: x.is_inherited for x in lineage.new_or_inherited(r).collect()}
    assert got == {"x": True, "y": True, "z": False}
    same = records(spark, [ONE, TWO], ["x", "x"])
    assert [x.is_inherited for x in lineage.new_or_inherited(same).collect()] == [False, False]


def test_cross_sample(spark):
    got = lineage.cross_sample(records(spark, [ONE, "A" * 36]), records(spark, [TWO])).orderBy("record_index").collect()
    assert [(x.matches, x.unmatched, x.single_match) for x in got] == [(1, False, True), (0, True, False)]


def test_patched_histogram_of_two_samples(spark):
    a, b = records(spark, [ONE, ONE, "A" * 36, "C" * 36]), records(spark, [TWO, "G" * 36])
    got = {r.bucket: r.barcodes for r in lineage.patched_histogram(a, b, 4).collect()}
    assert got == {0: 0, 1: 2, 2: 2, 3: 0}


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    got = {r.id: r.label for r in connect(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert connect(spark.createDataFrame([], "a long, b long")).count() == 0


def test_graph_statistics(spark):
    nodes = spark.createDataFrame([(x, x) for x in "abcdefg"], "barcode string, id string")
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f")], "src string, dst string")
    members = graph.components(nodes, links)
    stats = {r.component: (r.nodes, r.edges, r.is_clique) for r in graph.component_stats(members, links).collect()}
    assert stats == {"a": (3, 3, True), "d": (3, 2, False), "g": (1, 0, True)}
    assert [(r.component, r.clique_number) for r in graph.clique_numbers(members, links).collect()] == [("d", 2)]
    assert graph.clique_numbers(members, links, nodes=23).count() == 0
    sizes = {(r.is_clique, r.nodes): r.components for r in graph.size_histogram(graph.component_stats(members, links)).collect()}
    assert sizes == {(True, 3): 1, (False, 3): 1, (True, 1): 1}
    assert graph.union(links, links).count() == 5


def test_clique_number_of_a_large_component(spark):
    rng = random.Random(7)
    # a hub of 600 leaves, one of them in a clique of six, and random links among some others
    found = {("hub", f"v{i:03}") for i in range(600)}
    found |= {(f"v{i:03}", f"v{j:03}") for i in range(6) for j in range(i)}
    found |= {tuple(sorted(rng.sample([f"v{i:03}" for i in range(100, 160)], 2))) for _ in range(700)}
    pairs_of = {tuple(sorted(e)) for e in found}
    near = {}
    for a, b in pairs_of:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    nodes = spark.createDataFrame([(v, v) for v in near], "barcode string, id string")
    links = spark.createDataFrame(sorted(pairs_of), "src string, dst string")
    members = graph.components(nodes, links)
    want = [(601, graph.largest_clique(near))]
    assert want[0][1] >= 7
    assert [(r.nodes, r.clique_number) for r in graph.clique_numbers(members, links).collect()] == want
    assert [(r.nodes, r.clique_number) for r in graph.clique_numbers(members, links, whole=1).collect()] == want


def test_largest_clique():
    near = {v: set("abcd") - {v} for v in "abcd"} | {"e": {"a"}}
    near["a"] = near["a"] | {"e"}
    assert graph.largest_clique(near) == 4


def test_levenshtein_agrees_with_duckdb(spark, many):
    con = duckdb.connect()
    rows = spark.createDataFrame([(many[i], many[-i - 4]) for i in range(30)], ["a", "b"])
    for r in rows.select("a", "b", F.levenshtein("a", "b").alias("d")).collect():
        assert r.d == con.execute("select levenshtein(?, ?)", [r.a, r.b]).fetchone()[0]
