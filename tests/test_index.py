import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom import cli
from strandloom.functions import bits
from strandloom.operators import graph, lineage, simjoin
from strandloom.operators.index import NeighborIndex
from strandloom.operators.simjoin import similar_pairs
from strandloom.plans import catalog
from tests.test_fuzzy import edits
from tests.test_similarity import mutated, pairs, records


def code(barcodes):
    number = np.array([[bits.LETTERS.index(c) + 1 for c in b] for b in barcodes])
    return [((number >> k & 1) << np.arange(number.shape[1])).sum(1) for k in range(bits.PLANES)]


def infix_edits(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def family(seed, n, hot=""):
    rng = random.Random(seed)
    base = [(hot + "".join(rng.choice("ACGT") for _ in range(36)))[:36] for _ in range(n)]
    random.seed(seed)
    return base + [mutated(rng.choice(base), rng.randint(1, 3)) for _ in range(2 * n)]


def test_bits_spell_and_measure(spark):
    d = family(1, 60) + ["ACGTN" * 7 + "A"]
    a, b = zip(*itertools.product(d[:40] + d[-1:], d), strict=True)
    x, y = code(a), code(b)
    assert bits.spelled(x).to_pylist() == list(a)
    for infix, of in ((False, edits), (True, infix_edits)):
        assert bits.edit_costs(x, y, infix)[::7].tolist() == [of(p, q) for p, q in zip(a[::7], b[::7], strict=True)]
    rows = spark.createDataFrame([(s,) for s in d], ["s"]).select("s", *bits.planes(F.col("s"))).collect()
    assert [list(r[1:]) for r in rows] == [list(map(int, p)) for p in zip(*code(d), strict=True)]


@pytest.mark.parametrize("match", ["global", "infix"])
def test_offsets_and_screen_lose_no_near_pair(spark, match):
    """Every near pair has a part that is whole within its offsets, and passes the screen."""
    rng, worn = random.Random(7), []
    for _ in range(1500):
        a = "".join(rng.choice("ACGT") for _ in range(36))
        b = list("".join(rng.choice("ACGT") for _ in range(3)) + a + "".join(rng.choice("ACGT") for _ in range(6)))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(3, 36)
            rng.choice([lambda: b.insert(i, rng.choice("ACGT")), lambda: b.pop(i), lambda: b.__setitem__(i, rng.choice("ACGTN"))])()
        start = rng.randrange(0, 4)
        worn.append((a, "".join(b[start : start + 36])))
    of = edits if match == "global" else infix_edits
    near = [(a, b) for a, b in worn if of(a, b) <= 3]
    assert len(near) > 250
    for a, b in near:
        assert any(a[9 * i : 9 * i + 9] == b[9 * i + s : 9 * i + s + 9] for i, s in bits.offsets(match)), (a, b)
    x, y = code([a for a, _ in near]), code([b for _, b in near])
    rows = spark.createDataFrame([[*map(int, r)] for r in zip(*x, *y, strict=True)], ["a0", "a1", "a2", "b0", "b1", "b2"])
    assert rows.filter(~bits.may_be_near([F.col(f"a{k}") for k in range(3)], [F.col(f"b{k}") for k in range(3)])).count() == 0


def test_second_parts_are_what_is_beside_a_part():
    for i in range(4):
        covered = sorted([*range(9 * i, 9 * i + 9), *[x for p, n in simjoin.second_parts(i) for x in range(p, p + n)]])
        assert covered == list(range(36)) and min(n for _, n in simjoin.second_parts(i)) >= 6


@pytest.mark.parametrize("match", ["global", "infix"])
def test_crowded_parts_are_refined_and_lose_nothing(spark, match):
    r = records(spark, family(3, 50, "T" * 9) + family(4, 10, "ACGT" * 8) + ["T" * 36, "T" * 35 + "A"])
    whole = pairs(similar_pairs(r, r, match))
    assert pairs(similar_pairs(r, r, match, crowd=5)) == whole and len(whole) > 250
    assert pairs(similar_pairs(r, r, match, crowd=5, hot=4)) == whole
    other = records(spark, family(5, 5, "T" * 9) + family(3, 50, "T" * 9)[:20])
    assert pairs(similar_pairs(other, r, match, crowd=5)) == pairs(similar_pairs(other, r, match))


def test_refining_spares_most_candidates(spark):
    rng = random.Random(6)
    d = ["T" * 9 + "".join(rng.choice("ACGT") for _ in range(27)) for _ in range(1500)] + ["".join(rng.choice("ACGT") for _ in range(36)) for _ in range(6000)]
    codes = simjoin.coded(records(spark, d))
    parts, counts = [0, 1, 2, 3], []
    for crowd in (10_000, 500):
        crowded = simjoin.crowded_keys(codes, codes, parts, crowd)
        probe = simjoin.refined(simjoin.probes(codes, parts), "a", crowded, 3)
        index = simjoin.refined(simjoin.entries(codes, "infix", parts), "b", crowded, 3)
        counts.append(simjoin.meeting(probe, index).count())
    assert counts[0] > 1500**2 and counts[1] < 0.01 * len(d) ** 2 and counts[1] < counts[0] / 10


@pytest.mark.parametrize("crowd", [2000, 3])
def test_index_of_versions_finds_what_a_join_does(spark, tmp_path, crowd):
    d = family(8, 40, "GGGGGGGGG") + family(9, 40)
    cut = [d[:50], d[40:90], [*d[90:], None, "acgt", d[0]]]
    index = NeighborIndex(spark, f"{tmp_path}/index", buckets=8, crowd=crowd)
    assert [index.append(records(spark, x)) for x in cut] == [1, 2, 3]
    every, new = records(spark, d), records(spark, family(8, 40, "GGGGGGGGG")[:60] + family(10, 5))
    for match in ("global", "infix"):
        assert pairs(similar_pairs(every, index, match)) == pairs(similar_pairs(every, every, match))
        assert pairs(similar_pairs(new, index, match, "compat")) == pairs(similar_pairs(new, every, match, "compat"))
    again = NeighborIndex(spark, f"{tmp_path}/index")
    assert again.buckets == 8 and len(again.versions) == 3
    assert pairs(similar_pairs(new, again)) == pairs(similar_pairs(new, every))
    first = simjoin.measured(again.met(simjoin.coded(every), "global", version=1), "global", "complete", 3)
    assert {b for _, b in pairs(first)} <= set(cut[0])


def test_index_is_joined_without_an_exchange(spark, tmp_path):
    index = NeighborIndex(spark, f"{tmp_path}/index", buckets=4)
    index.append(records(spark, family(11, 30)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = index.met(simjoin.coded(records(spark, family(12, 30))), "infix")
        plan = met._jdf.queryExecution().executedPlan().toString()
        met.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = plan[plan.index("Join") :]
    sides = join.split("Exchange hashpartitioning")
    assert len(sides) == 2 and "strandloom_index" in plan  # the probes' alone


def test_what_a_failed_append_left_is_not_read(spark, tmp_path):
    index = NeighborIndex(spark, f"{tmp_path}/index", buckets=4)
    d = family(13, 10)
    index.append(records(spark, d[:10]))
    held = index.entries().count()
    rows = index.entries().limit(5).withColumn("batch", F.lit("none"))
    rows.write.mode("append").insertInto(index.table)
    again = NeighborIndex(spark, f"{tmp_path}/index")
    assert again.entries().count() == held


def test_rounds_decide_as_all_pairs_do(spark):
    d = family(14, 30)
    d += d[:5]
    ids = [f"r{i % 70}" for i in range(len(d))]
    r = records(spark, d, ids)
    of = {}
    for i, b in zip(ids, d, strict=True):
        of.setdefault(b, set()).add(i)
    near = pairs(similar_pairs(r, r, "infix"))
    want = {b: any(x != next(iter(of[b])) for a, o in near if a == b for x in of[o]) for b in of if d.count(b) == 1}
    got = {x.barcode: x.is_inherited for x in lineage.new_or_inherited(r).collect()}
    assert got == want and set(want.values()) == {True, False}


def test_components_of_parts_are_merged(spark):
    d = family(15, 30)
    r = records(spark, d)
    e = graph.edges(r).cache()
    whole = {tuple(x) for x in graph.components(graph.vertices(r), e).collect()}
    nodes = graph.vertices(r)
    made = []
    for i in range(7):
        mine = e.filter(F.pmod(F.xxhash64("src", "dst"), F.lit(7)) == i)
        here = nodes.filter(F.pmod(F.xxhash64("barcode"), F.lit(7)) == i).select("barcode")
        ends = mine.select(F.explode(F.array("src", "dst")).alias("barcode")).unionByName(here).distinct()
        made.append(graph.components(ends, mine))
    assert {tuple(x) for x in graph.merged_components(*made).collect()} == whole


def test_graph_commands_and_index_command(spark, tmp_path, capsys):
    r = records(spark, family(16, 20))
    r.write.parquet(f"{tmp_path}/b")
    for i in range(3):
        cli.main(["graph-part", f"{tmp_path}/b", f"{tmp_path}/p{i}", "--part", str(i), "--of", "3"])
    cli.main(["graph-union", f"{tmp_path}/all", *[f"{tmp_path}/p{i}" for i in range(3)]])
    cli.main(["components", f"{tmp_path}/b", f"{tmp_path}/once"])
    read = lambda x, y: {tuple(z) for z in spark.read.parquet(f"{tmp_path}/{x}/{y}").collect()}
    for table in ("members", "edges", "stats"):
        assert read("all", table) == read("once", table)
    cli.main(["index", f"{tmp_path}/b", f"{tmp_path}/index"])
    cli.main(["cross", f"{tmp_path}/b", f"{tmp_path}/b", f"{tmp_path}/x1", "--index", f"{tmp_path}/index"])
    cli.main(["cross", f"{tmp_path}/b", f"{tmp_path}/b", f"{tmp_path}/x2"])
    assert read("x1", "") == read("x2", "")


def test_registered_queries_agree(spark):
    sf = "/root/testdata/sf0.001"
    got = [sorted(map(tuple, catalog.QUERIES[q](spark, sf).collect())) for q in ("cross_sample_new", "cross_sample_indexed")]
    assert got[0] == got[1] and got[0]
    got = [sorted(map(tuple, catalog.QUERIES[q](spark, sf).collect())) for q in ("neighbor_pairs_complete", "indexed_pairs_of_versions")]
    assert got[0] == got[1] and got[0]
