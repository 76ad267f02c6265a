import random

from pyspark.sql import functions as F

from strandloom.functions.fuzzy import fuzzy_contains, fuzzy_find, register, search


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(pattern, text, most):
    found = [
        (edits(pattern, text[i:j]), i, -j) for i in range(len(text) + 1) for j in range(i, min(len(text), i + len(pattern) + most) + 1)
    ]
    cost, start, end = min(found)
    return (start, -end, cost) if cost <= most else (-1, -1, -1)


def test_search_is_least_cost_then_leftmost_then_longest():
    random.seed(3)
    rows = []
    for _ in range(400):
        p = "".join(random.choice("ACG") for _ in range(random.choice([3, 5, 6])))
        t = "".join(random.choice("ACG") for _ in range(random.randint(0, 14)))
        rows.append((p, t, random.randint(0, 2)))
    got = search([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])
    for r, g in zip(rows, got.tolist(), strict=True):
        assert tuple(g) == brute(*r), r


def test_a_later_cheaper_match_wins_over_an_earlier_one():
    assert search(["ACGTACGT"], ["ACGAACTTTTACGTACGT"], [3]).tolist() == [[10, 18, 0]]


def test_columns_with_nulls(spark):
    df = spark.createDataFrame([("xxACGTyy", "ACGT"), (None, "ACGT"), ("zzz", "ACGT"), ("", "ACGT")], ["t", "p"])
    got = [r.m for r in df.select(fuzzy_find(F.col("t"), F.col("p"), 1).alias("m")).collect()]
    assert (got[0].start, got[0].end, got[0].cost) == (2, 6, 0)
    assert all(m.cost is None for m in got[1:])
    assert [r.c for r in df.select(fuzzy_contains(F.col("t"), "ACGT", 1).alias("c")).collect()] == [True, False, False, False]


def test_sql(spark):
    register(spark)
    assert spark.sql("select fuzzy_find('xxACGT', 'ACGT', 1).start as s").first().s == 2
