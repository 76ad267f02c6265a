from pyspark.sql import functions as F

from strandloom.functions import sequence as s


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], [*values])
    return row.select(column.alias("x")).first().x


def test_revcomp_knows_ambiguity_codes_and_case(spark):
    assert one(spark, s.revcomp(F.col("q")), q="AACGTN") == "NACGTT"
    assert one(spark, s.revcomp(F.col("q")), q="RYKMBVDHSWacg") == "cgtWSDHBVKMRY"


def test_cuts_beyond_the_ends(spark):
    assert one(spark, s.suffix(F.col("q"), 20), q="ACG") == "ACG"
    assert one(spark, s.but_suffix(F.col("q"), 20), q="ACG") == ""
    assert one(spark, s.but_suffix(F.col("q"), 1), q="ACG") == "AC"
    assert one(spark, s.cut(F.col("q"), 1, 3), q="ACGT") == "CG"


def test_parts_and_windows(spark):
    b = "A" * 9 + "C" * 9 + "G" * 9 + "T" * 9
    assert [p.kmer[0] for p in one(spark, s.parts(F.col("q")), q=b)] == list("ACGT")
    assert [p.place for p in one(spark, s.parts(F.col("q"), complete=False), q=b)] == [0, 9, 18]
    assert len(one(spark, s.windows(F.col("q")), q=b)) == 28
    assert len(one(spark, s.windows(F.col("q"), complete=False), q=b)) == 27
    poly = "ACGTACGTACGTACGTACGTACGT" + "T" * 12
    assert one(spark, s.windows(F.col("q"), complete=False), q=poly).count("T" * 9) == 1
    assert one(spark, s.windows(F.col("q")), q="ACG") == []


def test_dna(spark):
    assert one(spark, s.dna(F.col("q")), q="Abc d!é") == "ACGT"
