"""Repeat elements in reads: candidates, where they lie, the barcode before them, and reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.fuzzy import fuzzy_find
from strandloom.functions.sequence import BARCODE, cut, revcomp

#: How many bases of an element are searched, and the errors of the coarse and the precise search.
HEAD, COARSE, PRECISE = 67, 19, 14


def candidates(reads: DataFrame, element: str, head: int = HEAD, most: int = COARSE, direction: str = "forward") -> DataFrame:
    """Reads in which the element's head occurs; with direction "rc", in whose reverse complement. Reads stay as they are."""
    if direction not in ("forward", "rc"):
        raise ValueError(f"direction must be forward or rc, not {direction}")
    seq = F.col("seq") if direction == "forward" else revcomp(F.col("seq"))
    found = reads.withColumn("__m", fuzzy_find(seq, element[:head], most))
    return found.filter("__m.cost is not null").drop("__m")


def locate(reads: DataFrame, element: str, head: int = HEAD, most: int = PRECISE, strand: str = "forward") -> DataFrame:
    """Reads that hold the element's head, with sine_start, sine_end and cost."""
    seq = F.col("seq") if strand == "forward" else revcomp(F.col("seq"))
    found = reads.withColumn("__m", fuzzy_find(seq, element[:head], most)).filter("__m.cost is not null")
    return found.select(
        *reads.columns, F.col("__m.start").alias("sine_start"), F.col("__m.end").alias("sine_end"), F.col("__m.cost").alias("cost")
    )


def locate_both(reads: DataFrame, element: str, head: int = HEAD, most: int = PRECISE) -> DataFrame:
    """locate() on both strands in one pass: a row, with column strand, for each strand that holds the head. Without seq."""
    strands = F.array(
        F.struct(F.lit("forward").alias("strand"), F.col("seq").alias("s")), F.struct(F.lit("rc").alias("strand"), revcomp(F.col("seq")).alias("s"))
    )
    long = reads.filter(F.char_length("seq") >= len(element[:head]) - most)  # shorter ones can't hold it
    asked = long.select(*[c for c in reads.columns if c != "seq"], F.explode(strands).alias("__t"))
    found = asked.withColumn("__m", fuzzy_find(F.col("__t.s"), element[:head], most)).filter("__m.cost is not null")
    return found.select(
        *[c for c in reads.columns if c != "seq"], F.col("__m.start").alias("sine_start"), F.col("__m.end").alias("sine_end"),
        F.col("__m.cost").alias("cost"), "__t.strand",
    )


def locate_each(reads: DataFrame, elements: dict[str, str], head: int = HEAD, most: int = PRECISE) -> DataFrame:
    """locate() for several elements, given by name, in one pass: a row for each element that a read holds."""
    given = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v[:head]).alias("head")) for k, v in elements.items()])
    asked = reads.withColumn("__e", F.explode(given))
    found = asked.withColumn("__m", fuzzy_find(F.col("seq"), F.col("__e.head"), most)).filter("__m.cost is not null")
    return found.select(
        *reads.columns, F.col("__e.name").alias("element"), F.col("__m.start").alias("sine_start"),
        F.col("__m.end").alias("sine_end"), F.col("__m.cost").alias("cost"),
    )


def barcodes(located: DataFrame, size: int = BARCODE) -> DataFrame:
    """The bases before each element; reads that have too few before it go."""
    start = F.col("sine_start")
    return located.filter(start >= size).withColumn("barcode", cut(F.col("seq"), start - size, start))


def bodies(located: DataFrame) -> DataFrame:
    return located.withColumn("sine", cut(F.col("seq"), F.col("sine_start"), F.col("sine_end")))


def sample(rows: DataFrame, n: int = 10_000, key: Column | None = None) -> DataFrame:
    """n rows at random: those of least hash of key, so that the same rows come every time."""
    key = F.md5(F.col("id").cast("string")) if key is None else key
    return rows.orderBy(key, "id").limit(n)


def consensus_distances(centers: DataFrame, element: str, head: int = HEAD, most: int = COARSE) -> DataFrame:
    """Centres with where the element's head lies in them, and two distances to it.

    compat_distance compares the centre with the stretch of the *element* at those places; distance the stretch of the
    centre with the element's head. Centres without the head have neither.
    """
    m = F.col("__m")
    found = centers.withColumn("__m", fuzzy_find(F.col("center"), element[:head], most)).filter("__m.cost is not null")
    return found.select(
        *centers.columns,
        F.levenshtein(cut(F.lit(element), m["start"], m["end"]), cut(F.col("center"), m["start"], m["end"])).alias("compat_distance"),
        F.levenshtein(F.lit(element[:head]), cut(F.col("center"), m["start"], m["end"])).alias("distance"),
    )


def mean_distance(distances: DataFrame, column: str = "distance") -> DataFrame:
    """One row: (centers, mean), over the centres that have a distance."""
    return distances.agg(F.count(column).alias("centers"), F.avg(column).alias("mean"))


def distance_histogram(distances: DataFrame, column: str = "distance") -> DataFrame:
    """(distance, centers) in order."""
    return distances.groupBy(F.col(column).alias("distance")).agg(F.count("*").alias("centers")).orderBy("distance")
