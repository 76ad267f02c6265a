"""Column helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six white-space characters that every contract names: x20 and x09 to x0D.
SPACES = " \t\n\x0b\x0c\r"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_of(c: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(c, F.lit(""))


def key128(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes; never null, also where a column is."""
    return F.xxhash64(F.lit(11), *cols), F.xxhash64(F.lit(29), *cols)


def free_name(name: str, taken: list[str]) -> str:
    """name, with as many underscores after it as it takes to be none of the names taken."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: list[str | None], chars: int) -> Iterator[tuple[int, int]]:
    """Runs (first, end) of texts that hold some `chars` characters each; a longer text is taken alone."""
    first = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
