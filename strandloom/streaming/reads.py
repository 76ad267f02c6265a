"""The row-local stages over a stream of reads, which need no state; fastx.read_stream() reads files, mates merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strandloom.operators import sine


def read_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    return spark.readStream.format(kind).schema(schema).load(path)


def barcode_stream(stream: DataFrame, element: str, most: int = sine.PRECISE) -> DataFrame:
    """Reads (id, seq, ...) as they come, located and cut; the same functions as over a table."""
    return sine.barcodes(sine.locate(stream, element, most=most))


def write_stream(stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet") -> StreamingQuery:
    """Append to files, exactly once; takes what is there and stops."""
    return (
        stream.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
