"""Command lines for the stages: python -m strandloom.cli STAGE ... ; tables in between are Parquet.

`run` chains them by mode over one folder, in which each sample's tables have the sample's name before their own:
locate, barcodes, dictionary, bodies, graph, histogram, new, cross, or all.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import sequence
from strandloom.operators import chunk, graph, lineage, merge, neighbors, sine
from strandloom.operators.index import NeighborIndex
from strandloom.operators.simjoin import similar_pairs
from strandloom.session import ship
from strandloom.sources import fastx


def indexed(spark: SparkSession, path: str, kind: str = "auto") -> DataFrame:
    """A file's records with their place in it."""
    return chunk.with_record_index(fastx.read(spark, path, kind), "file_order", "position")


def split(spark, a) -> None:
    """Chunks of 10^power lines, one file each: {output}.part{i}e{power}.fastq.gz; or of so many records, a folder each."""
    records = a.records or 10**a.power // (4 if a.format == "fastq" else 2)
    parts = chunk.chunked(indexed(spark, a.input), records, tuple(a.skip))
    if a.records:
        fastx.write(parts, a.output, a.format, by="part")
    else:
        fastx.write_chunks(parts, a.output, a.power, a.format, a.level).orderBy("part").show(1000, False)


def fake_quality(spark, a) -> None:
    """A FASTA file as FASTQ, every quality phred 30."""
    r = fastx.read(spark, a.input, "fasta", wrapped="true")
    fastx.write(r.withColumn("qual", sequence.fake_quality(F.col("seq"))), a.output, "fastq", compression=a.compression)


def dictionary(spark, a) -> None:
    neighbors.dictionary(spark.read.parquet(a.barcodes), complete=True, keep=a.keep).write.parquet(a.output)


def bodies(spark, a) -> None:
    """Adds the bodies of located elements to a text folder, and a random sample of them to another."""
    found = sine.bodies(spark.read.parquet(a.located))
    fastx.append_lines(found, "sine", a.output)
    fastx.append_lines(sine.sample(found, a.sample), "sine", f"{a.output}-random")


def merge_mates(spark, a) -> None:
    r1, r2 = (indexed(spark, p, "fastq") for p in (a.r1, a.r2))
    fastx.write(merge.merge_pairs(merge.pair_up(r1, r2, a.same_id)), a.output, "fastq")


def candidates(spark, a) -> None:
    e = fastx.reference(spark, a.element)
    found = sine.candidates(fastx.read(spark, a.input), e, a.head, a.errors, a.direction)
    fastx.write(found, a.output, "fastq")


def barcodes(spark, a) -> None:
    e = fastx.reference(spark, a.element)
    found = sine.locate(indexed(spark, a.input), e, a.head, a.errors)
    sine.barcodes(found, a.length).select("record_index", "id", "barcode", "sine_start", "sine_end").write.parquet(a.output)


def histogram(spark, a) -> None:
    counts = neighbors.neighbor_counts(spark.read.parquet(a.barcodes), recall=a.recall)
    neighbors.as_line(neighbors.dense_histogram(counts, a.length)).write.text(a.output)


def read_histogram(spark, path: str) -> DataFrame:
    line = F.split(F.element_at(F.split(F.col("value"), "\n"), 1), ",").cast("array<long>")
    return spark.read.text(path).limit(1).select(F.posexplode(line).alias("bucket", "barcodes"))


def report(spark, a) -> None:
    neighbors.percentages(read_histogram(spark, a.input)).show(1000, False)


def patch(spark, a) -> None:
    """A sample's histogram with bucket 1 replaced by how many of its new records another sample doesn't match."""
    n = spark.read.parquet(a.crossed).agg(F.count_if("unmatched")).first()[0]
    neighbors.as_line(neighbors.patched(read_histogram(spark, a.histogram), 1, n)).write.text(a.output)


def new(spark, a) -> None:
    lineage.new_or_inherited(spark.read.parquet(a.barcodes)).write.partitionBy("is_inherited").parquet(a.output)


def cross(spark, a) -> None:
    """With --index the other sample's stored index is used, and its barcodes aren't indexed again."""
    found = NeighborIndex(spark, a.index) if a.index else None
    lineage.cross_sample(spark.read.parquet(a.new), spark.read.parquet(a.other), index=found).write.parquet(a.output)


def index(spark, a) -> None:
    """Add a sample's barcodes to a stored index, as a new version."""
    print(NeighborIndex(spark, a.output).append(spark.read.parquet(a.barcodes)))


def graph_part(spark, a) -> None:
    """Edges of one part of the barcodes with all of them, and the components they make."""
    b = spark.read.parquet(a.barcodes)
    mine = b.filter(F.pmod(F.xxhash64("barcode"), F.lit(a.of)) == a.part)
    pairs = similar_pairs(mine, b, "infix").filter("a <> b")
    pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct().write.parquet(f"{a.output}/edges")
    e = spark.read.parquet(f"{a.output}/edges")
    ends = e.select(F.explode(F.array("src", "dst")).alias("barcode")).unionByName(mine.select("barcode"))
    graph.components(ends.filter("barcode is not null").distinct(), e).write.parquet(f"{a.output}/members")


def graph_union(spark, a) -> None:
    """The components and statistics of the parts' graphs together."""
    members = graph.merged_components(*[spark.read.parquet(f"{p}/members") for p in a.parts])
    members.write.parquet(f"{a.output}/members")
    graph.union(*[spark.read.parquet(f"{p}/edges") for p in a.parts]).write.parquet(f"{a.output}/edges")
    members, e = (spark.read.parquet(f"{a.output}/{x}") for x in ("members", "edges"))
    graph.component_stats(members, e).write.parquet(f"{a.output}/stats")


def components(spark, a) -> None:
    b = spark.read.parquet(a.barcodes)
    e = graph.edges(b)
    e.write.parquet(f"{a.output}/edges")
    e = spark.read.parquet(f"{a.output}/edges")
    graph.components(graph.vertices(b), e).write.parquet(f"{a.output}/members")
    graph.component_stats(spark.read.parquet(f"{a.output}/members"), e).write.parquet(f"{a.output}/stats")


def centers(spark, a) -> None:
    lines = spark.read.text(a.centers).select(F.trim("value").alias("center"))
    found = sine.consensus_distances(lines, fastx.reference(spark, a.element))
    sine.distance_histogram(found).show(1000, False)
    sine.mean_distance(found).show(1, False)


def run(spark, a) -> None:
    """The stages of a mode, one after the other, over the tables {output}/{sample}-{table}; --other names the other sample."""
    at = lambda table, sample=a.sample: f"{a.output}/{sample}-{table}"

    def locate() -> None:
        found = sine.locate(indexed(spark, a.input), fastx.reference(spark, a.element), a.head, a.errors)
        found.select("record_index", "id", "seq", "sine_start", "sine_end", "cost").write.parquet(at("located"))

    def cut_barcodes() -> None:
        sine.barcodes(spark.read.parquet(at("located")), a.length).select(
            "record_index", "id", "barcode", "sine_start", "sine_end"
        ).write.parquet(at("barcodes"))

    def call(f, **options) -> None:
        f(spark, argparse.Namespace(**options))

    def crossed() -> None:
        fresh = spark.read.parquet(at("new")).filter("not is_inherited")
        lineage.cross_sample(fresh, spark.read.parquet(at("barcodes", a.other))).write.parquet(at("crossed"))
        counts = spark.read.parquet(at("crossed")).withColumnRenamed("matches", "neighbors")
        neighbors.as_line(neighbors.dense_histogram(counts, a.buckets)).write.text(at("crossed-histogram"))
        call(patch, histogram=at("histogram"), crossed=at("crossed"), output=at("filtered-histogram"))

    steps = {
        "locate": locate,
        "barcodes": cut_barcodes,
        "dictionary": lambda: call(dictionary, barcodes=at("barcodes"), output=at("dictionary"), keep="all"),
        "bodies": lambda: call(bodies, located=at("located"), output=at("bodies"), sample=10_000),
        "graph": lambda: call(components, barcodes=at("barcodes"), output=at("graph")),
        "histogram": lambda: call(histogram, barcodes=at("barcodes"), output=at("histogram"), length=a.buckets, recall=a.recall),
        "new": lambda: call(new, barcodes=at("barcodes"), output=at("new")),
        "cross": crossed,
    }
    chain = ["locate", "barcodes", "histogram", "new"] if a.mode == "all" else [a.mode]
    for name in chain:
        steps[name]()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandloom")
    stages = top.add_subparsers(required=True)

    def stage(f, *places: str, **options) -> None:
        p = stages.add_parser(f.__name__.replace("_", "-"))
        for name in places:
            p.add_argument(name)
        for name, default in options.items():
            kind = type(default) if default is not None else int
            if default == "+":
                p.add_argument(name, nargs="+")
            elif isinstance(default, bool):
                p.add_argument(f"--{name.replace('_', '-')}", action="store_true")
            elif isinstance(default, list):
                p.add_argument(f"--{name}", nargs="*", type=int, default=default)
            else:
                p.add_argument(f"--{name}", type=kind, default=default)
        p.set_defaults(run=f)

    stage(split, "input", "output", power=8, records=0, format="fastq", skip=[], level=2)
    stage(fake_quality, "input", "output", compression="gzip")
    stage(dictionary, "barcodes", "output", keep="all")
    stage(bodies, "located", "output", sample=10_000)
    stage(patch, "histogram", "crossed", "output")
    stage(run, "mode", "input", "element", "output", sample="sample", other="", head=sine.HEAD, errors=sine.PRECISE,
          length=sine.BARCODE, buckets=50, recall="complete")
    stage(merge_mates, "r1", "r2", "output", same_id=False)
    stage(candidates, "input", "element", "output", head=sine.HEAD, errors=sine.COARSE, direction="forward")
    stage(barcodes, "input", "element", "output", head=sine.HEAD, errors=sine.PRECISE, length=sine.BARCODE)
    stage(histogram, "barcodes", "output", length=50, recall="complete")
    stage(report, "input")
    stage(new, "barcodes", "output")
    stage(cross, "new", "other", "output", index="")
    stage(index, "barcodes", "output")
    stage(components, "barcodes", "output")
    stage(graph_part, "barcodes", "output", part=0, of=1)
    stage(graph_union, "output", parts="+")
    stage(centers, "centers", "element")
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    a.run(spark, a)


if __name__ == "__main__":
    main()
