import bz2
import gzip
import random
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

from strandloom.operators import merge
from strandloom.sources import blocks, fastx
from strandloom.streaming import mates

SUFFIXES = {"": lambda c: b"".join(c), ".gz": lambda c: b"".join(map(gzip.compress, c)), ".bz2": lambda c: bz2.compress(b"".join(c), 1),
            ".many.bz2": lambda c: b"".join(map(bz2.compress, c)), ".zst": lambda c: b"".join(zstandard.ZstdCompressor().compress(x) for x in c),
            ".one.gz": lambda c: gzip.compress(b"".join(c))}


def text_of(kind, n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        s = "".join(rng.choices("ACGT", k=rng.randint(1, 160)))
        qual = "".join(rng.choices("@+I>", k=len(s)))  # as like other lines as can be
        out.append(f"@r{i} x\n{s}\n+\n{qual}\n" if kind == "fastq" else f">r{i} x\n{s[:60]}\n{s[60:] or 'A'}\n")
    return "".join(out).encode()


def cut_up(data, seed):
    rng, at, out = random.Random(seed), 0, []
    while at < len(data):
        n = rng.choice([1, 40, 900, 9000])
        out.append(data[at : at + n])
        at += n
    return out


@pytest.mark.parametrize("suffix", SUFFIXES)
@pytest.mark.parametrize("kind", ["fastq", "fasta"])
def test_no_record_is_lost_or_repeated_at_any_cut(tmp_path, kind, suffix, monkeypatch):
    monkeypatch.setattr(blocks, "READ", 3000)
    data = SUFFIXES[suffix](cut_up(text_of(kind, 2500, 1), 2))
    path = tmp_path / f"x.{kind}{suffix}"
    path.write_bytes(data)
    found, tasks = [], 0
    for step in (1 << 30, len(data) // 2 + 1, len(data) // 9, 1777):
        options = {"path": str(path), "format": "fasta" if kind == "fasta" else "auto", "wrapped": str(kind == "fasta"), "rangeBytes": step}
        reader = fastx.FastxReader(options, ["position", "id", "seq", "qual"])
        by_task = [[r for b in reader.read(p) for r in b.to_pylist()] for p in reader.partitions()]
        found.append([r for rows in by_task for r in rows])
        tasks = sum(map(bool, by_task))
    assert len(found[0]) == 2500 and all(f == found[0] for f in found)
    places = [r["position"] for r in found[0]]
    assert places == sorted(set(places)) and (tasks > 1) == (suffix != ".one.gz")


def test_marks_by_chance_are_passed_over(tmp_path):
    """Compressed data that holds every mark as text."""
    marks = blocks.GZIP + blocks.ZSTD + blocks.BLOCK.to_bytes(6, "big") + blocks.STREAM_END.to_bytes(6, "big")
    stored = [gzip.compress(marks * 50, 0), gzip.compress(b"end")]
    path = tmp_path / "x.gz"
    path.write_bytes(b"".join(stored))
    with path.open("rb") as f:
        got = [(p, b"".join(c)) for p, c in blocks.entries(f, ".gz", 1, 1 << 40)]
    assert got == [(len(stored[0]), b"end")]
    with path.open("rb") as f:
        assert list(blocks.entries(f, ".gz", 1, 20)) == []


def test_compressed_ranges_in_spark(spark, tmp_path):
    data = text_of("fastq", 3000, 5)
    for i, suffix in enumerate((".gz", ".bz2", ".zst")):
        (tmp_path / f"s{i}.fastq{suffix}").write_bytes(SUFFIXES[suffix](cut_up(data, i)))
    rows = fastx.read(spark, str(tmp_path), "fastq", rangeBytes="20000")
    assert rows.rdd.getNumPartitions() > 12
    assert [r["count"] for r in rows.groupBy("file").count().collect()] == [3000] * 3
    order = [r.id for r in rows.filter("file_order = 1").orderBy("position").collect()]
    assert order == [f"r{i}" for i in range(3000)]


def test_only_asked_columns_and_files_are_read(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"s{i}.fastq").write_bytes(text_of("fastq", 50, i))
    assert fastx.read(spark, str(tmp_path), columns=("seq", "file")).columns == ["seq", "file"]
    reader = fastx.FastxReader({"path": str(tmp_path)}, ["seq"])
    assert [b.schema.names for b in reader.read(reader.partitions()[0])] == [["seq"]]
    reader = fastx.FilteringReader({"path": str(tmp_path)}, ["seq"])
    wanted = fastx.EqualTo(("file",), f"{tmp_path}/s1.fastq")
    assert list(reader.pushFilters([wanted])) == [wanted] and [p.file for p in reader.partitions()] == [f"{tmp_path}/s1.fastq"]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = fastx.read(spark, str(tmp_path)).filter(F.col("file") == f"{tmp_path}/s2.fastq")
        assert some.count() == 50 and some.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def reads_frame(spark, n, first=0):
    rows = [(f"r{i}", "ACGT"[i % 4] * (i % 50 + 1), None if i % 3 else "I" * (i % 50 + 1)) for i in range(first, first + n)]
    return spark.createDataFrame(rows, "id string, seq string, qual string")


@pytest.mark.parametrize("codec", ["gz", "bz2", "zst", "none"])
def test_written_files_are_read_back(spark, tmp_path, codec):
    path = fastx.write_files(reads_frame(spark, 500), f"{tmp_path}/out", "fastq", codec)
    got = {(r.id, r.seq, r.qual) for r in fastx.read(spark, path, rangeBytes="500").collect()}
    assert got == {(r.id, r.seq, r.qual or "#" * len(r.seq)) for r in reads_frame(spark, 500).collect()}
    fastx.write_files(reads_frame(spark, 20, 1000), path, "fastq", codec)
    assert fastx.read(spark, path).count() == 520
    fastx.write_files(reads_frame(spark, 7), path, "fasta", codec, mode="overwrite")
    assert fastx.read(spark, path).count() == 7


def test_an_aborted_job_and_a_doubled_task_leave_no_file(spark, tmp_path):
    path = f"{tmp_path}/out"
    fastx.write_files(reads_frame(spark, 10), path)
    before = sorted(str(p) for p in Path(path).rglob("*"))
    wrong = reads_frame(spark, 400).repartition(4).withColumn("seq", F.when(F.col("id") == "r399", F.lit(None)).otherwise(F.col("seq")))
    with pytest.raises(Exception, match="no sequence"):
        fastx.write_files(wrong, path)
    assert sorted(str(p) for p in Path(path).rglob("*")) == before
    # a copy of a task whose message isn't among those committed
    writer = fastx.FastxWriter({"path": path, "format": "fastq"}, reads_frame(spark, 1).schema, False)
    hidden = Path(path, f"_write-{writer.job}")
    hidden.mkdir()
    for name in ("0-1.fastq.gz", "0-2.fastq.gz"):
        (hidden / name).write_bytes(gzip.compress(b"@x\nA\n+\nI\n"))
    assert fastx.read(spark, path).count() == 10  # hidden until then
    writer.commit([fastx.Written(str(hidden / "0-2.fastq.gz"), 0, 1), fastx.Written(None, 1, 0)])
    assert fastx.read(spark, path).count() == 11 and not hidden.exists()


def run_stream(df, out, checkpoint):
    query = (
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def test_stream_of_files_goes_on_where_it_was(spark, tmp_path):
    """Each file is read once over restarts, also where a batch was planned and not finished."""
    folder, log, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "log", "out", "checkpoint"))
    Path(folder).mkdir()
    stream = lambda: fastx.read_stream(spark, folder, log, "fastq", maxFilesPerTrigger="2", rangeBytes="3000").select("id", "file")
    for i in range(3):
        Path(folder, f"a{i}.fastq.gz").write_bytes(gzip.compress(text_of("fastq", 100, i)))
    run_stream(stream(), out, checkpoint)
    run_stream(stream(), out, checkpoint)
    Path(folder, "b.fastq").write_bytes(text_of("fastq", 100, 9))
    reader = fastx.FastxStreamReader({"path": folder, "log": log, "format": "fastq"}, ["id"])
    assert reader.latestOffset() == reader.latestOffset()  # planned: in the log, in no checkpoint
    run_stream(stream(), out, checkpoint)
    Path(folder, "c.fastq").write_bytes(text_of("fastq", 100, 10))
    for _ in range(3):
        run_stream(stream(), out, checkpoint)
    got = spark.read.parquet(out)
    assert got.count() == 500 and got.select("id", "file").distinct().count() == 500
    with pytest.raises(Exception, match="option log"):
        fastx.FastxStreamReader({"path": folder}, ["id"])


def test_mates_are_merged_while_they_stream(spark, tmp_path):
    """What comes out of streams in which mates come in any order is what a batch gives, and then no state is left."""
    rng = random.Random(3)
    back = str.maketrans("ACGT", "TGCA")
    whole = ["".join(rng.choices("ACGT", k=240)) for _ in range(60)]
    one = [(f"r{i}", w[:150]) for i, w in enumerate(whole)] + [("twice", whole[0][:150]), ("twice", whole[1][:150])]
    other = [(f"r{i}", w[90:][::-1].translate(back)) for i, w in enumerate(whole)] + [("twice", whole[0][90:][::-1].translate(back))]
    rng.shuffle(other)
    last = [("twice", whole[1][90:][::-1].translate(back))]
    batches = [(one[:30], []), ([], other[:40]), (one[30:], other[40:]), ([], last)]
    schema = "id string, seq string"
    streams = lambda: [spark.readStream.schema(schema).parquet(f"{tmp_path}/r{k}") for k in (1, 2)]
    states = []
    for r1, r2 in batches:
        for k, rows in ((1, r1), (2, r2)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/r{k}")
        query = run_stream(mates.merge_stream(*streams(), groups=5), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else None)
    got = sorted((r.id, r.seq, r.merged) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    numbered = lambda rows: spark.createDataFrame([(i, *r) for i, r in enumerate(sorted(rows, key=lambda r: r[0]))], f"record_index long, {schema}")
    second = sorted(other + last, key=lambda r: r[0])
    batch = merge.merge_pairs(merge.pair_up(numbered(one), numbered(second), same_id=True))
    assert got == sorted((r.id, r.seq, r.merged) for r in batch.collect()) and len(got) == 62
    assert states[0] > 0 and states[-1] == 0
