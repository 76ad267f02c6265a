"""FASTA and FASTQ files as a data source, and the sinks that write them.

Files may be plain, .gz, .bz2 or .zst. They are cut in byte ranges, each read by one task from its first whole record on.
Compressed ones are entered where one of their gzip members, bzip2 blocks or Zstandard frames begins; a file that is one member or
frame has no such place but its start, and is read by one task. Paths are opened through
pyarrow's file systems, so a URI (s3://, hdfs://, file:) works as well as a local path.
"""

from __future__ import annotations

import bz2
import gzip
import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from strandloom.session import scratch_dir
from strandloom.sources.blocks import entries

SCHEMA = "file string, file_order long, position long, id string, description string, seq string, qual string"
CODECS = (".gz", ".bz2", ".zst")
RANGE_BYTES = 64 * 1024 * 1024
ROWS = 4096
#: Uncompressed bytes of a gzip member or Zstandard frame that is written.
MEMBER_BYTES = 4 * 1024 * 1024
#: A compressed line's place is its entry's, shifted by so many bits, and a number.
PLACE_BITS = 24


@dataclass
class Piece(InputPartition):
    file: str
    order: int
    start: int
    end: int


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    if re.match(r"^\w+:", path):
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), path


def natural(path: str) -> list[str | int]:
    """A sort key that takes digits as numbers: part=2 comes before part=10."""
    return [int(x) if i % 2 else x for i, x in enumerate(re.split(r"([0-9]+)", path))]


def base_and_suffix(path: str) -> tuple[str, str]:
    """A file's name without and with its known suffixes: ("x/a", ".fastq.gz")."""
    m = re.search(r"(\.(?:fasta|fastq|fa|fq|txt|pickle|parquet))?(\.(?:gz|bz2|zst))?$", path)
    return path[: m.start()], m[0]


def kind_of(first: bytes) -> str:
    kinds = {b">": "fasta", b"@": "fastq"}
    if first[:1] not in kinds:
        raise ValueError(f"neither FASTA nor FASTQ: begins with {first[:20]!r}")
    return kinds[first[:1]]


def fastq_start(lines: list[bytes]) -> bool:
    """Whether these four lines are a record; a quality that begins with @ doesn't fool it."""
    head, seq, plus, qual = (x.rstrip(b"\r\n") for x in lines)
    return head[:1] == b"@" and plus[:1] == b"+" and len(seq) == len(qual)


def fasta_records(lines: Iterator[tuple[int, bytes]], wrapped: bool) -> Iterator[tuple[int, str, str, None]]:
    """(position, header, seq, None); a header without its sequence line at the end is dropped."""
    at, header, seq = 0, None, []
    for place, line in lines:
        if line[:1] == b">":
            if header is not None and seq:
                yield at, header, "".join(seq), None
            at, header, seq = place, line[1:].decode().rstrip("\r\n"), []
        elif header is None:
            if line.strip():
                raise ValueError(f"expected '>' at {place}")
        elif not seq or wrapped:
            seq.append(line.decode().strip())
        elif line.strip():
            raise ValueError(f"a second sequence line at {place}; option wrapped reads such files")
    if header is not None and seq:
        yield at, header, "".join(seq), None


def fastq_records(lines: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, str, str, str]]:
    """(position, header, seq, qual); a partial record at the end is dropped."""
    record: list[str] = []
    at = 0
    for place, line in lines:
        if not record:
            at = place
        record.append(line.decode().rstrip("\r\n"))
        if len(record) == 4:
            head, seq, plus, qual = record
            if head[:1] != "@" or plus[:1] != "+" or len(seq) != len(qual):
                raise ValueError(f"no FASTQ record at {at}")
            yield at, head[1:], seq, qual
            record = []


def files_of(fs: pa.fs.FileSystem, path: str) -> list[pa.fs.FileInfo]:
    """The file at path, or those of the folder there but hidden ones, in natural order."""
    info = fs.get_file_info(path)
    if info.is_file:
        return [info]
    if info.type != pa.fs.FileType.Directory:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pa.fs.FileSelector(path, recursive=True))
    shown = [f for f in found if f.is_file and not re.search(r"/[_.]", f.path[len(path.rstrip("/")) :])]
    return sorted(shown, key=lambda f: natural(f.path))


class Lines:
    """What a task reads: (place, line, own) from its range's first whole line on; own until a line begins beyond the range.

    A line that begins exactly where a range, or the first entry in it, does belongs to the range before.
    """

    def __init__(self, path: str) -> None:
        self.fs, _ = file_system(path)

    def __call__(self, piece: Piece) -> Iterator[tuple[int, bytes, bool]]:
        suffix = base_and_suffix(piece.file)[1]
        codec = next((c for c in CODECS if suffix.endswith(c)), None)
        return self.compressed(piece, codec) if codec else self.plain(piece)

    def plain(self, piece: Piece) -> Iterator[tuple[int, bytes, bool]]:
        f = self.fs.open_input_file(piece.file)
        f.seek(max(0, piece.start - 1))
        buffered = io.BufferedReader(f)
        at = piece.start - 1 + len(buffered.readline()) if piece.start else 0  # to the next line's beginning
        for line in buffered:
            yield at, line, at < piece.end
            at += len(line)

    def compressed(self, piece: Piece, codec: str) -> Iterator[tuple[int, bytes, bool]]:
        """A line's place is that of its entry, shifted, and its number there: no entry has so many lines for each of its bytes."""
        f = self.fs.open_input_file(piece.file)
        held: list[bytes] = []  # of the line that isn't at its end
        place, own, crossed, skip = 0, True, False, piece.start > 0
        for entry, chunks in entries(f, codec, piece.start, piece.end):
            number = 0
            crossed = crossed or entry >= piece.end
            if not held:
                place = entry << PLACE_BITS
            for chunk in chunks:
                *whole, rest = chunk.split(b"\n")
                for line in whole:
                    if not skip:
                        yield place, b"".join([*held, line, b"\n"]), own
                    held, number, skip, own = [], number + 1, False, not crossed
                    place = (entry << PLACE_BITS) + number
                if rest:
                    held.append(rest)
        if held and not skip:
            yield place, b"".join(held), own


class FastxReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.path = options["path"]
        self.kind = options.get("format", "auto")
        self.wrapped = str(options.get("wrapped", "false")).lower() == "true"
        self.range = int(options.get("rangeBytes", RANGE_BYTES))
        self.columns = columns
        self.filters: list[Filter] = []

    def wanted(self, file: str, order: int) -> bool:
        values = {("file",): file, ("file_order",): order}
        return all(values[f.attribute] in (f.value if isinstance(f, In) else (f.value,)) for f in self.filters)

    def partitions(self) -> list[Piece]:
        fs, path = file_system(self.path)
        return [
            Piece(f.path, order, at, min(at + self.range, f.size))
            for order, f in enumerate(files_of(fs, path))
            if self.wanted(f.path, order)
            for at in range(0, f.size, self.range)
        ]

    def lines(self, piece: Piece) -> Iterator[tuple[int, bytes]]:
        """(place, line) from the first record that begins in the piece to the end of the last one that does."""
        source, kind = Lines(self.path), self.kind
        if kind == "auto":
            first = next(source(Piece(piece.file, piece.order, 0, 16)), None)  # a first entry begins within that
            if first is None:
                return
            kind = kind_of(first[1])
        rows = source(piece)
        ahead: list[tuple[int, bytes, bool]] = []
        if piece.start:  # find where a record begins
            size, begins = (4, fastq_start) if kind == "fastq" else (1, lambda few: few[0][:1] == b">")
            while True:
                while len(ahead) < size and (row := next(rows, None)):
                    ahead.append(row)
                if len(ahead) < size or not ahead[0][2]:
                    return
                if begins([line for _, line, _ in ahead]):
                    break
                ahead.pop(0)
        number = 0
        for place, line, own in chain(ahead, rows):
            if not own and (number % 4 == 0 if kind == "fastq" else line[:1] == b">"):
                return
            yield place, line
            number += 1

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        lines = self.lines(piece)
        first = next(lines, None)
        if first is None:
            return
        kind = self.kind if self.kind != "auto" else kind_of(first[1])
        records = chain([first], lines)
        records = fasta_records(records, self.wrapped) if kind == "fasta" else fastq_records(records)
        while rows := list(islice(records, ROWS)):
            made = {
                "file": lambda: [piece.file] * len(rows),
                "file_order": lambda: [piece.order] * len(rows),
                "position": lambda: [at for at, *_ in rows],
                "id": lambda: [(header.split() or [""])[0] for _, header, *_ in rows],
                "description": lambda: [header for _, header, *_ in rows],
                "seq": lambda: [seq for _, _, seq, _ in rows],
                "qual": lambda: [qual for *_, qual in rows],
            }  # only what is asked for is made
            kinds = {c: pa.int64() if c in ("file_order", "position") else pa.string() for c in self.columns}
            yield pa.RecordBatch.from_arrays([pa.array(made[c](), kinds[c]) for c in self.columns], self.columns)


class FilteringReader(FastxReader):
    """A reader that takes filters, which Spark allows only where spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Filters on the file spare files; Spark applies all of them again."""
        self.filters = [f for f in filters if isinstance(f, (EqualTo, In)) and f.attribute in (("file",), ("file_order",))]
        return iter(filters)


class FastxStreamReader(DataSourceStreamReader):
    """Files as they arrive in a folder, each read once.

    Which files belong to which batch is written to a log folder before a batch begins, and an offset is the number of the last
    batch. So a query that starts again from its checkpoint reads the same files for the same batch. Files must appear whole, as by a rename.
    """

    def __init__(self, options: dict, columns: list[str]) -> None:
        if "log" not in options:
            raise ValueError("a stream needs the option log, a folder for what it has seen")
        self.reader = FastxReader(options, columns)
        self.path, self.log = options["path"], options["log"]
        self.most = int(options.get("maxFilesPerTrigger", 1 << 30))
        self.batches: list[list[tuple[str, int]]] = []

    def catch_up(self) -> None:
        """Read the log from where it was read to last."""
        fs, log = file_system(self.log)
        while fs.get_file_info(name := f"{log}/{len(self.batches) + 1:012d}.json").is_file:
            with fs.open_input_stream(name) as f:
                self.batches.append([tuple(x) for x in json.loads(f.read())])

    def initialOffset(self) -> dict:  # noqa: N802
        return {"batch": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.catch_up()
        seen = {name for batch in self.batches for name, _ in batch}
        fs, path = file_system(self.path)
        there = files_of(fs, path) if fs.get_file_info(path).type != pa.fs.FileType.NotFound else []
        new = [(f.path, f.size) for f in there if f.path not in seen][: self.most]
        if new:
            fs, log = file_system(self.log)
            fs.create_dir(log, recursive=True)
            name = f"{log}/{len(self.batches) + 1:012d}.json"
            with fs.open_output_stream(f"{name}.tmp") as f:
                f.write(json.dumps(new).encode())
            fs.move(f"{name}.tmp", name)
            self.batches.append(new)
        return {"batch": len(self.batches)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.catch_up()
        order = sum(map(len, self.batches[: start["batch"]]))
        files = [f for batch in self.batches[start["batch"] : end["batch"]] for f in batch]
        step = self.reader.range
        return [
            Piece(name, order + i, at, min(at + step, size)) for i, (name, size) in enumerate(files) for at in range(0, size, step)
        ]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)


@dataclass
class Written(WriterCommitMessage):
    file: str | None  # of no name that readers see
    part: int
    records: int


class FastxWriter(DataSourceArrowWriter):
    """Record files that appear when the job is over, or never.

    Tasks write to a hidden folder of the job. Committing moves the files of those that count to their names and drops the folder,
    with whatever failed or doubled tasks have left in it; a job that aborts drops it as it is.
    """

    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.path, self.kind = options["path"], options.get("format", "fastq")
        self.codec = options.get("compression", "gz")
        if self.kind not in ("fasta", "fastq") or self.codec not in ("gz", "bz2", "zst", "none"):
            raise ValueError(f"unknown format or compression: {self.kind}, {self.codec}")
        self.columns, self.overwrite, self.job = schema.names, overwrite, uuid.uuid4().hex

    def place(self) -> tuple[pa.fs.FileSystem, str, str]:
        fs, path = file_system(self.path)
        return fs, path.rstrip("/"), f"{path.rstrip('/')}/_write-{self.job}"

    def text(self, batch: pa.RecordBatch) -> bytes:
        """Lines of all records. A missing quality becomes #."""
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        header, seq = columns["id"], columns["seq"]
        if "description" in columns:
            header = pc.coalesce(columns["description"], header)
        if self.kind == "fasta":
            lines = pc.binary_join_element_wise(">", header, "\n", seq, "\n", "")
        else:
            missing = pc.binary_repeat("#", pc.utf8_length(seq))
            qual = pc.coalesce(columns["qual"], missing) if "qual" in columns else missing
            lines = pc.binary_join_element_wise("@", header, "\n", seq, "\n+\n", qual, "\n", "")
        if lines.null_count:
            raise ValueError("a record has no id or no sequence")
        return b"".join(x.encode() for x in lines.to_pylist())

    def packed(self, data: bytes) -> bytes:
        """A gzip member, bzip2 stream or Zstandard frame of its own, so that readers can enter there."""
        if self.codec == "gz":
            return gzip.compress(data, 6, mtime=0)
        if self.codec == "bz2":
            return bz2.compress(data)
        if self.codec == "zst":
            import zstandard

            return zstandard.ZstdCompressor().compress(data)
        return data

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        fs, _, hidden = self.place()
        suffix = "" if self.codec == "none" else f".{self.codec}"
        name, out, held, records = f"{hidden}/{context.partitionId()}-{context.taskAttemptId()}.{self.kind}{suffix}", None, [], 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(hidden, recursive=True)
                out = fs.open_output_stream(name, compression=None)
            records += batch.num_rows
            held.append(self.text(batch))
            if sum(map(len, held)) >= MEMBER_BYTES:
                out.write(self.packed(b"".join(held)))
                held = []
        if out is None:
            return Written(None, context.partitionId(), 0)
        if held:
            out.write(self.packed(b"".join(held)))
        out.close()
        return Written(name, context.partitionId(), records)

    def commit(self, messages: list[Written]) -> None:
        fs, path, hidden = self.place()
        fs.create_dir(path, recursive=True)
        old = files_of(fs, path) if self.overwrite else []
        for m in messages:
            if m is not None and m.file:
                fs.move(m.file, f"{path}/part-{m.part:05d}-{self.job}{base_and_suffix(m.file)[1]}")
        for f in old:
            fs.delete_file(f.path)
        if fs.get_file_info(hidden).type != pa.fs.FileType.NotFound:
            fs.delete_dir(hidden)

    def abort(self, messages: list[Written]) -> None:
        fs, _, hidden = self.place()
        if fs.get_file_info(hidden).type != pa.fs.FileType.NotFound:
            fs.delete_dir(hidden)


class FastxSource(DataSource):
    """The format "fastx", option format "auto", "fasta" or "fastq", to read, to read as a stream, and to write."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FastxReader:
        filtering = self.options.get("pushFilters", "false") == "true"
        return (FilteringReader if filtering else FastxReader)(self.options, schema.names)

    def streamReader(self, schema: StructType) -> FastxStreamReader:  # noqa: N802
        return FastxStreamReader(self.options, schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> FastxWriter:
        return FastxWriter(self.options, schema, overwrite)


def read(spark: SparkSession, path: str, kind: str = "auto", columns: tuple[str, ...] = (), **options: str) -> DataFrame:
    """file, file_order, position, id, description, seq, qual; or only the given columns, then the others aren't made.

    file_order numbers the files in natural order, digits as numbers; order records by it and position, which is the byte in
    a plain file, and grows likewise in a compressed one.
    """
    spark.dataSource.register(FastxSource)
    known = {c.split()[0]: c for c in SCHEMA.split(", ")}
    asked = ", ".join(known[c] for c in columns or known)
    filtering = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("fastx").schema(asked).options(format=kind, pushFilters=filtering, **options).load(path)


def read_stream(spark: SparkSession, path: str, log: str, kind: str = "auto", **options: str) -> DataFrame:
    """The records of files as they arrive in the folder at path, with the columns of read(); `log` is a folder of the stream's own."""
    spark.dataSource.register(FastxSource)
    return spark.readStream.format("fastx").options(format=kind, log=log, **options).load(path)


def write_files(df: DataFrame, path: str, kind: str = "fastq", compression: str = "gz", mode: str = "append") -> str:
    """Write records (id, seq, ...) to files in the folder at path, all of them or none; returns path."""
    df.sparkSession.dataSource.register(FastxSource)
    df.write.format("fastx").mode(mode).options(format=kind, compression=compression).save(path)
    return path


def reference(spark: SparkSession, path: str) -> str:
    """The sequence of a file of exactly one record."""
    rows = read(spark, path, "fasta", wrapped="true").select("seq").limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} must hold one record")
    return rows[0].seq


def record_lines(df: DataFrame, kind: str) -> Column:
    """A record's lines as one column of df. Qualities that are missing become #."""
    if kind not in ("fasta", "fastq"):
        raise ValueError(f"format must be fasta or fastq, not {kind}")
    header = F.coalesce("description", "id") if "description" in df.columns else F.col("id")
    if kind == "fasta":
        return F.concat(F.lit(">"), header, F.lit("\n"), "seq").alias("value")
    qual = F.repeat(F.lit("#"), F.char_length("seq"))
    qual = F.coalesce("qual", qual) if "qual" in df.columns else qual
    return F.concat(F.lit("@"), header, F.lit("\n"), "seq", F.lit("\n+\n"), qual).alias("value")


def write(df: DataFrame, path: str, kind: str, compression: str = "gzip", by: str | None = None) -> str:
    """Write records as text files, a directory for each value of column `by` where one is given; returns path."""
    line = record_lines(df, kind)
    if by is None:
        df.select(line).write.option("compression", compression).text(path)
    else:
        df.select(by, line).write.option("compression", compression).partitionBy(by).text(path)
    return path


def append_lines(df: DataFrame, column: str, path: str) -> str:
    """Add a text line for each row to what the folder at path holds, such as the bodies of elements; returns path."""
    df.select(F.col(column).alias("value")).write.mode("append").text(path)
    return path


def write_chunks(df: DataFrame, base: str, power: int, kind: str = "fastq", level: int = 2) -> DataFrame:
    """Write records (part, record_index, ...) as one file a part, {base}.part{i}e{power}.{kind}.gz; (part, file, records).

    Each part is one task, in the order of record_index. A file appears whole under its name or not at all, and a task that
    runs again puts the same in its place. The base may be a URI; executors must reach it.
    """
    ordered = df.repartition("part").sortWithinPartitions("part", "record_index").select("part", record_lines(df, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(base)
        out, part, number, last = None, None, 0, None

        def done() -> pa.RecordBatch:
            out.close()
            raw.close()
            fs.move(last + made, last)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([last]), pa.array([number], pa.int64())], ["part", "file", "records"])

        for batch in batches:
            for p, line in zip(batch.column("part").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if p != part:
                    if out is not None:
                        yield done()
                    part, number, last, made = p, 0, f"{path}.part{p}e{power}.{kind}.gz", f".{uuid.uuid4().hex}.tmp"
                    raw = fs.open_output_stream(last + made, compression=None)
                    out = gzip.GzipFile(filename="", fileobj=raw, mode="wb", compresslevel=level, mtime=0)
                out.write(line.encode() + b"\n")
                number += 1
        if out is not None:
            yield done()

    written = ordered.select(F.col("part").cast("long").alias("part"), "value").mapInArrow(run, "part long, file string, records long")
    return df.sparkSession.createDataFrame(written.collect(), written.schema)  # a row a file


def scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
