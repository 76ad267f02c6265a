"""Importance resampling towards a target's word distribution, its features read by an Aho-Corasick dictionary.

The dictionary holds frequent distinct words between delimiters, each with its CRC and its length as payload. One scan of
a text emits the payloads of all its words; what lies between delimiters and isn't in the dictionary is computed from its
own bytes, so the dictionary's size changes no result. A feature is a run of words joined by a space; its CRC is composed
of its words' payloads, without another look at the text, and gives its bucket.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.shingles import plain
from strandloom.llm.text import free_name, slices
from strandloom.operators.chunk import with_record_index
from strandloom.session import stored

#: Words in a feature, buckets, seed of the draw, hundredths that are drawn, and words of what may be drawn.
WORDS, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10_000, 2024, 10, 20
#: Words of the dictionary and bytes of each, at most, which bounds what is broadcast.
DICTIONARY, LONGEST = 100_000, 64
#: Characters of text taken at once.
SLICE_CHARS = 6_000_000
REVERSED_POLYNOMIAL = 0xEDB88320
FULL = np.uint32(0xFFFFFFFF)


def _steps() -> np.ndarray:
    """By doublings, what 1, 2, 4 ... zero bytes more make of a remainder, by each of its four bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ REVERSED_POLYNOMIAL, one >> 1).astype(np.uint32)
    byte = np.arange(256, dtype=np.uint32)
    first = np.stack([one, *[byte << (8 * k - 8) for k in range(1, 4)]])
    found = [first]
    for _ in range(40):
        found.append(_mapped(found[-1], found[-1]))
    return np.stack(found)


def _mapped(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]


STEPS = _steps()


def composed(crc: np.ndarray, after: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of strings a followed by strings b, from those of a, those of b and the lengths of b."""
    out = crc.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        some = length >> k & 1 == 1
        out[some] = _mapped(STEPS[k], out[some])
    return out ^ after


def dictionary(texts: DataFrame, most: int = DICTIONARY) -> list[bytes]:
    """Some `most` of the most frequent words of up to LONGEST bytes, from a power of two of occurrences on.

    Words that no slice of texts holds twice aren't looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("text").to_pylist()
            for first, end in slices(held, SLICE_CHARS):
                found = Counter(chain.from_iterable(t.split() for t in plain(held[first:end])))
                found = [(w, n) for w, n in found.items() if n > 1 and len(w) <= LONGEST]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], ["word", "n"]
                )

    counts = texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stored(counts.select("word", F.floor(F.log2("n")).cast("int").alias("power")), "words")
    held, cut = 0, 64
    for r in sorted(counts.groupBy("power").count().collect(), reverse=True):  # 64 rows at most
        held += r["count"]
        if held > most:
            break
        cut = r.power
    return sorted(bytes(r.word) for r in counts.filter(F.col("power") >= cut).select("word").collect())


class Scanner:
    """The automaton of a dictionary with its payloads. It is built in each worker, as it holds for all its tasks."""

    built: dict[str, Scanner] = {}

    def __init__(self, words: list[bytes]):
        self.crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.automaton = ahocorasick.Automaton()
        for i, w in enumerate(words):
            self.automaton.add_word(f" {w.decode('latin-1')} ", i)
        if words:
            self.automaton.make_automaton()

    @classmethod
    def of(cls, key: str, words: list[bytes]) -> Scanner:
        if key not in cls.built:
            cls.built.clear()
            cls.built[key] = Scanner(words)
        return cls.built[key]

    def payloads(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRC, length and text number of every word of all texts, in order."""
        parts = plain(texts)
        begins = np.cumsum([1, *[len(p) + 1 for p in parts]])
        data = b" " + b" ".join(parts) + b" "
        inside = np.frombuffer(data, np.uint8) != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, end = edges[::2], edges[1::2]
        crc, known = np.zeros(len(start), np.uint32), np.zeros(len(start), bool)
        if len(self.crc):
            hits = np.fromiter(chain.from_iterable(self.automaton.iter(data.decode("latin-1"))), np.int64).reshape(-1, 2)
            at = np.searchsorted(end, hits[:, 0])  # a match ends at the delimiter after its word
            crc[at], known[at] = self.crc[hits[:, 1]], True
        rest = np.flatnonzero(~known)
        crc[rest] = [zlib.crc32(data[s:e]) for s, e in zip(start[rest].tolist(), end[rest].tolist(), strict=True)]
        return crc, end - start, np.searchsorted(begins, start, "right") - 1


def buckets_of(crc: np.ndarray, length: np.ndarray, text: np.ndarray, words: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the text number of every run of 1 to `words` words, by text."""
    of, found = [text], [crc]
    run = crc
    space = np.uint32(zlib.crc32(b" "))
    for n in range(2, words + 1):
        last = np.arange(n - 1, len(crc))
        run = composed(run[: len(last)], np.full(len(last), space), np.ones(len(last), np.int64))
        run = composed(run, crc[last], length[last])
        whole = text[last] == text[: len(last)]
        of.append(text[: len(last)][whole])
        found.append(run[whole])
    of, found = np.concatenate(of), np.concatenate(found)
    order = np.argsort(of, kind="stable")
    return (found[order] % np.uint32(buckets)).astype(np.uint32), of[order]


def bags(rows: DataFrame, words: list[bytes], width: int, buckets: int, names: tuple[str, str, str]) -> DataFrame:
    """rows without their text; three columns more: numbers of words and features, and each feature's bucket (4 bytes)."""
    key = uuid.uuid4().hex
    shared = rows.sparkSession.sparkContext.broadcast(words)
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner.of(key, shared.value)
        for batch in batches:
            held = batch.column("text").to_pylist()
            for first, end in slices(held, SLICE_CHARS):
                crc, length, text = scanner.payloads(held[first:end])
                n_words = np.bincount(text, minlength=end - first)
                bucket, of = buckets_of(crc, length, text, width, buckets)
                n = np.bincount(of, minlength=end - first)
                data = [x.tobytes() for x in np.split(bucket, np.cumsum(n)[:-1])]
                part = batch.slice(first, end - first)
                columns = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(n_words, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], [*kept, *names]
                )

    added = [T.StructField(n, kind) for n, kind in zip(names, (T.LongType(), T.LongType(), T.BinaryType()), strict=True)]
    return rows.mapInArrow(run, T.StructType([*[f for f in rows.schema.fields if f.name != "text"], *added]))


def counted(bag: DataFrame, column: str, buckets: int) -> np.ndarray:
    """How many features each bucket has, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(data, np.uint32), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in bag.select(column).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t, n = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """A draw's noise, which doc_id and seed decide."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(
    docs: DataFrame, target: DataFrame, words: int = WORDS, buckets: int = BUCKETS, percent: int = PERCENT,
    least_words: int = LEAST_WORDS, seed: int = SEED, most: int = DICTIONARY,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs; the rank is null where a row isn't drawn.

    Words are the runs of digits, letters a-z and characters beyond ASCII once A-Z are lower-cased; features are all runs
    of 1 to `words` of them, counted by `buckets` buckets in docs and in target (text). A null or empty text
    has no words, weight 0, and is never drawn. Repeated rows count each time, and are drawn one by one. Rows with a null
    doc_id count as part of docs, but have a null score and aren't drawn. Equal scores go by doc_id; other columns take no
    part; an empty target leaves what docs are rich in less likely; with empty docs the result is empty; texts are whole.
    """
    frequent = dictionary(docs.select("text"), most)
    names = tuple(free_name(n, ["doc_id", "text"]) for n in ("__words", "__features", "__buckets"))
    of = lambda rows: bags(rows, frequent, words, buckets, names)
    bag = stored(of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "bags")
    gains = gains_of(counted(bag, names[2], buckets), counted(of(target.select("text")), names[2], buckets))
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # `buckets` numbers

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(shared.value[np.frombuffer(x, np.uint32)].sum()) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"]
            )

    weighed = bag.select("doc_id", *names).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    scored = stored(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "weighed")
    may = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    n = scored.filter(may).count()
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = with_record_index(scored.filter(may).select(*columns, (-F.col("score")).alias("__less")), "__less", "doc_id")
    rank = F.when(F.col("record_index") < percent * n // 100, F.col("record_index") + 1)
    others = scored.filter(~may).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, rank.cast("long").alias("rank")).unionByName(others)


def op12_aho_corasick_resampling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resampled(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


#: The CRC is that of the words' UTF-8 bytes, by a table that SQL makes.
OP12_SQL = r"""
with t as materialized (select list(list_reduce(list_prepend(b, range(8)),
    lambda c, k: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1)) order by b) as t from range(256) r(b)),
side as (select 'd' as side, doc_id as id, text from documents union all select 't', item_id, text from benchmark),
w as materialized (select side, id, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) as w from side),
x as (select w, hex(encode(w)) as h from (select distinct w from w)),
b as materialized (select w, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2),
    lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::bigint)),
    lambda c, y: xor(t.t[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) % 10000 as b from x, t),
n as (select b, count(*) filter (side = 'd') as s, count(*) filter (side = 't') as t from w join b using (w) group by b),
a as (select sum(s) as s, sum(t) as t from n),
g as (select b, floor(1000 * ln((n.t + 1)::double * (a.s + 10000)::double / ((n.s + 1)::double * (a.t + 10000)::double)))::bigint as g
      from n, a),
d as (select id, count(*) as n, sum(g)::bigint as weight from w join b using (w) join g using (b) where side = 'd' group by id),
e as (select doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
        ('0x' || sha256('2024:' || doc_id)[1:8])::bigint as h from documents left join d on id = doc_id),
s as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint as score from e),
r as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as k,
        count(*) filter (n_features >= 20) over () as m from s)
select doc_id, n_features, weight, score, case when n_features >= 20 and k <= 10 * m // 100 then k end as rank from r
"""
