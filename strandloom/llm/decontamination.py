"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by the size of their shingle sets. An item's sketch is its bottom-k MinHash: the k smallest of
its shingle hashes. k follows from its size n so that no text that holds enough of the item can miss all of them:
k = n - ceil(share * n) + 1. Of a document, each partition sees the sketch below the partition's largest hash, and
only if the document is large enough to hold the partition's smallest item. Where the sketches meet, the full sets
are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.shingles import shingle_set, words_of
from strandloom.session import stored

WIDTH, PERCENT = 5, 80
#: Sketches also go to the tasks as bitmaps, which let only hashes pass that may meet: 16 to 32 bits for each hash. Where
#: that is more than MOST_BITS (16 MB), documents are read several times, each time for some of the hashes.
BITS_A_HASH, MOST_BITS = 16, 1 << 27
#: Sketches and ids are broadcast up to so many rows; beyond, they are joined by shuffle.
BROADCAST_ROWS = 500_000


def item_sets(items: DataFrame, width: int) -> DataFrame:
    """item_id, width (less for items of fewer words), n and set; items without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text, punctuation=False)
                if words:
                    s = shingle_set(words, width)
                    rows.append((i, min(width, len(words)), len(s), s.view(np.int64)))
            ids, widths, n, sets = ([r[k] for r in rows] for k in range(4))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(widths, pa.int32()), pa.array(n, pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                ["item_id", "width", "n", "set"],
            )

    cols = items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    return cols.mapInArrow(run, "item_id long, width int, n long, set array<long>")


def _bitmaps(sketches: DataFrame) -> list[tuple[int, int, int, np.uint64, np.uint64, np.ndarray]]:
    """(width, part, least document size, largest hash, bits, bitmap) of each partition, of which there are few."""
    sign = F.lit(-(2**63)).cast("long")  # unsigned order
    bits = F.pow(F.lit(2.0), F.ceil(F.log2(F.count("*") * BITS_A_HASH))).cast("long")
    ends = sketches.groupBy("width", "part").agg(
        F.max(F.col("hash").bitwiseXOR(sign)).alias("top"), F.min("need").alias("need"), bits.alias("bits")
    )
    ends = stored(ends, "partitions")
    bit = "pmod(hash, bits)"
    words = sketches.join(F.broadcast(ends.select("width", "part", "bits")), ["width", "part"]).groupBy(
        "width", "part", F.expr(f"{bit} div 64").alias("word")
    ).agg(F.expr(f"bit_or(shiftleft(1L, cast({bit} % 64 as int)))").alias("set"))
    held = words.toArrow()  # MOST_BITS / 64 rows at most
    width, part, word, filled = (held.column(c).to_numpy() for c in ("width", "part", "word", "set"))
    found = []
    for r in sorted(ends.collect()):
        here = (width == r.width) & (part == r.part)
        bitmap = np.zeros(r.bits // 64 + 1, np.int64)
        bitmap[word[here]] = filled[here]
        found.append((r.width, r.part, r.need, np.uint64(r.top + 2**63), np.uint64(r.bits), bitmap.view(np.uint64)))
    return found


def passing(hashes: np.ndarray, bits: np.uint64, bitmap: np.ndarray) -> np.ndarray:
    """Those of the hashes whose bit is set."""
    at = hashes % bits
    return hashes[(bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]


def contained_items(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): the items of which a document holds at least percent hundredths.

    Words have their A-Z lower-cased and ASCII punctuation taken out; an item's set holds its distinct runs of `width`
    words, or its whole text as one run where it has fewer. Null or empty texts on either side meet nothing, as do
    rows with a null doc_id or item_id; rows that share an id are taken one by one, and each pair comes once, with the
    most shared; other columns take no part; an empty table on either side gives an empty table; texts are whole.
    """
    spark = docs.sparkSession
    sets = stored(item_sets(items, width), "items")
    need = F.ceil(F.col("n") * percent / 100)  # sets are in unsigned order, as shingle_set() gives them
    sketches = stored(
        sets.select(
            "item_id", "width", need.alias("need"), F.floor(F.log2("n")).cast("int").alias("part"),
            F.explode(F.slice("set", F.lit(1), (F.col("n") - need + 1).cast("int"))).alias("hash"),
        ),
        "sketches",
    )
    widths_used = sorted(r.width for r in sets.select("width").distinct().collect())  # `width` at most

    def probing(maps):
        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, widths, parts, hashes = [], [], [], []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    words, of = words_of(text, punctuation=False), {}
                    for w, part, least, top, bits, bitmap in maps.value:
                        if w > len(words):
                            continue
                        s = of.setdefault(w, None)
                        if s is None:
                            s = of[w] = shingle_set(words, w)
                        if len(s) < least:
                            continue
                        hit = passing(s[: np.searchsorted(s, top, "right")], bits, bitmap).view(np.int64)
                        ids += [doc] * len(hit)
                        widths += [w] * len(hit)
                        parts += [part] * len(hit)
                        hashes += hit.tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(widths, pa.int32()), pa.array(parts, pa.int32()), pa.array(hashes, pa.int64())],
                    ["doc_id", "width", "part", "hash"],
                )

        return probe

    def doc_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = []
                part = batch.slice(at, 200)
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    words = words_of(text, punctuation=False)
                    rows += [(doc, w, shingle_set(words, w).view(np.int64)) for w in widths_used if w <= len(words)]
                ids, widths, found = ([r[k] for r in rows] for k in range(3))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(widths, pa.int32()), pa.array(found, pa.list_(pa.int64()))],
                    ["doc_id", "width", "held"],
                )

    texts = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = sketches.select("width", "part", "hash", "item_id")
    n = index.count()
    passes = max(1, -(-2 * BITS_A_HASH * n // MOST_BITS))
    hits = None
    for turn in range(passes):
        some = sketches if passes == 1 else sketches.filter(F.pmod(F.xxhash64("hash"), passes) == turn)
        maps = spark.sparkContext.broadcast(_bitmaps(some))
        found = texts.mapInArrow(probing(maps), "doc_id long, width int, part int, hash long")
        hits = found if hits is None else hits.unionByName(found)
    if n <= BROADCAST_ROWS:
        index = F.broadcast(index)
    pairs = stored(hits.join(index, ["width", "part", "hash"]).select("doc_id", "item_id").distinct(), "pairs")
    ids = stored(pairs.select("doc_id").distinct(), "ids")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    held = texts.join(ids, "doc_id", "left_semi").mapInArrow(doc_sets, "doc_id long, width int, held array<long>")
    wanted = pairs.join(sets, "item_id")
    shared = F.size(F.array_intersect("set", "held")).cast("long")
    return (
        wanted.join(held, ["doc_id", "width"])
        .select("doc_id", "item_id", F.col("n").alias("n_item"), shared.alias("n_shared"))
        .filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)
        .groupBy("doc_id", "item_id", "n_item")
        .agg(F.max("n_shared").alias("n_shared"))
    )


def op8_contained_items(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contained_items(docs, items).withColumn("containment", F.col("n_shared") / F.col("n_item"))


OP8_SQL = r"""
with t as (select 'd' as side, doc_id as id, text from documents union all select 'i', item_id, text from benchmark),
w as materialized (select side, id, [x for x in string_split_regex(regexp_replace(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[!-/:-@\[-`{-~]', '', 'g'),
        '[\x20\x09-\x0D]+') if x <> ''] as w from t),
k as (select distinct least(5, len(w)) as k from w where side = 'i' and len(w) > 0),
s as (select distinct side, id, k, array_to_string(w[i : i + k - 1], ' ') as g
      from (select side, id, k, w, unnest(range(1, len(w) - k + 2)) as i
            from w join k on len(w) >= k and (side = 'd' or k = least(5, len(w))))),
n as (select id, count(*) as n from s where side = 'i' group by id)
select d.id as doc_id, i.id as item_id, n.n as n_item, count(*) as n_shared, count(*) / n.n as containment
from s d join s i on d.g = i.g and d.k = i.k and d.side = 'd' and i.side = 'i' join n on n.id = i.id
group by d.id, i.id, n.n having count(*) * 100 >= n.n * 80
"""
