"""Near-duplicate documents: MinHash bands for candidates, odd sketches to screen them, exact sets to confirm."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.components import connect
from strandloom.llm.shingles import mixed, shingle_set, words_of
from strandloom.session import stored

SKETCH_BITS = 512
#: Members of a bucket are compared in blocks of so many, which bounds what a task holds.
BLOCK = 256
#: Up to so many sets are compared with others one by one; more, by matrices.
FEW = 8
#: Ids of documents to fetch are broadcast up to so many (8 bytes each); beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Plan:
    """Which texts are near: at least `percent` hundredths of the union of their shingle sets in common.

    Bands and rows follow from it: a link at the threshold shares no band with a chance under `miss`.
    """

    width: int = 5
    percent: int = 80
    rows: int = 5
    miss: float = 1e-5

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def most_bits(self) -> int:
        """Odd sketches of a link differ in no more bits, but with a chance of about one in a million."""
        k, far = self.bands * self.rows, 1 - self.percent / 100
        differ = 2 * (k * far + 4.8 * math.sqrt(k * far * (1 - far)))
        mean = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differ)
        return math.ceil(mean + 2 * math.sqrt(SKETCH_BITS / 4))


def _signature(plan: Plan):
    """A function from a shingle set to its band keys and its odd sketch."""
    k = plan.bands * plan.rows
    rng = np.random.default_rng(20_240_601)
    times = (rng.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
    flip = rng.integers(0, 2**32, k, dtype=np.uint32)[:, None]
    order = np.arange(k, dtype=np.uint64)
    band_no = np.arange(plan.bands, dtype=np.uint64)

    def of(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(k, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 2048):
            np.minimum(least, ((low[at : at + 2048] ^ flip) * times).min(axis=1), out=least)
        values = least.astype(np.uint64)
        key = band_no + np.uint64(1)
        for row in values.reshape(plan.bands, plan.rows).T:
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + row)
        bits = mixed((values << np.uint64(16)) + order) % np.uint64(SKETCH_BITS)
        parity = np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS).astype(np.uint8) & 1
        return key.view(np.int64), np.packbits(parity).view(np.int64)

    return of


def signatures(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, n (size of the shingle set), h1 and h2 (its identity), bands, sketch; the last four null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = _signature(plan)
        for batch in (whole.slice(at, 2000) for whole in batches for at in range(0, whole.num_rows, 2000)):
            n, h1, h2, bands, sketch = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(words_of(text), plan.width)
                n.append(len(s))
                if len(s):
                    whole = xxhash.xxh3_128_digest(s.tobytes())
                    a, b = np.frombuffer(whole, np.int64)
                    keys, bits = sign(s)
                else:
                    a = b = keys = bits = None
                for to, x in ((h1, a), (h2, b), (bands, keys), (sketch, bits)):
                    to.append(x)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                 pa.array(bands, longs), pa.array(sketch, longs)],
                ["doc_id", "n", "h1", "h2", "bands", "sketch"],
            )

    schema = "doc_id long, n long, h1 long, h2 long, bands array<long>, sketch array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """id and set, the distinct shingle hashes of each row's whole text; a task gives repeated rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, sets = [], []
                for i, t in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    name = (i, xxhash.xxh3_128_intdigest((t or "").encode("utf-8", "surrogatepass")))
                    if name not in seen:
                        seen.add(name)
                        ids.append(i)
                        sets.append(shingle_set(words_of(t), width).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "set"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "id long, set array<long>")


def _bits_apart(a: str, b: str) -> Column:
    """How many bits of two odd sketches differ."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, v) -> s + v)")


def _near_by_sketch(pairs: DataFrame, sketches: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b, m) whose sketches are close enough; sets aren't looked at."""
    left = sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))
    return pairs.join(left, "a").join(right, "b").filter(_bits_apart("sa", "sb") <= plan.most_bits).select("a", "b", "m")


class _Blocks:
    """Compares stragglers with the other members of their bucket, block by block, over a sorted stream of rows.

    Rows that have a sketch are screened by it first; those without one have been.
    """

    def __init__(self, plan: Plan) -> None:
        self.plan = plan

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            sets = batch.column("set")
            ends, values = sets.offsets.to_numpy(), sets.values.to_numpy()
            for n, row in enumerate(batch.drop_columns(["set"]).to_pylist()):
                if held and (row["key"], row["i"], row["j"]) != (held[0]["key"], held[0]["i"], held[0]["j"]):
                    yield self.links(held)
                    held = []
                held.append(row | {"set": values[ends[n] : ends[n + 1]].copy()})
        if held:
            yield self.links(held)

    def links(self, rows: list[dict]) -> pa.RecordBatch:
        """Links between classes of texts that aren't known to be connected: one for each pair of components at most."""
        stray = [r for r in rows if r["stray"]]
        other = [r for r in rows if not r["stray"]]
        out: list[tuple[int, int]] = []
        if stray and other:
            label_a, label_b = (np.array([r["label"] for r in x]) for x in (stray, other))
            maybe = label_a[:, None] != label_b[None, :]
            if stray[0]["sketch"] is not None:
                a, b = (np.array([r["sketch"] for r in x]).view(np.uint64) for x in (stray, other))
                apart = np.stack([np.bitwise_count(x ^ b).sum(axis=1) for x in a])
                maybe &= apart <= self.plan.most_bits
            rows_a, rows_b = maybe.any(axis=1).nonzero()[0], maybe.any(axis=0).nonzero()[0]
            if len(rows_a):
                near = self.near([stray[i]["set"] for i in rows_a], [other[i]["set"] for i in rows_b])
                near &= maybe[np.ix_(rows_a, rows_b)]
                i, j = near.nonzero()
                found = {tuple(sorted(p)) for p in zip(label_a[rows_a[i]].tolist(), label_b[rows_b[j]].tolist(), strict=True)}
                root: dict[int, int] = {}

                def top(x: int) -> int:
                    while root.setdefault(x, x) != x:
                        x = root[x]
                    return x

                for x, y in sorted(found):
                    if top(x) != top(y):  # the rest say nothing new about what is connected
                        root[top(y)] = top(x)
                        out.append((x, y))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    def near(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """Which sets of a are near which of b, by exact sizes of intersections."""
        sizes = np.array([len(x) for x in (*a, *b)])
        together = sizes[: len(a), None] + sizes[None, len(a) :]
        common = self.few(a, b) if len(a) <= FEW else self.common(a, b, sizes)
        return 100 * common >= self.plan.percent * (together - common)

    def few(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """Sizes of intersections, one set of a with one of b at a time."""
        return np.array([[self.shared(x.view(np.uint64), y.view(np.uint64)) for y in b] for x in a])

    def shared(self, x: np.ndarray, y: np.ndarray) -> int:
        """How much of y is in x; sets are in unsigned order."""
        return int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())

    def common(self, a: list[np.ndarray], b: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        """Sizes of intersections, all by products of matrices."""
        of = np.repeat(np.arange(len(sizes)), sizes)
        _, place, count = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
        shared = count[place] > 1  # what one set alone holds is in no intersection
        of, place = of[shared], np.unique(place[shared], return_inverse=True)[1]
        common = np.zeros((len(a), len(b)), np.float32)
        for at in range(0, int(place.max(initial=-1)) + 1, 4096):
            here = (place >= at) & (place < at + 4096)
            holds = np.zeros((len(sizes), 4096), np.float32)
            holds[of[here], place[here] - at] = 1
            common += holds[: len(a)] @ holds[len(a) :].T
        return common


def near_groups(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row that has a doc_id.

    Words are runs of other characters than the six ASCII white spaces, A-Z lower-cased. A row's set holds its distinct
    runs of plan.width words, or the whole text as one where it has fewer; rows without words have an empty set, link
    with nothing and are their own component. component_id is the smallest doc_id that links lead to. A null text has no
    words; rows with a null doc_id are left out; rows that share a doc_id are one document that links by any of its
    texts, and each keeps its row; other columns take no part; an empty table gives an empty table; texts are whole.

    Equal sets are one class before anything is compared. Classes that share a band meet through their bucket's leader:
    their sketches are compared, and only what these let through fetches sets, which meet in blocks of a leader and up to
    some BLOCK members. After that, only members of a bucket that aren't connected to its leader are compared, in
    blocks, with the others. Both ways screen by odd sketches and confirm on full sets.
    """
    plan = plan or Plan()
    docs = docs.filter(F.col("doc_id").isNotNull())
    signed = stored(signatures(docs, plan), "signatures")
    # equal sets have equal bands and sketches, so the first is as good as any
    classes = signed.filter("n > 0").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    classes = stored(classes, "classes")
    placed = classes.select("id", F.explode("bands").alias("key"))
    buckets = placed.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("__last"), F.count("*").alias("m"))
    buckets = stored(buckets.filter("leader < __last").drop("__last"), "buckets")
    members = stored(placed.join(buckets, "key"), "members")
    sketches = classes.select("id", "sketch")

    def sets_of(ids: DataFrame) -> DataFrame:
        """(id, set) of the ids, of each of its texts where it has several."""
        ids = stored(ids.distinct(), "ids")
        few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        return full_sets(docs.join(few.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), plan.width)

    def compared(cells: DataFrame, sets: DataFrame) -> DataFrame:
        filled = cells.join(sets, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        ordered = filled.select("key", "i", "j", "label", "stray", "sketch", "set")
        return ordered.mapInArrow(_Blocks(plan), "a long, b long")

    pairs = members.filter("id > leader").groupBy(F.col("leader").alias("a"), F.col("id").alias("b")).agg(F.max("m").alias("m"))
    # a bucket of m members has about m / BLOCK blocks; the leader goes once to each
    block = F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / BLOCK)).cast("int")
    close = stored(_near_by_sketch(pairs, sketches, plan).select("a", "b", block.alias("j")), "close")
    cell = lambda df, id_, stray: df.select(
        F.col("a").alias("key"), F.col(id_).alias("id"), F.col(id_).alias("label"), F.lit(stray).alias("stray"),
        F.lit(0).alias("i"), "j", F.lit(None).cast("array<long>").alias("sketch"),
    )
    cells = cell(close, "b", False).unionByName(cell(close.select("a", "j").distinct(), "a", True))
    labels = connect(compared(cells, sets_of(close.select(F.explode(F.array("a", "b")).alias("id")))))

    known = members.filter("m > 2").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    known = stored(known, "known")  # pairs are buckets that leaders have seen to
    open_ = known.groupBy("key").agg(
        F.max(F.when(F.col("id") == F.col("leader"), F.col("label"))).alias("main"),
        F.min("label").alias("lo"), F.max("label").alias("hi"),
        F.bit_xor(F.xxhash64("id")).alias("who"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("who2"),
        F.first("m").alias("m"),
    ).filter("lo < hi")
    once = stored(open_.groupBy("who", "who2", "m").agg(F.min(F.struct("key", "main")).alias("b")).select("b.*"), "open")
    inside = stored(known.join(once, "key").withColumn("stray", F.col("label") != F.col("main")), "inside")
    strays = stored(inside.filter("stray").groupBy("key").agg(F.count("*").alias("s")), "strays")
    inside = inside.join(strays, "key")
    n_i, n_j = F.ceil(F.col("s") / BLOCK).cast("int"), F.ceil(F.col("m") / BLOCK).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    cells = inside.select("key", "id", "label", F.lit(False).alias("stray"), F.explode(upto(n_i)).alias("i"), mine(n_j).alias("j"))
    cells = cells.unionByName(
        inside.filter("stray").select("key", "id", "label", "stray", mine(n_i).alias("i"), F.explode(upto(n_j)).alias("j"))
    )
    cells = cells.join(sketches, "id")
    more = connect(compared(cells, sets_of(inside.select("id"))))

    joined = labels.join(more.select(F.col("id").alias("label"), F.col("label").alias("top")), "label", "left")
    alone = more.join(labels, "id", "left_anti")  # classes that no leader linked
    ends = joined.select("id", F.coalesce("top", "label").alias("label")).unionByName(alone.select("id", "label"))
    named = stored(classes.join(ends, "id", "left").select("h1", "h2", F.coalesce("label", "id").alias("component_id")), "named")
    return signed.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2").join(named, ["h1", "h2"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def op2_odd_sketches(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_groups(docs, Plan(width=3, percent=85, rows=6)).withColumn(
        "kept", F.col("doc_id") == F.col("component_id")
    )


OP2_SQL = r"""
with recursive w as (select doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] as w from documents),
s as materialized (select distinct doc_id, array_to_string(w[i : i + 2], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from w where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
r(x, y) as (select doc_id, doc_id from documents union select r.x, l.b from r join l on r.y = l.a),
c as (select x as doc_id, min(y) as component_id from r group by 1)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from c left join n using (doc_id)
"""
