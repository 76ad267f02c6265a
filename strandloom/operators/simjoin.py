"""Similarity join of short strings: a part that errors must leave whole brings pairs together, edit distance decides.

Barcodes are joined as bits (functions.bits). An index has an entry for each stretch of a barcode in which a part of a
similar one may lie; a probe has a key for each of its parts. Keys that very many share are refined by a second part.
What meets is screened by bits, and only what passes is spelled out and measured.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import bits, meet
from strandloom.functions.sequence import BARCODE, BARCODE_ERRORS, PART
from strandloom.session import settled, stored

#: Rows of one key that a task compares with others; what a key has beyond is dealt out to further tasks.
HOT = 5000
#: Parts of a key from which on it is refined: rows for every refinement cost more than pairs below.
CROWD = 500
#: Records that are packed together, barcodes of a block, those spelled together.
RUN, BLOCK, SPELLED = 1 << 19, 100_000, 1 << 15
#: In place of a block's number: barcodes of both sides, those of several records.
SAME, MANY = -1, -2
#: Hot and crowded keys are broadcast up to so many rows; beyond, they are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Where a key's fields begin: a part's letters, its number, and for refined ones the number of the second part, its letters, and a mark.
NUMBER, SECOND, SECOND_LETTERS, REFINED = 27, 29, 31, 1 << 60


def is_fit(barcode: Column) -> Column:
    """Whether a barcode can be compared."""
    return F.coalesce(barcode.rlike(f"^[ATCGN]{{{BARCODE}}}$"), F.lit(False))


def bad_barcodes(records: DataFrame) -> DataFrame:
    """(barcode, records): what similar_pairs() leaves out, counted."""
    bad = records.filter(~is_fit(F.col("barcode")))
    return bad.groupBy("barcode").agg(F.count("*").alias("records"))


def fit(records: DataFrame, on_bad_base: str = "drop") -> DataFrame:
    """(barcode) of the records that have one that can be compared."""
    good = is_fit(F.col("barcode"))
    if on_bad_base == "fail":
        wrong = F.raise_error(F.concat(F.lit("not a barcode: "), F.col("barcode"))).cast("boolean")
        good = F.when(good, True).when(F.col("barcode").isNull(), False).otherwise(wrong)
    return records.filter(good).select("barcode")


def coded(records: DataFrame, on_bad_base: str = "drop") -> DataFrame:
    """(p0, p1, p2): the distinct barcodes of records as bits, written once as they are read several times."""
    rows = fit(records, on_bad_base).distinct()
    return stored(rows.select(*[p.alias(f"p{k}") for k, p in enumerate(bits.planes(F.col("barcode")))]), "codes")


def _as(codes: DataFrame, name: str) -> DataFrame:
    """codes with columns {name}0 to {name}2 that are never null, which keeps what is computed of them simple."""
    return codes.select(*[F.coalesce(f"p{k}", F.lit(0).cast("long")).alias(f"{name}{k}") for k in range(bits.PLANES)])


def _planes(name: str) -> list[Column]:
    return [F.col(f"{name}{k}") for k in range(bits.PLANES)]


def _key(of: list[Column], part: int, at: int) -> Column:
    return bits.piece(of, at, PART).bitwiseOR(F.lit(part << NUMBER).cast("long"))


def probes(codes: DataFrame, parts: list[int]) -> DataFrame:
    """(key, a0, a1, a2): a row for each of these parts."""
    a = _as(codes, "a")
    return a.select(F.explode(F.array(*[_key(_planes("a"), i, i * PART) for i in parts])).alias("key"), *a.columns)


def entries(codes: DataFrame, match: str, parts: list[int], errors: int = BARCODE_ERRORS, narrow: bool = False) -> DataFrame:
    """(key, b0, b1, b2): a row for each distinct stretch in which one of these parts of a similar barcode may lie.

    With `narrow` a column more tells those that match "global" has too.
    """
    b = _as(codes, "b")
    spots = lambda match: F.array_distinct(
        F.array(*[_key(_planes("b"), i, i * PART + s) for i, s in bits.offsets(match, errors) if i in parts])
    )
    if not narrow:
        return b.select(F.explode(spots(match)).alias("key"), *b.columns)
    near = b.withColumn("__narrow", spots("global"))
    found = near.select(F.explode(spots(match)).alias("key"), *near.columns)
    return found.select("key", *b.columns, F.array_contains("__narrow", F.col("key")).alias("narrow"))


def second_parts(part: int, errors: int = BARCODE_ERRORS) -> list[tuple[int, int]]:
    """(place, size) of errors + 1 pieces of the letters beside a part, as even as can be.

    Where a part is whole, all errors are in these letters, so one of the pieces is whole too.
    """
    left, right = part * PART, BARCODE - PART - part * PART
    n_left = round((errors + 1) * left / (left + right))
    found = []
    for first, size, n in ((0, left, n_left), (left + PART, right, errors + 1 - n_left)):
        edges = [first + size * k // n for k in range(n + 1)] if n else []
        found += [(x, y - x) for x, y in zip(edges[:-1], edges[1:], strict=True)]
    return found


def _refined_keys(of: list[Column], errors: int, shifts: range) -> Column:
    """The refinements of key: with each piece beside the part, wherever the shifts let it lie."""

    def of_part(i: int) -> Column:
        found = []
        for n, (place, size) in enumerate(second_parts(i, errors)):
            mark = F.lit(REFINED | n << SECOND).cast("long")
            for s in shifts:
                if 0 <= place + s <= BARCODE - size:
                    letters = F.shiftleft(bits.piece(of, place + s, size), SECOND_LETTERS)
                    found.append(F.col("key").bitwiseOR(mark).bitwiseOR(letters))
        return F.array_distinct(F.array(*found))

    number = F.shiftrightunsigned("key", NUMBER)
    keys = of_part(errors)
    for i in range(errors):
        keys = F.when(number == i, of_part(i)).otherwise(keys)
    return keys


def refined(
    rows: DataFrame, name: str, crowded: DataFrame | None, errors: int, whole_too: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """rows with crowded keys replaced by their refinements; with whole_too they keep the key itself as well.

    For each pair that met by a crowded key there is a refinement by which it meets. name is "a" for probes, whose
    pieces have one place, and "b" for entries.
    """
    if crowded is None:
        return rows
    marked = rows.join(crowded.select("key", F.lit(True).alias("__crowded")), "key", "left")
    keys = _refined_keys(_planes(name), errors, range(1) if name == "a" else range(-errors, errors + 1))
    keys = F.concat(F.array("key"), keys) if whole_too else keys
    keys = F.when(F.col("__crowded"), keys).otherwise(F.array("key"))
    return marked.select(F.explode(keys).alias("key"), *[f"{name}{k}" for k in range(bits.PLANES)], *keep)


def small(df: DataFrame, name: str) -> DataFrame | None:
    """df written, and broadcast if it has few rows; None if it has none."""
    df = stored(df, name)
    n = df.count()
    return (F.broadcast(df) if n <= BROADCAST_ROWS else df) if n else None


def crowded_keys(left: DataFrame, right: DataFrame, parts: list[int], crowd: int) -> DataFrame | None:
    """(key) of parts that more than `crowd` barcodes of either side have."""
    sides = [probes(c, parts).groupBy("key").agg(F.count("*").alias("n")) for c in ([left] if right is left else [left, right])]
    many = [s.filter(F.col("n") > crowd).select("key") for s in sides]
    return small(reduce(DataFrame.unionByName, many).distinct(), "crowded")


def meeting(probe: DataFrame, index: DataFrame, hot: int = HOT) -> DataFrame:
    """probe and index joined by key. Keys with more than `hot` rows on either side are dealt to tasks, on both sides."""
    many = lambda df, n: df.groupBy("key").agg(F.count("*").alias(n)).filter(F.col(n) > hot)
    shares = lambda n: F.coalesce(F.ceil(F.col(n) / hot), F.lit(1)).cast("int").alias(n)
    salts = small(many(probe, "s").join(many(index, "t"), "key", "full").select("key", shares("s"), shares("t")), "hot")
    if salts is None:
        return probe.join(index, "key")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    s, t = (F.coalesce(n, F.lit(1)) for n in ("s", "t"))
    mine = lambda name, n: F.pmod(F.xxhash64(*_planes(name)), n).cast("int")
    left = probe.join(salts, "key", "left").select(*probe.columns, mine("a", s).alias("__s"), F.explode(upto(t)).alias("__t"))
    right = index.join(salts, "key", "left").select(*index.columns, F.explode(upto(s)).alias("__s"), mine("b", t).alias("__t"))
    return left.join(right, ["key", "__s", "__t"])


def measured(met: DataFrame, match: str, recall: str, errors: int, once: bool = False) -> DataFrame:
    """(a, b, cost) of the pairs among `met` that are near. With `once` met has one order of each pair, and both are given."""
    # most of what meets isn't near: the screen comes before repeated pairs are sent to one task
    names = [f"{side}{k}" for side in "ab" for k in range(bits.PLANES)]
    pairs = met.filter(bits.may_be_near(_planes("a"), _planes("b"), errors)).select(*names).distinct()
    infix = match == "infix"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [batch.column(n).to_numpy() for n in names]
            a, b = codes[: bits.PLANES], codes[bits.PLANES :]
            cost = bits.edit_costs(a, b, infix)
            near = cost <= errors
            a, b, cost = [p[near] for p in a], [p[near] for p in b], cost[near]
            if once:
                other = np.any([x != y for x, y in zip(a, b, strict=True)], axis=0)
                a, b = ([np.append(x, y[other]) for x, y in zip(p, q, strict=True)] for p, q in ((a, b), (b, a)))
                cost = np.append(cost, cost[other])
            costs = pa.nulls(len(cost), pa.int32()) if infix else pa.array(cost.astype(np.int32))
            yield pa.RecordBatch.from_arrays([bits.spelled(a), bits.spelled(b), costs], ["a", "b", "cost"])

    near = pairs.mapInArrow(run, "a string, b string, cost int")
    return near.filter(compat()) if recall == "compat" else near


def compat() -> Column:
    """Whether one of a's first three parts lies in b, at an offset but the last."""
    inside = [F.contains(F.left("b", F.lit(BARCODE - 1)), F.substring("a", i * PART + 1, F.lit(PART))) for i in range(BARCODE // PART - 1)]
    return reduce(Column.__or__, inside)


def _ordered() -> Column:
    """Whether a's bits come before b's, or are the same."""
    before = F.col("a2") <= F.col("b2")
    for k in (1, 0):
        before = (F.col(f"a{k}") < F.col(f"b{k}")) | ((F.col(f"a{k}") == F.col(f"b{k}")) & before)
    return before


def similar_pairs(
    left: DataFrame,
    right,
    match: str = "global",
    recall: str = "complete",
    errors: int = BARCODE_ERRORS,
    on_bad_base: str = "drop",
    hot: int = HOT,
    crowd: int = CROWD,
) -> DataFrame:
    """(a, b, cost): pairs of distinct barcodes, a of left and b of right, within `errors` edits; equal ones included.

    Both inputs have a column barcode of BARCODE characters; right may be a NeighborIndex instead, which is joined as it is
    stored. Nulls, other lengths and letters but A, T, C, G and N
    meet nothing; with on_bad_base "fail" the first such barcode that isn't null ends the job. match "global" compares
    whole strings; "infix" asks whether a is near a substring of b, and has no
    cost. A task compares keys' barcodes in groups; those of over `hot` times `hot` pairs ask for one piece more. `crowd` is
    kept for callers and changes nothing. recall "complete" finds all pairs; "compat" only those where one of a's first three parts occurs in b at an
    offset but the last.
    """
    if match not in ("global", "infix") or recall not in ("complete", "compat") or on_bad_base not in ("drop", "fail"):
        raise ValueError(f"unknown mode: {match}, {recall}, {on_bad_base}")
    if not 0 <= errors < BARCODE // PART:
        raise ValueError(f"up to {BARCODE // PART - 1} errors leave one of the parts whole")
    if not isinstance(right, DataFrame):
        return measured(right.met(coded(left, on_bad_base), match, errors), match, recall, errors)
    others, same, _ = near_and_same(left, right, match, recall, errors, on_bad_base, hot)
    cost = F.lit(None) if match == "infix" else F.lit(0)
    return others.unionByName(same.select(F.col("barcode").alias("a"), F.col("barcode").alias("b"), cost.cast("int").alias("cost")))


def packed(records: DataFrame, on_bad_base: str = "drop") -> DataFrame:
    """(n, codes): the barcodes of records as bits.packed() writes them, written once as they are read several times.

    A run of records has each of them once, and what it has several times once more.
    """
    rows = fit(records, on_bad_base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            for planes, at in [(p, at) for p in (meet.unique(rows), meet.twice(rows)) for at in range(0, len(p[0]), RUN // 2)]:
                part = [p[at : at + RUN // 2] for p in planes]
                yield pa.RecordBatch.from_arrays([pa.array([len(part[0])], pa.int32()), pa.array([bits.packed(part)], pa.binary())], ["n", "codes"])

        for batch in batches:
            held.append(bits.coded(batch.column(0)))
            n += batch.num_rows
            if n >= RUN:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    return settled(rows.mapInArrow(run, "n int, codes binary"), "codes")


def _blobs(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


DEALT = pa.schema([("block", pa.int32()), ("side", pa.string()), ("shift", pa.int32()), ("n", pa.int32()), ("codes", pa.binary())])
FOUND = pa.schema([("block", pa.int32()), ("n", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("cost", pa.binary())])


def near_and_same(
    left: DataFrame, right: DataFrame, match: str = "global", recall: str = "complete", errors: int = BARCODE_ERRORS,
    on_bad_base: str = "drop", hot: int = HOT,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """similar_pairs() in two: (a, b, cost) of those that differ, and (barcode) of those that left and right both have.

    Beside them (barcode) of those that several records of right have.

    A round takes a part: barcodes are dealt to blocks by its letters, those of right by each stretch in which it may lie, and a task
    compares what a block has (functions.meet). What a round shuffled goes before the next.
    """
    spark, twins = left.sparkSession, right is left
    once = twins and match == "global"  # it is symmetric
    one = packed(left, on_bad_base)
    other = one if twins else packed(right, on_bad_base)
    size = max(c.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for c in ({one, other} if not twins else [one]))
    blocks = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK))
    rounds = []
    for part in range(errors + 1):
        rounds.append(settled(_round(one, other, twins, part, match, errors, once, blocks, hot), "near"))
    every = reduce(DataFrame.unionByName, rounds)
    same, many = (rounds[0].filter(f"block = {k}").select("n", "a").mapInArrow(_spelled, "barcode string") for k in (SAME, MANY))
    near = every.filter("b is not null").groupBy("block").applyInArrow(_gathered(match == "infix", once), "a string, b string, cost int")
    if recall == "compat":
        near = near.filter(compat())
    return near, same, many


def _round(one: DataFrame, other: DataFrame, twins: bool, part: int, match: str, errors: int, once: bool, blocks: int, hot: int) -> DataFrame:
    """What meets by one part: FOUND, a's block by its letters; in the first round also, without b, what both sides have and
    what right has several times."""
    shifts = list(meet.moves(part, match, errors))

    def deal(side: str, of: list[int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, codes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    planes = bits.unpacked(codes.as_buffer(), n)
                    for s in of:
                        keys = meet.letters(planes, part * PART + s, PART)
                        rows = [(k, side, s, len(at), bits.packed([p[at] for p in planes])) for k, at in meet.dealt(keys, blocks)]
                        yield _blobs(rows, DEALT)

        return run

    def compare(table: pa.Table) -> pa.Table:
        held: dict[tuple[str, int], list] = {}
        for side, s, n, codes in zip(*[table.column(c).to_pylist() for c in ("side", "shift", "n", "codes")], strict=True):
            held.setdefault((side, s), []).append(bits.unpacked(codes, n))
        sets = {k: meet.unique([np.concatenate(x) for x in zip(*v, strict=True)]) for k, v in held.items()}
        none = [np.empty(0, np.uint64)] * bits.PLANES
        many = meet.twice([np.concatenate(x) for x in zip(*held.get(("b", 0), [none]), strict=True)])
        probe = sets.get(("b" if twins else "a", 0), none)
        entries = {s: planes for (side, s), planes in sets.items() if side == "b"}
        pairs, cost = meet.near(probe, entries, part, match, errors, once, meet.HOT if hot == HOT else hot * hot)
        rows = []
        a, b = pairs[: bits.PLANES], pairs[bits.PLANES :]
        for k, at in meet.dealt(a[0] ^ a[1] << meet.u(28), blocks):
            rows.append((k, len(at), bits.packed([p[at] for p in a]), bits.packed([p[at] for p in b]), cost[at].astype(np.uint8).tobytes()))
        if part == 0:
            both = probe if twins else meet.twice([np.concatenate(x) for x in zip(probe, entries.get(0, none), strict=True)])
            for k, planes in ((SAME, both), (MANY, many)):
                if len(planes[0]):
                    rows.append((k, len(planes[0]), bits.packed(planes), None, None))
        return pa.Table.from_batches([_blobs(rows, FOUND)] if rows else [], FOUND)

    kind = "block int, side string, shift int, n int, codes binary"
    rows = other.mapInArrow(deal("b", shifts), kind)
    if not twins:
        rows = rows.unionByName(one.mapInArrow(deal("a", [0]), kind))
    return rows.groupBy("block").applyInArrow(compare, "block int, n int, a binary, b binary, cost binary")


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n, codes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            planes = bits.unpacked(codes.as_buffer(), n)
            for at in range(0, n, SPELLED):
                yield pa.RecordBatch.from_arrays([bits.spelled([p[at : at + SPELLED] for p in planes])], ["barcode"])


def _gathered(infix: bool, once: bool):
    """The pairs of a block, each once, though several rounds found it."""

    def run(table: pa.Table) -> pa.Table:
        held = []
        for n, a, b, cost in zip(*[table.column(c).to_pylist() for c in ("n", "a", "b", "cost")], strict=True):
            held.append([*bits.unpacked(a, n), *bits.unpacked(b, n), np.frombuffer(cost, np.uint8).astype(np.uint64)])
        rows = meet.unique([np.concatenate(x) for x in zip(*held, strict=True)])
        a, b, cost = bits.spelled(rows[: bits.PLANES]), bits.spelled(rows[bits.PLANES : -1]), rows[-1].astype(np.int32)
        cost = pa.nulls(len(cost), pa.int32()) if infix else pa.array(cost)
        found = [pa.table([a, b, cost], names=["a", "b", "cost"])]
        if once:
            found.append(pa.table([b, a, cost], names=["a", "b", "cost"]))
        return pa.concat_tables(found)

    return run
