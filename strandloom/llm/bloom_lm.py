"""Language-model scoring: n-gram counts in a log-frequency Bloom filter, read back by membership probes.

A count is quantised to a level on a scale that is exact up to 8 and logarithmic beyond. An n-gram of level j is put in
the filter j times, as (n-gram, 1) to (n-gram, j); its level is read by probing 1, 2, ... until one isn't there. So
levels are never read too low, and too high with a chance of some 1.2 % a step. A member's bits lie in two words of one
line, so a probe is two reads, and at each level n-grams in the order of their hashes meet the lines in order. The filter
is cut into blocks by hash.
Workers get all blocks where a bound on broadcasts allows it; where there are more, the n-grams of each slice of text are
sent to their blocks, and their levels come back to the slice. Which way is taken changes no result.

Probabilities are smoothed recursively: p(w | h) = (c(hw) + mu p(w | shorter h)) / (c(h) + mu), where c(hw) is the least
and c(h) the greatest count of the level, so the probabilities after a history sum to 1 at most. mu is
chosen by the likelihood of all training texts, each token left out of the counts in turn.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.shingles import PLACE, SPLIT, mixed
from strandloom.session import stored

#: Words in an n-gram, at most; two to four.
ORDER = 2
#: Bits for each member of the filter; a line has eight words of 64 bits. A member sets some bits of a word in the first half of its
#: line and of one in the second: one in 85 or so of what isn't there seems to be.
BITS_A_MEMBER, LINE = 10, 512
#: The bits that a member may set in a word, three of 64.
MASKS = np.array([sum(1 << b for b in random.Random(i).sample(range(64), 3)) for i in range(2048)], np.uint64)
#: The lines of a level are those of the level below, turned by this part of 2^32.
TURN = 0x9E3779B1
#: Words of more bytes are hashed one by one.
LONG = 64
#: Levels from which on a task remembers what it read, and how many at most.
WORTH, MEMORY = 4, 1 << 18
#: N-grams that are probed at once, so that what is computed for them stays in the cache.
PROBED = 1 << 15
#: Blocks that are broadcast at once, in MB; a block has the n-grams of some PART_BYTES of text, and there are LEAST_PARTS at least.
FILTER_MB, PART_BYTES, LEAST_PARTS = 128, 4_000_000, 64
#: So many of the most frequent words are broadcast with their exact counts (16 bytes each); the rest are joined by shuffle.
FREQUENT = 1 << 20
#: Weights of the shorter history, in tokens, to choose from.
MU = tuple(8.0**i for i in range(7))
#: Bytes of text taken at once, in counting and in scoring.
LEARN_BYTES, SCORE_BYTES = 6_000_000, 2_000_000
#: The token that begins a text, which is never counted or scored, and the one that ends it: no word has such bytes.
BEGIN, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" ", b""))
LOW32 = np.uint64(0xFFFFFFFF)


def scale() -> np.ndarray:
    """The least count of each level; level 0 is count 0."""
    at = [0, 1]
    while at[-1] < 1 << 62:
        at.append(max(at[-1] + 1, at[-1] * 5 // 4))
    return np.array(at, np.int64)


LEAST = scale()
GREATEST = np.append(LEAST[1:] - 1, LEAST[-1])


def runs_of(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts have some `most` bytes; a longer text is a run of its own."""
    held = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    first = 0
    while first < batch.num_rows:
        before = held[first - 1] if first else 0
        end = min(batch.num_rows, max(first + 1, int(np.searchsorted(held, before + most, "right"))))
        yield first, end
        first = end


def hashed(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and its bytes: eight bytes of all words at a time, long words by xxhash."""
    words = words.cast(pa.large_binary())
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    data = np.append(data[: ends[-1]], np.zeros(8, np.uint8))
    eights = np.lib.stride_tricks.sliding_window_view(data, 8)
    size, start = np.diff(ends), ends[:-1]
    h = size.astype(np.uint64) * PLACE[6]
    left = np.flatnonzero((size > 0) & (size <= LONG))
    for at in range(0, LONG, 8):
        left = left[size[left] > at]
        if not len(left):
            break
        # bytes beyond the word are shifted out
        beyond = np.maximum(8 * (at + 8) - 8 * size[left], 0).astype(np.uint64)
        h[left] = mixed((h[left] ^ (eights[start[left] + at].view("<u8")[:, 0] << beyond)) + PLACE[at // 8])
    for i in np.flatnonzero(size > LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : ends[i + 1]])
    return h, size


@dataclass
class Tokens:
    """BEGIN, the words and END of some texts, one text after the other."""

    hashes: np.ndarray  # of the distinct tokens, in order
    which: np.ndarray  # the place there of each token
    place: np.ndarray  # of each token in its text, 0 for BEGIN
    first: np.ndarray  # where texts begin

    @classmethod
    def of(cls, texts: pa.Array) -> Tokens:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        words = lists.flatten().dictionary_encode()
        distinct, size = hashed(words.dictionary)
        # white space at either end of a text gives an empty word there
        code, real = words.indices.to_numpy(), size > 0
        keep = real[code]
        before = np.append(0, np.cumsum(keep))
        n = np.diff(before[lists.offsets.to_numpy()])
        hashes = np.concatenate([np.array([BEGIN, END]), distinct[real]])
        by_hash = np.argsort(hashes)
        rank = np.empty(len(hashes), np.int32)
        rank[by_hash] = np.arange(len(hashes), dtype=np.int32)
        first = np.cumsum(n + 2) - n - 2
        which = np.full(int(n.sum()) + 2 * len(n), rank[0])
        inner = np.ones(len(which), bool)
        inner[first] = inner[first + n + 1] = False
        which[inner] = rank[(np.cumsum(real) + 1)[code[keep]]]
        which[first + n + 1] = rank[1]
        place = np.arange(len(which)) - np.repeat(first, n + 2)
        return cls(hashes[by_hash], which, place, first)


def grams(seq: np.ndarray, order: int) -> list[np.ndarray]:
    """For n from 1 the hash of the n tokens up to each place; it means nothing where a text has fewer before it."""
    found = [seq]
    for n in range(1, order):
        longer = seq.copy()
        longer[1:] = mixed(found[-1][:-1] * PLACE[n % 8] + seq[1:])
        found.append(longer)
    return found


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """In the order of h, so that sorted hashes are in runs of one part."""
    return ((h >> SPLIT) * np.uint64(parts)) >> SPLIT


def spread_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Where h is in its part, in parts of 2^32, in the order of h."""
    return ((h >> SPLIT) * np.uint64(parts)) & LOW32


def spots_of(h: np.ndarray, spread: np.ndarray, level: int, lines: np.ndarray | np.uint64, start: np.ndarray | np.uint64) -> tuple[np.ndarray, ...]:
    """The two words that (h, level) has bits in, and the bits in each; its part's block has so many lines from `start` on."""
    line = start + (((spread + np.uint64(level * TURN % 2**32)) & LOW32) * lines >> SPLIT)
    bits = mixed(h + np.uint64(level * int(PLACE[5]) % 2**64))
    first = line << np.uint64(3) | bits & np.uint64(3)
    second = first ^ (bits >> np.uint64(2) & np.uint64(3) | np.uint64(4))
    nth = lambda shift: (bits >> np.uint64(shift) & np.uint64(len(MASKS) - 1)).view(np.int64)
    return first.view(np.int64), MASKS[nth(4)], second.view(np.int64), MASKS[nth(15)]


def block_of(h: np.ndarray, level: np.ndarray, parts: int) -> tuple[int, bytes]:
    """The number of bits, and the block that holds h up to its levels."""
    lines = max(1, -(-int(level.sum()) * BITS_A_MEMBER // LINE))
    words = np.zeros(lines * LINE // 64, np.uint64)
    spread = spread_of(h, parts)
    for j in range(1, int(level.max(initial=0)) + 1):
        some = level >= j
        h, level, spread = h[some], level[some], spread[some]
        first, a, second, b = spots_of(h, spread, j, np.uint64(lines), np.uint64(0))
        np.bitwise_or.at(words, first, a)
        np.bitwise_or.at(words, second, b)
    return lines * LINE, words.tobytes()


class Remembered:
    """Levels of a filter; of what took many probes the level is kept, up to a bound, as most of it comes again."""

    def __init__(self, held: Filter):
        self.held = held
        self.h, self.level = np.zeros(0, np.uint64), np.zeros(0, np.uint8)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The level of each h; they are distinct and in order."""
        level = np.zeros(len(h), np.uint8)
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            level = np.where(self.h[at] == h, self.level[at], level)
        unknown = np.flatnonzero(level == 0)
        level[unknown] = read = self.held.levels(h[unknown])
        new = unknown[read >= WORTH][: max(0, MEMORY - len(self.h))]
        if len(new):
            every = np.append(self.h, h[new])
            order = np.argsort(every, kind="stable")
            self.h, self.level = every[order], np.append(self.level, level[new])[order]
        return level


class Filter:
    """Blocks of some of `parts` parts, given as (part, bits, block), with so many bits in all."""

    def __init__(self, parts: int, total: int, blocks: Iterable[tuple[int, int, bytes]]):
        self.parts = parts
        self.lines, self.start = np.zeros(parts, np.uint64), np.zeros(parts, np.uint64)
        self.data, at = np.zeros(total // 64, np.uint64), 0
        for part, bits, block in blocks:
            words = np.frombuffer(block, np.uint64)
            self.lines[part], self.start[part] = bits // LINE, at // 8
            self.data[at : at + len(words)] = words
            at += len(words)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The level of each h, soonest if they are in order; 0 for those of other parts."""
        level = np.zeros(len(h), np.uint8)
        for a in range(0, len(h), PROBED):
            self._read(h[a : a + PROBED], level[a : a + PROBED])
        return level

    def _read(self, h: np.ndarray, level: np.ndarray) -> None:
        part = part_of(h, self.parts).view(np.int64)
        lines, start, spread = self.lines[part], self.start[part], spread_of(h, self.parts)
        alive = np.flatnonzero(lines)
        if len(alive) < len(h):
            h, lines, start, spread = h[alive], lines[alive], start[alive], spread[alive]
        for j in range(1, len(LEAST)):
            first, a, second, b = spots_of(h, spread, j, lines, start)
            on = (self.data[first] & a == a) & (self.data[second] & b == b)
            left = np.flatnonzero(on)
            if len(left) < len(h):
                alive, h, lines, start, spread = alive[left], h[left], lines[left], start[left], spread[left]
            if not len(left):
                break
            level[alive] = j


def summed(hashes: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and the sums of their counts."""
    h = np.frombuffer(b"".join(hashes), np.uint64)
    n = np.frombuffer(b"".join(counts), np.uint32)
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order].astype(np.int64)
    new = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    return h[new], np.add.reduceat(n, new) if len(new) else n


GATHERED = "part int, words binary, word_n binary, grams binary, gram_n binary"
MODEL = "part int, bits long, block binary, hashes binary, counts binary, words long, tokens long, spread array<long>"


def gathered(texts: DataFrame, order: int, parts: int) -> DataFrame:
    """For each slice of texts and part the distinct words and longer n-grams with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end in runs_of(batch, LEARN_BYTES):
                seen = Tokens.of(batch.column("text").slice(first, end - first))
                found = grams(seen.hashes[seen.which], order)
                longer = np.concatenate([found[n][seen.place >= n] for n in range(1, order)])
                counts = np.bincount(seen.which, minlength=len(seen.hashes))
                cut, edges = [], np.arange(1, parts, dtype=np.uint64)
                for h, n in ((seen.hashes, counts), np.unique(longer, return_counts=True)):
                    ends = np.searchsorted(part_of(h, parts), edges)
                    cut += [np.split(h, ends), np.split(n.astype(np.uint32), ends)]
                rows = [(p, *[x.tobytes() for x in four]) for p, four in enumerate(zip(*cut, strict=True)) if len(four[0]) or len(four[2])]
                kinds = [pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["part", "words", "word_n", "grams", "gram_n"],
                )

    return texts.select("text").mapInArrow(run, GATHERED)


def merged(table: pa.Table, parts: int) -> pa.Table:
    """One part of the model: its block of the filter, its words with exact counts, and how many words have each level."""
    h, n = summed(table["words"].to_pylist(), table["word_n"].to_pylist())
    g, m = summed(table["grams"].to_pylist(), table["gram_n"].to_pylist())
    every, count = np.concatenate([h, g]), np.concatenate([n, m])
    bits, block = block_of(every, np.searchsorted(LEAST, count, "right") - 1, parts)
    h, n = h[h != BEGIN], n[h != BEGIN]
    spread = np.bincount(np.searchsorted(LEAST, n, "right") - 1, minlength=1)
    row = [table["part"][0].as_py(), bits, block, h.tobytes(), n.tobytes(), len(h), int(n.sum()), spread.tolist()]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    names = [x.split()[0] for x in MODEL.split(", ")]
    return pa.table([pa.array([v], kind) for v, kind in zip(row, kinds, strict=True)], names)


class Model:
    """What is learnt from the text of all rows of `training`: a table of parts in the shared folder, and its sums."""

    def __init__(self, training: DataFrame, order: int = ORDER, filter_mb: float = FILTER_MB, frequent: int = FREQUENT):
        if not 2 <= order <= 4:
            raise ValueError("n-grams have two to four words")
        self.order = order
        size = training.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.parts = max(LEAST_PARTS, -(-size // PART_BYTES))
        rows = gathered(training, order, self.parts)
        parts = self.parts
        self.table = stored(rows.groupBy("part").applyInArrow(lambda table: merged(table, parts), MODEL), "model")
        sums = self.table.agg(F.sum("words"), F.sum("tokens"), F.sum("bits")).first()
        self.words, self.tokens, self.bits = (x or 0 for x in sums)
        spread = self.table.select(F.posexplode("spread").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n"))
        held, self.cut = 0, len(LEAST)  # words of this level and above are broadcast
        for r in sorted(spread.collect(), reverse=True):
            held += r.n
            if held > frequent:
                break
            self.cut = r.level
        # hashes are spread evenly, so equal runs of parts have about as many bits
        passes = min(max(1, -(-self.bits // int(filter_mb * 8e6))), self.parts)
        edges = [self.parts * k // passes for k in range(passes + 1)]
        self.runs = [(a, b - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def filter_of(self, first: int, last: int) -> Filter:
        """The blocks of these parts, filled in one by one."""
        rows = self.table.filter(F.col("part").between(first, last)).select("part", "bits", "block")
        total = rows.agg(F.sum("bits")).first()[0] or 0
        return Filter(self.parts, total, ((r.part, r.bits, r.block) for r in rows.toLocalIterator()))

    def frequent_words(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes and exact counts of the words from the level `cut` on."""
        least = LEAST[self.cut] if self.cut < len(LEAST) else 1 << 62

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for h, n in _words(batches):
                keep = n >= least
                yield pa.RecordBatch.from_arrays([pa.array([h[keep].tobytes()], pa.binary()), pa.array([n[keep].tobytes()], pa.binary())], ["h", "n"])

        rows = self.table.select("hashes", "counts").mapInArrow(run, "h binary, n binary").collect()
        h, n = (np.frombuffer(b"".join(bytes(r[k]) for r in rows), kind) for k, kind in (("h", np.uint64), ("n", np.int64)))
        order = np.argsort(h)
        return h[order], n[order]

    def rare_words(self) -> DataFrame:
        """(hash, n) of the other words."""
        least = LEAST[self.cut] if self.cut < len(LEAST) else 1 << 62

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for h, n in _words(batches):
                keep = n < least
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(n[keep])], ["hash", "n"])

        return self.table.select("hashes", "counts").mapInArrow(run, "hash long, n long")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for h, n in zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            yield np.frombuffer(h, np.uint64), np.frombuffer(n, np.int64)


def levels_read(seen: Tokens, order: int, held: list[Remembered]) -> np.ndarray:
    """For each n, level of the n-gram up to each token (0 where a text has fewer); `held` has the filter for each n."""
    level = np.zeros((order, len(seen.which)), np.uint8)
    level[0] = held[0].levels(seen.hashes)[seen.which]
    for n, h in enumerate(grams(seen.hashes[seen.which], order)[1:], 1):
        whole = np.flatnonzero(seen.place >= n)
        distinct, back = np.unique(h[whole], return_inverse=True)
        level[n, whole] = held[n].levels(distinct)[back]
    return level


def every_gram(seen: Tokens, order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The distinct n-grams of all n in order, for each n the places that have one, and which of all each of these has."""
    found = grams(seen.hashes[seen.which], order)
    whole = [np.flatnonzero(seen.place >= n) for n in range(order)]
    every, back = np.unique(np.concatenate([h[w] for h, w in zip(found, whole, strict=True)]), return_inverse=True)
    return every, whole, back


SLICES = "slice long, doc_id array<long>, learnt array<boolean>, text array<string>"


def sliced(rows: DataFrame) -> DataFrame:
    """Rows of SCORE_BYTES of texts each, named by the number of their first row; further ones follow in the array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, end in runs_of(batch, SCORE_BYTES):
                names = ["doc_id", "learnt", "text"]
                cells = [pa.array([batch.column(c).slice(first, end - first).to_pylist()], pa.list_(batch.schema.field(c).type)) for c in names]
                yield pa.RecordBatch.from_arrays([pa.array([row]), *cells], ["slice", *names])
                row += end - first

    return rows.mapInArrow(run, SLICES)


def sent_levels(slices: DataFrame, model: Model) -> DataFrame:
    """(slice, part, levels) of the distinct n-grams of each slice, in their order; each n-gram is looked up at its block."""
    order, parts = model.order, model.parts

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                every, _, _ = every_gram(Tokens.of(batch.column("text").slice(i, 1).flatten()), order)
                each = np.split(every, np.searchsorted(part_of(every, parts), np.arange(1, parts, dtype=np.uint64)))
                some = [p for p in range(parts) if len(each[p])]
                columns = [pa.array([batch.column("slice")[i].as_py()] * len(some)), pa.array(some, pa.int32()), pa.array([each[p].tobytes() for p in some], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["slice", "part", "hashes"])

    def look(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        cells = asked["hashes"].to_pylist()
        distinct, back = np.unique(np.frombuffer(b"".join(cells), np.uint64), return_inverse=True)
        found = [(r["part"], r["bits"], r["block"]) for r in blocks.to_pylist()] if cells else []
        level = Filter(parts, sum(r[1] for r in found), found).levels(distinct)[back] if found else np.zeros(len(back), np.uint8)
        ends = np.cumsum([0, *(len(x) // 8 for x in cells)])
        levels = [level[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({"slice": asked["slice"], "part": asked["part"], "levels": pa.array(levels, pa.binary())})

    asked = slices.select("slice", "text").mapInArrow(ask, "slice long, part int, hashes binary")
    blocks = model.table.select("part", "bits", "block")
    return asked.groupBy("part").cogroup(blocks.groupBy("part")).applyInArrow(look, "slice long, part int, levels binary")


def combinations(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of one of each combination of small numbers, and for each place which of these it has."""
    code, size = np.zeros(len(columns[0]), np.int64), 1
    for x in columns:
        most = int(x.max(initial=0)) + 1
        code, size = code * most + x, size * most
    if size > 4_000_000:
        _, some, back = np.unique(code, return_index=True, return_inverse=True)
        return some, back
    at = np.full(size, -1)
    at[code] = np.arange(len(code))
    return at[at >= 0], (np.cumsum(at >= 0) - 1)[code]


def log_probabilities(level: np.ndarray, place: np.ndarray, total: int, distinct: int, mu: np.ndarray, left_out: bool) -> np.ndarray:
    """log10 of each token's smoothed probability, a row for each mu; with left_out from counts that are less by the token itself.

    level has a column for each token, of the levels of the n-grams that end there and, below, those of their histories.
    """
    order, less = len(level) // 2, int(left_out)
    count = lambda scale, x: np.maximum(scale[x] - less, 0).astype(float)
    p = (count(LEAST, level[0]) + 0.5) / (max(total - less, 0) + 0.5 * (distinct + 1))
    p = np.repeat(p[None, :], len(mu), 0)
    for n in range(1, order):
        here = np.flatnonzero((place >= n) & (level[order + n] > 0))
        seen = count(GREATEST, level[order + n, here])
        both = np.minimum(count(LEAST, level[n, here]), seen)
        p[:, here] = (both + mu[:, None] * p[:, here]) / (seen + mu[:, None])
    return np.log10(p)


SCORED = (
    "doc_id long, row long, n_tokens long, n_frequent long, base double, rare array<long>, times array<long>, "
    "scores array<double>, left_out array<double>"
)


def score(docs: DataFrame, model: Model, training: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row of docs; `training` says which the model has learnt.

    Tokens are the runs of other characters than the six ASCII white spaces, A-Z lower-cased, and one end; a null text is
    an empty one, of which the end alone is scored. base_score sums log10 of (c + 0.5) / (N + 0.5 (V + 1)) with exact
    counts; score sums the filter's smoothed log10 probabilities. Words are told apart by 64-bit hashes. Repeated rows and rows with a null doc_id are
    scored as any other; other columns take no part; with nothing learnt every token has base score 0 and
    the same score; an empty table gives an empty table; texts are whole.
    """
    spark, order = docs.sparkSession, model.order
    total, distinct, mu = model.tokens, model.words, np.array(MU)
    exact = spark.sparkContext.broadcast(model.frequent_words())
    unit = np.log10(total + 0.5 * (distinct + 1))

    def scored_rows(part: pa.RecordBatch, seen: Tokens, level: np.ndarray, row: int) -> pa.RecordBatch:
        known, counts = exact.value
        docs_here = part.num_rows
        token = np.flatnonzero(seen.place > 0)
        which, place = seen.which[token], seen.place[token]
        doc = np.repeat(np.arange(docs_here), np.diff(np.append(seen.first, len(seen.which))) - 1)
        starts = seen.first - np.arange(docs_here)
        # exact counts of frequent words; the others are left to a join
        h = seen.hashes
        at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
        hit = known[at] == h if len(known) else np.zeros(len(h), bool)
        share = np.where(hit, np.log10(np.where(hit, counts[at] if len(known) else 0, 0) + 0.5) - unit, 0)
        base = np.add.reduceat(share[which], starts)
        frequent = np.add.reduceat(hit[which].astype(np.int64), starts)
        other = np.flatnonzero(~hit[which])
        key, times = np.unique(doc[other] * len(h) + which[other], return_counts=True)
        cuts = np.searchsorted(key, np.arange(1, docs_here) * len(h))
        rare = [x.view(np.int64) for x in np.split(h[key % len(h)], cuts)]
        # levels decide a token's probability, so it is computed once for each combination of them
        read_levels = [*level[:, token], np.zeros(len(token), np.uint8), *level[: order - 1, token - 1]]
        some, back = combinations([np.minimum(place, order - 1), *read_levels])
        sums = []
        for out in (False, True):
            each = log_probabilities(np.stack(read_levels)[:, some], place[some], total, distinct, mu, out)
            sums.append(np.stack([np.add.reduceat(x[back], starts) for x in each], 1))
        learnt = np.array(part.column("learnt").to_pylist(), bool)
        sums[1][~learnt] = 0
        lists = lambda a: pa.array(list(a), pa.list_(pa.float64()))
        longs = lambda a: pa.array(list(a), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"), pa.array(np.arange(row, row + docs_here)),
                pa.array(np.bincount(doc, minlength=docs_here)), pa.array(frequent), pa.array(base),
                longs(rare), longs(np.split(times, cuts)), lists(sums[0]), lists(sums[1]),
            ],
            [x.split()[0] for x in SCORED.split(", ")],
        )

    def at_once(blocks):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            row = TaskContext.get().partitionId() << 33
            held = [Remembered(blocks.value) for _ in range(order)]
            for batch in batches:
                for first, end in runs_of(batch, SCORE_BYTES):
                    part = batch.slice(first, end - first)
                    seen = Tokens.of(part.column("text"))
                    yield scored_rows(part, seen, levels_read(seen, order, held), row)
                    row += end - first

        return run

    def by_slice(texts: pa.Table, sent: pa.Table) -> pa.Table:
        row = texts["slice"][0].as_py()
        part = pa.RecordBatch.from_arrays([texts[c].combine_chunks().flatten() for c in ("doc_id", "learnt", "text")], ["doc_id", "learnt", "text"])
        seen = Tokens.of(part.column("text"))
        _, whole, back = every_gram(seen, order)
        read = np.frombuffer(b"".join(sent.sort_by("part")["levels"].to_pylist()), np.uint8)[back]
        level = np.zeros((order, len(seen.which)), np.uint8)
        for n, each in enumerate(np.split(read, np.cumsum([len(w) for w in whole])[:-1])):
            level[n, whole[n]] = each
        return pa.Table.from_batches([scored_rows(part, seen, level, row)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), training.cast("boolean").alias("learnt"), "text")
    if len(model.runs) > 1:
        slices = stored(sliced(rows), "slices")
        levels = sent_levels(slices, model)
        scored = stored(slices.groupBy("slice").cogroup(levels.groupBy("slice")).applyInArrow(by_slice, SCORED), "scored")
    else:
        blocks = spark.sparkContext.broadcast(model.filter_of(*model.runs[0]))
        scored = stored(rows.mapInArrow(at_once(blocks), SCORED), "scored")
        blocks.destroy()
    exact.destroy()
    likely = scored.agg(*[F.sum(F.col("left_out")[i]) for i in range(len(MU))]).first()
    best = int(np.argmax([-np.inf if x is None else x for x in likely]))

    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("hash"), "x.times")
    met = rare.join(model.rare_words(), "hash").groupBy("row").agg(
        F.sum("times").alias("met"), F.sum(F.col("times") * (F.log10(F.col("n") + 0.5) - float(unit))).alias("share")
    )
    both = scored.drop("rare", "times", "left_out").join(met, "row", "left")
    n_known = F.col("n_frequent") + F.coalesce("met", F.lit(0))
    unseen = (F.col("n_tokens") - n_known) * float(np.log10(0.5) - unit)
    return both.select(
        "doc_id", "n_tokens", n_known.alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("share", F.lit(0.0)) + unseen).alias("base_score"), F.col("scores")[best].alias("score"),
    )


def held_out(doc_id: Column) -> Column:
    """Whether nothing may be learnt from a document; never of a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op11_log_frequency_bloom(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    training = ~held_out(F.col("doc_id"))
    out = score(docs, Model(docs.filter(training)), training)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
