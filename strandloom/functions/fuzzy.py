"""Fuzzy substring search: where in a text a pattern occurs with the fewest edits, at most k.

Of all occurrences the one of least cost counts, of those the leftmost start, of those the longest. A column of the dynamic
program is held in words of 64 bits, which say where it rises and falls; a step takes one character of many texts at once.
Long texts are cut in windows that overlap by as much as an occurrence can be long, so that all rows of a block have like widths.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOUND = T.StructType([T.StructField(name, T.IntegerType()) for name in ("start", "end", "cost")])
#: Characters of a block, and of a window besides its overlap.
CELLS, WINDOW = 8_000_000, 512
#: Patterns times their characters that are searched together; characters below LETTERS are looked up in a table.
MASKS, LETTERS = 1_000_000, 1024
WORD, ONE, NONE, EVERY = 64, np.uint64(1), np.uint64(0), ~np.uint64(0)


def points(strings: list[str]) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)


def masks(patterns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of the patterns, in order, and [word, pattern, character]: at which places of a pattern each is.

    Patterns have one length. A last character more stands for all others, which are nowhere.
    """
    known, code = np.unique(points(patterns), return_inverse=True)
    code = code.reshape(len(patterns), -1)
    found = np.zeros((-(-code.shape[1] // WORD), len(code), len(known) + 1), np.uint64)
    for i in range(code.shape[1]):
        found[i // WORD, np.arange(len(code)), code[:, i]] |= ONE << np.uint64(i % WORD)
    return known, found


def coded(texts: list[str], known: np.ndarray) -> np.ndarray:
    """Each character's place in `known`, its end for all others, of all texts one after the other; one more at the end."""
    flat = np.append(points(texts), np.uint32(0xFFFFFFFF))
    place = np.full(LETTERS + 1, len(known), np.int32)
    low = np.searchsorted(known, LETTERS)
    place[known[:low]] = np.arange(low)
    out = place[np.minimum(flat, LETTERS)]
    if low < len(known) and (rare := np.flatnonzero(flat >= LETTERS)).size:
        at = np.minimum(np.searchsorted(known, flat[rare]), len(known) - 1)
        out[rare] = np.where(known[at] == flat[rare], at, len(known))
    return out


def spread(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, step: int) -> np.ndarray:
    """[place, row] of runs of flat, onwards (step 1) or backwards (-1) from begin; what lies beyond a run's size is the last of flat."""
    out = np.empty((int(size.max(initial=0)), len(size)), flat.dtype)
    at, last = begin.copy(), len(flat) - 1
    for j in range(len(out)):
        np.take(flat, at, out=out[j], mode="clip")
        at += step
        at[size <= j + 1] = last
    return out


def scan(code: np.ndarray, size: np.ndarray, at: np.ndarray, which: np.ndarray, m: int, first: np.ndarray, anchored: np.ndarray | None):
    """(cost, end) for each text: the least edits between its pattern and what ends at some place, and the last such place.

    `which` tells a text's pattern; ends up to `first` don't count. Occurrences begin anywhere or, with `anchored`, at the
    text's first character, and must then have exactly those costs.
    """
    words, n, flat = len(at), code.shape[1], at.reshape(len(at), -1)
    row = which * at.shape[2] if at.shape[1] > 1 else None
    up, down = np.full((words, n), EVERY), np.zeros((words, n), np.uint64)
    same, straight, across, rise, fall = (np.empty(n, np.uint64) for _ in range(5))
    score, edge = np.full(n, m), np.uint64(min(m - 1 - (words - 1) * WORD, WORD - 1))
    best, end = np.full(n, m), np.zeros(n, np.int64)
    target = best if anchored is None else anchored
    for j in range(len(code)):
        place = code[j] if row is None else row + code[j]
        rises = falls = None  # what the word below hands on
        for w in range(words):
            np.take(flat[w], place, out=same, mode="clip")
            np.bitwise_or(same, down[w], out=straight)
            if falls is not None:
                same |= falls
            np.bitwise_and(same, up[w], out=across)
            across += up[w]
            across ^= up[w]
            across |= same
            np.bitwise_or(across, up[w], out=rise)
            np.invert(rise, out=rise)
            rise |= down[w]
            np.bitwise_and(up[w], across, out=fall)
            last = edge if w == words - 1 else np.uint64(WORD - 1)
            rise_out, fall_out = rise >> last & ONE, fall >> last & ONE
            rise <<= ONE
            fall <<= ONE
            if rises is not None:
                rise |= rises
                fall |= falls
            elif anchored is not None:
                rise |= ONE
            np.bitwise_or(straight, rise, out=up[w])
            np.invert(up[w], out=up[w])
            up[w] |= fall
            np.bitwise_and(rise, straight, out=down[w])
            rises, falls = rise_out, fall_out
        score += rises.view(np.int64)
        score -= falls.view(np.int64)
        good = np.flatnonzero(score <= best if anchored is None else score == target)
        good = good[(j + 1 > first[good]) & (j < size[good])]
        best[good], end[good] = score[good], j + 1
    return best, end


def windows(size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(begin, first, end) of pieces of a text: ends in first to end are a piece's own, and it begins `overlap` before."""
    step = max(WINDOW, 4 * overlap)
    if size <= step + overlap:
        return [(0, 0, size)]
    return [(max(0, at - overlap), at, min(size, at + step)) for at in range(0, size, step)]


def blocks(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Places of sizes in runs of like size, of some CELLS characters."""
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        n = np.arange(1, len(order) - at + 1) * (sizes[order[at:]] + 1)
        to = at + max(1, int(np.searchsorted(n, CELLS, "right")))
        yield order[at:to]
        at = to


def search(patterns: list[str], texts: list[str], most: list[int]) -> np.ndarray:
    """Rows of (start, end, cost); cost is -1 where the pattern isn't found."""
    out = np.full((len(texts), 3), -1, np.int32)
    by_size: dict[int, list[int]] = defaultdict(list)
    for row, p in enumerate(patterns):
        if most[row] >= 0:
            by_size[len(p)].append(row)
    for m, every in by_size.items():
        if not m:  # nothing occurs everywhere, first at the start
            out[every] = 0
            continue
        letters = len(set().union(*{patterns[r] for r in every}))
        for part in range(0, len(every), n := max(1, MASKS // (letters + 1))):
            found_of(m, every[part : part + n], patterns, texts, most, out)
    return out


def found_of(m: int, rows: list[int], patterns: list[str], texts: list[str], most: list[int], out: np.ndarray) -> None:
    """Fill in the rows of out whose patterns have m characters."""
    distinct = list(dict.fromkeys(patterns[r] for r in rows))
    number = {p: i for i, p in enumerate(distinct)}
    which = np.array([number[patterns[r]] for r in rows])
    length = np.array([len(texts[r]) for r in rows])
    allowed = np.array([most[r] for r in rows])
    first = np.cumsum(length) - length  # of each text in flat
    known, at = masks(distinct)
    flat = coded([texts[r] for r in rows], known)
    # backwards: the last end in the reversed text is the leftmost start
    back = masks([p[::-1] for p in distinct])[1]
    cuts = np.array([(i, *cut) for i, n in enumerate(length.tolist()) for cut in windows(n, m + min(most[rows[i]], m))])
    least, reach = np.full(len(rows), m), np.zeros(len(rows), np.int64)
    for block in blocks(cuts[:, 3] - cuts[:, 1]):
        row, begin, own, end = cuts[block].T
        code = spread(flat, first[row] + length[row] - 1 - begin, end - begin, -1)
        cost, place = scan(code, end - begin, back, which[row], m, own - begin, None)
        place += begin
        order = np.lexsort((place, -cost))  # the last of a row is its best
        i, cost, place = row[order], cost[order], place[order]
        better = (cost < least[i]) | ((cost == least[i]) & (place >= reach[i]))
        least[i[better]], reach[i[better]] = cost[better], place[better]
    hit = np.flatnonzero(least <= allowed)
    # forwards: the longest stretch from there that costs as much
    start = length - reach
    for block in blocks(m + least[hit]):
        i = hit[block]
        size = np.minimum(m + least[i], length[i] - start[i])
        code = spread(flat, first[i] + start[i], size, 1)
        _, n = scan(code, size, at, which[i], m, np.zeros(len(i), np.int64), least[i])
        out[np.array(rows)[i]] = np.stack([start[i], start[i] + n, least[i]], 1)


def _frame(found: np.ndarray) -> pd.DataFrame:
    out = pd.DataFrame(found, columns=["start", "end", "cost"]).astype("Int32")
    out[found[:, 2] < 0] = pd.NA
    return out


@F.pandas_udf(FOUND)
def _find(text: pd.Series, pattern: pd.Series, most: pd.Series) -> pd.DataFrame:
    ok = text.notna() & pattern.notna() & most.notna()
    found = np.full((len(text), 3), -1, np.int32)
    found[ok.to_numpy()] = search(pattern[ok].tolist(), text[ok].tolist(), most[ok].astype(int).tolist())
    return _frame(found)


def fuzzy_find(text: Column, pattern: Column | str, most: Column | int) -> Column:
    """struct<start, end, cost>, its fields null where there is no occurrence or an input is null."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return _find(text, as_column(pattern), as_column(most))


def fuzzy_contains(text: Column, pattern: Column | str, most: Column | int) -> Column:
    return fuzzy_find(text, pattern, most)["cost"].isNotNull()


def register(spark: SparkSession) -> None:
    """Make fuzzy_find(text, pattern, most) known to SQL."""
    spark.udf.register("fuzzy_find", _find)
