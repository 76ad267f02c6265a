"""Near pairs among the barcodes that one task holds, by sorted keys: a whole part, and a whole piece beside it.

Barcodes are bits (functions.bits). What two barcodes must share comes from counting errors: the part as in bits.offsets,
with exactly i errors before part i; the letters on one side of it are cut in one piece more than they can have errors, and of
the pieces, taken from the part outwards, the first j such that pieces 0 to j have j errors at most is whole, with exactly j
errors between it and the part. That bounds how far it lies from its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from strandloom.functions import bits
from strandloom.functions.sequence import BARCODE, BARCODE_ERRORS, PART

#: Letters of a piece that are used, and those a key has in all: with them a key has 32 bits.
PIECE, KEY = 7, PART + 7
#: Pairs that meet by a key from which on they are kept as a group; from which on a third piece must be whole.
CROWD, HOT = 40_000, 1 << 28
#: Pairs that are screened together, and measured together.
CHUNK, PAIRS = 1 << 16, 1 << 19
EVERY = np.uint64((1 << BARCODE) - 1)
LOW = np.uint64((1 << 32) - 1)
Planes = list[np.ndarray]


def u(n: int) -> np.uint64:
    return np.uint64(n)


def letters(of: Planes, at: int, size: int) -> np.ndarray:
    """`size` letters from place `at` on, two bits each: N is as T, so that equal letters have equal bits, and mostly no others."""
    mask = u((1 << size) - 1)
    return ((~of[0] | of[2]) >> u(at) & mask) << u(size) | (of[1] ^ ~of[0] | of[2]) >> u(at) & mask


def pieces(part: int, errors: int = BARCODE_ERRORS) -> tuple[bool, list[tuple[int, int]]]:
    """Whether they lie to the right of the part, and (place, size) of the pieces, from the part outwards."""
    left, right = part * PART, BARCODE - PART - part * PART
    n_left, n_right = part + 1, errors - part + 1
    if right / n_right >= left / n_left:
        edges = [left + PART + right * k // n_right for k in range(n_right + 1)]
        found = [(x, y - x) for x, y in zip(edges[:-1], edges[1:], strict=True)]
    else:
        edges = [left - left * k // n_left for k in range(n_left + 1)]
        found = [(y, x - y) for x, y in zip(edges[:-1], edges[1:], strict=True)]
    return right / n_right >= left / n_left, [(at, min(size, PIECE)) for at, size in found]


def moves(part: int, match: str, errors: int = BARCODE_ERRORS) -> dict[int, list[tuple[int, list[int]]]]:
    """By how far the part lies from its place: each piece's number with how far it may lie from its own."""
    to_right, of = pieces(part, errors)
    found: dict[int, list[tuple[int, list[int]]]] = {}
    for s in [s for i, s in bits.offsets(match, errors) if i == part]:
        for j, (at, size) in enumerate(of):
            beyond = (errors - part if to_right else part) - j  # errors left for what lies farther out
            low, high = s - j, s + j
            if to_right or match == "global":
                high = min(high, beyond)
            if not to_right or match == "global":
                low = max(low, -beyond)
            found.setdefault(s, []).append((j, [t for t in range(low, high + 1) if 0 <= at + t <= BARCODE - size]))
    return found


def reach(match: str, errors: int = BARCODE_ERRORS) -> int:
    """How far any letter of near barcodes may lie from its place: in global mode what shifts it must shift back."""
    return errors // 2 if match == "global" else errors


def third_pieces(part: int, piece: tuple[int, int], errors: int = BARCODE_ERRORS, weight: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(place, size) of errors + 1 pieces of the letters in neither; all errors are there, so one of them is whole.

    They are cut so that each has as much of the places' weight as can be, and are its weightiest PIECE letters.
    """
    weight = np.ones(BARCODE) if weight is None else weight + 0.01
    taken = sorted([(part * PART, PART), piece])
    edges = [0, *[x for at, size in taken for x in (at, at + size)], BARCODE]
    free = [(x, y) for x, y in zip(edges[::2], edges[1::2], strict=True) if y > x]
    n = [0] * len(free)
    for _ in range(errors + 1):
        best = [weight[x:y].sum() / (k + 1) if k < y - x else -1 for (x, y), k in zip(free, n, strict=True)]
        n[int(np.argmax(best))] += 1
    found = []
    for (x, y), k in zip(free, n, strict=True):
        sums = np.cumsum(weight[x:y])
        cuts = [x]
        for i in range(1, k):
            cut = x + int(np.searchsorted(sums, sums[-1] * i / k)) + 1
            cuts.append(min(max(cut, cuts[-1] + 1), y - (k - i)))
        found += list(zip(cuts, [*cuts[1:], y], strict=True)) if k else []
    starts = [(max(range(x, max(x, y - PIECE) + 1), key=lambda at: weight[at : at + PIECE].sum()), y) for x, y in found]
    return [(at, min(y - at, PIECE)) for at, y in starts]


def varied(planes: Planes) -> np.ndarray:
    """By place, how much the barcodes' letters tell apart, in bits."""
    out = np.empty(BARCODE)
    for at in range(BARCODE):
        share = np.bincount(letters(planes, at, 1).astype(np.int64), minlength=4) / max(1, len(planes[0]))
        out[at] = -(share[share > 0] * np.log2(share[share > 0])).sum()
    return out


def ordered(key: np.ndarray) -> np.ndarray:
    """Keys of 32 bits in order, each with its place in the lower half."""
    rows = key << u(32) | np.arange(len(key), dtype=np.uint64)
    rows.sort()
    return rows


def met(probe: np.ndarray, entry: np.ndarray, hot: int | None) -> tuple[Iterator[tuple[np.ndarray, np.ndarray]], tuple | None]:
    """(places of probes, of entries) that have a key in common, in runs; and those of keys by which over `hot` pairs meet,
    as (probes, their keys' numbers, entries, theirs)."""
    keys = probe >> u(32)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    if not len(first) or not len(entry):
        return iter(()), None
    known, n = keys[first], np.diff(np.append(first, len(keys)))
    asked = entry >> u(32)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    found = np.flatnonzero(known[at] == asked)
    at, entry = at[found], (entry[found] & LOW).astype(np.int64)
    probe = (probe & LOW).astype(np.int64)
    crowd = None
    if hot is not None:
        big = n * np.bincount(at, minlength=len(known)) > hot
        if big.any():
            number, theirs = np.cumsum(big) - 1, big[at]
            mine = np.repeat(big, n)
            crowd = probe[mine], np.repeat(number, n)[mine], entry[theirs], number[at[theirs]]
            at, entry = at[~theirs], entry[~theirs]

    def runs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ends, begin = np.cumsum(n[at]), 0
        while begin < len(at):
            done = ends[begin - 1] if begin else 0
            to = max(begin + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
            size = n[at[begin:to]]
            total = int(ends[to - 1] - done)
            place = np.repeat(first[at[begin:to]] - (np.cumsum(size) - size), size) + np.arange(total)
            yield probe[place], np.repeat(entry[begin:to], size)
            begin = to

    return runs(), crowd


def screened(a: Planes, b: Planes, errors: int, far: int) -> np.ndarray:
    """bits.may_be_near() of two bits a letter, of which none lies farther than `far`: where pairs may be near. What lies beyond an
    end may be found, too."""
    lacking, x, y = None, np.empty_like(a[0]), np.empty_like(a[0])
    for shift in range(-far, far + 1):
        move = np.right_shift if shift >= 0 else np.left_shift
        by = u(abs(shift))
        move(b[0], by, out=x)
        np.bitwise_xor(x, a[0], out=x)
        move(b[1], by, out=y)
        np.bitwise_xor(y, a[1], out=y)
        np.bitwise_or(x, y, out=x)
        np.right_shift(x, u(1), out=y)
        np.bitwise_or(x, y, out=x)
        if lacking is None:
            lacking = x.copy()
        else:
            np.bitwise_and(lacking, x, out=lacking)
    lacking &= u((1 << BARCODE - bits.GRAM + 1) - 1)
    return np.bitwise_count(lacking) <= bits.GRAM * errors


def _sorted(rows: Planes) -> tuple[Planes, np.ndarray]:
    """rows in order, and which of them but the first are as the one before."""
    order = np.lexsort(rows[::-1])
    rows = [r[order] for r in rows]
    again = np.ones(max(0, len(order) - 1), bool)
    for r in rows:
        again &= r[1:] == r[:-1]
    return rows, again


def distinct(of: list[np.ndarray]) -> np.ndarray:
    """The distinct numbers of several arrays."""
    rows = np.sort(np.concatenate([np.empty(0, np.uint64), *of]))
    return rows[np.append(True, rows[1:] != rows[:-1])] if len(rows) else rows


def unique(rows: Planes) -> Planes:
    if not len(rows[0]):
        return rows
    rows, again = _sorted(rows)
    return [r[np.append(True, ~again)] for r in rows]


def twice(rows: Planes) -> Planes:
    """What comes more than once, once."""
    rows, again = _sorted(rows)
    return unique([r[1:][again] for r in rows])


def less(a: Planes, b: Planes) -> np.ndarray:
    out = a[2] < b[2]
    for k in (1, 0):
        out = (a[k] < b[k]) | (a[k] == b[k]) & out
    return out


def dealt(key: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(block, places): keys dealt to n blocks by their hash, equal ones together."""
    block = key * u(0x9E3779B97F4A7C15) >> u(33)
    rows = block % u(n) << u(32) | np.arange(len(key), dtype=np.uint64)
    rows.sort()
    block, place = rows >> u(32), (rows & LOW).astype(np.int64)
    edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(rows)] if len(rows) else []
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        yield int(block[x]), place[x:y]


def near(a: Planes, b: dict[int, Planes], part: int, match: str, errors: int, once: bool, hot: int = HOT) -> tuple[Planes, np.ndarray]:
    """(the pairs' planes, a's and then b's; their costs): those of a and b that are near, differ, and meet by this part.

    b has, by how far the part lies from its place, the distinct barcodes among which a's part may be found there. With
    `once` only pairs whose first barcode is less are given. A pair comes once.
    """
    _, of = pieces(part, errors)
    code = lambda planes, at, j, t: ordered(
        letters(planes, at, PART) << u(2 * PIECE) | letters(planes, of[j][0] + t, of[j][1])
    )
    probe = [code(a, part * PART, j, 0) for j in range(len(of))]
    two = lambda planes: [~planes[0] | planes[2], planes[1] ^ ~planes[0] | planes[2]]  # noqa: E731  # as letters() has them
    found, far, kept, waiting, groups = [], reach(match, errors), [], 0, 0
    a2 = [p & EVERY for p in two(a)]

    def take(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        nonlocal kept, waiting
        for i, k in pairs:
            if once:
                right = less([p[i] for p in a], [p[k] for p in planes])
            else:
                right = np.zeros(len(i), bool)
                for p, q in zip(a, planes, strict=True):
                    right |= p[i] != q[k]
            i, k = i[right], k[right]
            may = screened([p[i] for p in a2], [p[k] for p in b2], errors, far)
            kept.append(i[may].astype(np.uint64) << u(32) | k[may].astype(np.uint64))
            waiting += len(kept[-1])
            if waiting > PAIRS:  # near pairs meet by many keys: they are measured once
                kept = [distinct(kept)]
                waiting = 0

    def measure(rows: np.ndarray) -> None:
        i, k = (rows >> u(32)).astype(np.int64), (rows & LOW).astype(np.int64)
        pairs = [*[p[i] for p in a], *[p[k] for p in planes]]
        cost = bits.edit_costs(pairs[: bits.PLANES], pairs[bits.PLANES :], match == "infix")
        close = cost <= errors
        found.append([*[r[close] for r in pairs], cost[close].astype(np.uint64)])

    def group(i: np.ndarray, k: np.ndarray, j: int) -> None:
        """All of i with all of k, which have a key in common, unless a group before had them all."""
        nonlocal groups
        before = mark_a[i[0]]
        if before and (mark_a[i] == before).all() and (mark_b[k] == before).all():
            return
        groups += 1
        if len(i) * len(k) <= hot:
            step = max(1, CHUNK // len(k))
            take((np.repeat(i[x : x + step], len(k)), np.tile(k, len(i[x : x + step]))) for x in range(0, len(i), step))
        else:
            x, y = [p[i] for p in a], [p[k] for p in planes]
            for at, size in third_pieces(part, of[j], errors, varied(x)):
                asked = ordered(letters(x, at, size))
                for r in range(-far, far + 1):
                    if 0 <= at + r <= BARCODE - size:
                        take((i[m], k[n]) for m, n in met(asked, ordered(letters(y, at + r, size)), None)[0])
        mark_a[i[mark_a[i] == 0]] = groups
        mark_b[k[mark_b[k] == 0]] = groups

    for s, planes in b.items():
        mark_a, mark_b, groups = np.zeros(len(a[0]), np.int32), np.zeros(len(planes[0]), np.int32), 0
        b2, kept, waiting = [p & EVERY for p in two(planes)], [], 0
        for j, shifts in moves(part, match, errors)[s]:
            for t in shifts:
                pairs, crowd = met(probe[j], code(planes, part * PART + s, j, t), min(hot, CROWD))
                take(pairs)
                if crowd is None:
                    continue
                i, mine, k, theirs = crowd
                at_i, at_k = (np.searchsorted(x, np.arange(mine[-1] + 2)) for x in (mine, theirs))
                for g in range(mine[-1] + 1):
                    group(i[at_i[g] : at_i[g + 1]], k[at_k[g] : at_k[g + 1]], j)
        rows = distinct(kept)
        for begin in range(0, len(rows), PAIRS):
            measure(rows[begin : begin + PAIRS])
    rows = unique([np.concatenate(x) for x in zip(*found, strict=True)]) if found else [np.empty(0, np.uint64)] * (2 * bits.PLANES + 1)
    return rows[:-1], rows[-1].astype(np.int64)
