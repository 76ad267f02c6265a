"""Barcodes as three 64-bit integers, in which bit i says of letter i: comparisons become a few operations on integers.

The letters A, C, G, T, N are 1 to 5; bit k of a letter's number is in plane k. No letter is 0, so what lies beyond an end
equals nothing.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.sequence import BARCODE, BARCODE_ERRORS, PART

LETTERS = "ACGTN"
PLANES = 3
#: Bases of the stretches by which pairs are screened.
GRAM = 2
#: Pairs that are measured together.
BLOCK = 16_384


def planes(barcode: Column) -> list[Column]:
    """The planes of a barcode of up to 63 letters."""
    found = []
    for k in range(PLANES):
        bits = "".join(str(n >> k & 1) for n in range(1, len(LETTERS) + 1))
        found.append(F.conv(F.translate(F.reverse(barcode), LETTERS, bits), 2, 10).cast("long"))
    return found


def spelled(of: list[np.ndarray], size: int = BARCODE) -> pa.Array:
    """The barcodes of given planes."""
    number = np.zeros((len(of[0]), size), np.uint8)
    for k, plane in enumerate(of):
        rows = np.ascontiguousarray(plane, "<u8").view(np.uint8).reshape(-1, 8)
        number |= np.unpackbits(rows, axis=1, count=size, bitorder="little") << np.uint8(k)
    data = np.frombuffer(f"?{LETTERS}".encode(), np.uint8)[number]
    ends = np.arange(len(number) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.string(), len(number), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])


def coded(barcodes: pa.Array, size: int = BARCODE) -> list[np.ndarray]:
    """The planes of strings of `size` known letters."""
    n, first = len(barcodes), barcodes.offset
    ends = np.frombuffer(barcodes.buffers()[1], np.int32)[first : first + n + 1] if n else np.zeros(1, np.int32)
    data = np.frombuffer(barcodes.buffers()[2], np.uint8)[ends[0] : ends[-1]] if n else np.empty(0, np.uint8)
    number = np.zeros(256, np.uint8)
    number[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(1, len(LETTERS) + 1)
    number, out = number[data.reshape(n, size)], []
    for k in range(PLANES):
        found = np.zeros((n, 8), np.uint8)
        found[:, : -(-size // 8)] = np.packbits(number >> k & 1, axis=1, bitorder="little")
        out.append(found.view(np.uint64).reshape(n))
    return out


def packed(of: list[np.ndarray], size: int = BARCODE) -> bytes:
    """Planes of barcodes in nine bytes each, and five more where one of them has an N."""
    two, n = (~of[0] | of[2], (of[1] ^ ~of[0]) | of[2]), of[0] & of[2]
    low, high = np.uint64((1 << 32) - 1), np.uint64((1 << size - 32) - 1)
    top = lambda x: (x >> np.uint64(32) & high).astype(np.uint8)
    found = [*[(x & low).astype(np.uint32) for x in two], top(two[0]) | top(two[1]) << np.uint8(4)]
    found += [(n & low).astype(np.uint32), top(n)] if n.any() else []
    return b"".join(x.tobytes() for x in found)


def unpacked(data: bytes, n: int, size: int = BARCODE) -> list[np.ndarray]:
    """The planes of n barcodes that packed() has written."""
    word = lambda at: np.frombuffer(data, np.uint32, n, at).astype(np.uint64)
    byte = lambda at: np.frombuffer(data, np.uint8, n, at).astype(np.uint64)
    high, by, every = byte(8 * n), np.uint64(32), np.uint64((1 << size) - 1)
    one, two = word(0) | (high & np.uint64(15)) << by, word(4 * n) | high >> np.uint64(4) << by
    none = word(9 * n) | byte(13 * n) << by if len(data) > 9 * n else np.uint64(0)
    return [~one & every | none, one ^ two, one & two]


def edit_costs(a: list[np.ndarray], b: list[np.ndarray], infix: bool, size: int = BARCODE) -> np.ndarray:
    """Edits between each a and its b or, with `infix`, the stretch of b that is nearest.

    The whole column of the dynamic program is kept in two integers, the places at which it rises and falls; a step takes one letter
    of b. The rows of a block are taken together.
    """
    out = np.empty(len(a[0]), np.int64)
    one, every = np.uint64(1), ~np.uint64(0)
    for at in range(0, len(out), BLOCK):
        x, y = ([p[at : at + BLOCK].astype(np.uint64) for p in side] for side in (a, b))
        up, down = np.full(len(x[0]), every), np.zeros(len(x[0]), np.uint64)
        score = np.full(len(up), size)
        least = score.copy()
        for j in range(size):
            differ = np.zeros(len(up), np.uint64)
            for p, q in zip(x, y, strict=True):
                differ |= p ^ (np.uint64(0) - (q >> np.uint64(j) & one))
            same = ~differ
            straight = same | down
            across = (((same & up) + up) ^ up) | same
            rise, fall = down | ~(across | up), up & across
            last = np.uint64(size - 1)
            score = score + (rise >> last & one).astype(np.int64) - (fall >> last & one).astype(np.int64)
            rise = rise << one if infix else rise << one | one
            fall = fall << one
            up, down = fall | ~(straight | rise), rise & straight
            np.minimum(least, score, out=least)
        out[at : at + BLOCK] = least if infix else score
    return out


def piece(of: list[Column], at: int, size: int) -> Column:
    """`size` letters from place `at` on as one integer of 3 * size bits."""
    cut = [F.shiftrightunsigned(p, at).bitwiseAND((1 << size) - 1) for p in of]
    return reduce(Column.bitwiseOR, [F.shiftleft(c, k * size) for k, c in enumerate(cut)])


def offsets(match: str, errors: int = BARCODE_ERRORS) -> list[tuple[int, int]]:
    """(part, shift): which of a's parts of PART letters to look for in b, and how far from their own place.

    Take the first part i (from 0) such that parts 0 to i have i errors at most between them. There is one up to part
    `errors`, as there are no more errors than that. The parts before it have exactly i errors, so it has none and is whole, and errors - i are left for what
    follows. In global mode what lies before shifts it by i at most, and what follows must shift back:
    |shift| <= min(i, errors - i). In infix mode a may begin x letters inside b and end y before b's end; then
    shift = x + (insertions less deletions before) >= -i, and shift + (those after) = -y <= 0, so shift <= errors - i.
    """
    found = []
    for i in range(errors + 1):
        low, high = (-min(i, errors - i), min(i, errors - i)) if match == "global" else (-i, errors - i)
        found += [(i, s) for s in range(low, high + 1) if 0 <= i * PART + s <= BARCODE - PART]
    return found


def may_be_near(a: list[Column], b: list[Column], errors: int = BARCODE_ERRORS) -> Column:
    """Whether b has enough of a's stretches of GRAM letters within `errors` letters of their place.

    An edit spoils GRAM stretches at most, and all others are found in b, shifted by `errors` at most, as in offsets(). The
    expression is small, so that it is compiled together with the join.
    """
    lacking = None  # bit i: the stretch from i on is nowhere
    for shift in range(-errors, errors + 1):
        moved = [F.shiftrightunsigned(p, shift) if shift >= 0 else F.shiftleft(p, -shift) for p in b]
        differ = reduce(Column.bitwiseOR, [x.bitwiseXOR(y) for x, y in zip(a, moved, strict=True)])
        here = reduce(Column.bitwiseOR, [F.shiftrightunsigned(differ, k) if k else differ for k in range(GRAM)])
        lacking = here if lacking is None else lacking.bitwiseAND(here)
    stretches = BARCODE - GRAM + 1
    return F.bit_count(lacking.bitwiseAND((1 << stretches) - 1)) <= GRAM * errors
