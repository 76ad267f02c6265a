"""Where a compressed file can be entered midway, and what is read from there.

A gzip file can be entered where one of its members begins, a Zstandard file at a frame, a bzip2 file at any block. A
generator here yields (place, chunks): the byte in which an entry begins, and its uncompressed bytes, for all entries
from the first one in a range to the file's end, in order; chunks are to be taken before the next entry. Marks of entries that occur in other data by chance don't decompress, and are passed over.
"""

from __future__ import annotations

import bz2
import zlib
from collections.abc import Iterator

#: Bytes that are read at once, and of an entry that are decompressed to see whether it is one.
READ, TRIED = 1 << 20, 1 << 16
GZIP, ZSTD = b"\x1f\x8b\x08", b"\x28\xb5\x2f\xfd"
#: What a bzip2 block begins with, what ends a stream, and how many bits either has.
BLOCK, STREAM_END, MARK_BITS = 0x314159265359, 0x177245385090, 48

Entries = Iterator[tuple[int, Iterator[bytes]]]


def places_of(f, mark: bytes, start: int, stop: int) -> Iterator[int]:
    """Where mark occurs in f, from start on and before stop."""
    f.seek(start)
    held, at = b"", start
    while at < stop and (data := f.read(READ)):
        held += data
        found = held.find(mark)
        while 0 <= found < stop - at:
            yield at + found
            found = held.find(mark, found + 1)
        keep = min(len(held), len(mark) - 1)
        at += len(held) - keep
        held = held[len(held) - keep :]
        f.seek(at + keep)


def _gzip() -> zlib._Decompress:
    return zlib.decompressobj(wbits=31)


def _zstd():
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj()


def entered(f, start: int, stop: int, mark: bytes, codec) -> Entries:
    """The members or frames of f from the first that begins at or after start, if it does before stop."""
    import zstandard

    bad = (zlib.error, zstandard.ZstdError)
    for place in places_of(f, mark, start, stop):
        f.seek(place)
        try:
            codec().decompress(f.read(TRIED))
        except bad:
            continue
        break
    else:
        return
    rest = b""
    f.seek(place)
    while True:

        def chunks(ahead: bytes) -> Iterator[bytes]:
            nonlocal rest, place
            one, data = codec(), ahead or f.read(READ)
            while data:
                out = one.decompress(data)
                place += len(data) - len(one.unused_data)
                if out:
                    yield out
                if one.eof if hasattr(one, "eof") else one.unused_data:
                    rest = one.unused_data
                    return
                data = f.read(READ)
            rest = b""

        begin, ahead = place, rest
        yield begin, chunks(ahead)
        if not rest:
            rest = f.read(READ)
        while rest[:1] == b"\0":  # padding between members
            place, rest = place + 1, rest[1:] or f.read(READ)
        if not rest:
            return


def _marks(data: bytes, base: int) -> list[tuple[int, bool]]:
    """(bit, whether a block begins there) of the marks that begin in data, whose first bit is bit `base` of the file."""
    found = []
    for mark, begins in ((BLOCK, True), (STREAM_END, False)):
        for shift in range(8):
            # the whole bytes that a mark has of which 8 - shift bits are in the byte before
            inner = (mark >> shift & (1 << 40) - 1).to_bytes(5, "big") if shift else mark.to_bytes(6, "big")
            at = data.find(inner)
            while at >= 0:
                bit = at * 8 - (8 - shift if shift else 0)
                if bit >= 0 and _bits(data, bit, MARK_BITS) == mark:
                    found.append((base + bit, begins))
                at = data.find(inner, at + 1)
    return sorted(found)


def _bits(data: bytes, bit: int, n: int) -> int:
    """n bits of data from one on; fewer at its end."""
    end = min(len(data) * 8, bit + n)
    number = int.from_bytes(data[bit // 8 : -(-end // 8)], "big") >> (-end % 8)
    return number & ((1 << (end - bit)) - 1)


def bzip2_entries(f, start: int, stop: int) -> Entries:
    """The blocks of f from the first that begins at or after start, if it does before stop.

    Each is made a stream of its own to be decompressed.
    """
    f.seek(start)
    held, base, marks, over, first = b"", start * 8, [], False, True  # held begins at bit base

    def more() -> None:
        nonlocal held, marks, over
        data = f.read(READ)
        over = not data
        from_ = max(0, len(held) - 7)
        seen = {m for m, _ in marks}
        held += data
        marks += [m for m in _marks(held[from_:], base + from_ * 8) if m[0] not in seen]
        marks.sort()

    while True:
        while not over and len(marks) < 2 and not (first and not marks and base + len(held) * 8 > (stop + 8) * 8):
            more()
        if not marks:
            return
        bit, begins = marks.pop(0)
        if not begins:
            continue
        if first and bit // 8 >= stop:
            return
        first = False
        while True:  # a mark within a block by chance makes what is before it no block
            while not marks and not over:
                more()
            end = marks[0][0] if marks else base + len(held) * 8
            try:
                out = _block(_bits(held, bit - base, end - bit), end - bit)
                break
            except (OSError, ValueError, EOFError):
                if not marks:
                    raise
                marks.pop(0)
        yield bit // 8, iter([out])
        keep = (end - base) // 8
        held, base = held[keep:], base + keep * 8


def _block(bits: int, n: int) -> bytes:
    crc = bits >> (n - MARK_BITS - 32) & 0xFFFFFFFF
    whole = ((bits << MARK_BITS | STREAM_END) << 32) | crc
    size = n + MARK_BITS + 32
    whole <<= -size % 8
    one = bz2.BZ2Decompressor()
    out = one.decompress(b"BZh9" + whole.to_bytes(-(-size // 8), "big"))
    if not one.eof:
        raise EOFError("no whole block")
    return out


def entries(f, suffix: str, start: int, stop: int) -> Entries:
    """The entries of a file with one of the suffixes .gz, .bz2 and .zst; none if none begins from start on and before stop."""
    if suffix == ".bz2":
        return bzip2_entries(f, start, stop)
    return entered(f, start, stop, *((GZIP, _gzip) if suffix == ".gz" else (ZSTD, _zstd)))
