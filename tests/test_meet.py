import random

import numpy as np
import pytest

from strandloom.functions import bits, meet
from tests.test_index import code, family


def planes(barcodes):
    return [np.array(p).astype(np.uint64) for p in code(barcodes)]


@pytest.mark.parametrize("match", ["global", "infix"])
@pytest.mark.parametrize("hot", [meet.HOT, 30])
def test_parts_and_pieces_lose_no_near_pair(match, hot, monkeypatch):
    """All near pairs, also where keys are crowded and where a third piece is asked for; each once in a round."""
    monkeypatch.setattr(meet, "CROWD", 60)
    rng = random.Random(2)
    tails = ["".join(rng.choice("ACGT") for _ in range(6)) for _ in range(60)]
    d = sorted({*family(3, 60), *family(4, 40, "ACGTACGTAAC"), *[("GATTACA" * 5)[:30] + t for t in tails], "ACGTN" * 7 + "A", "T" * 36, "AC" * 18})
    a, n = planes(d), len(d)
    i, k = np.divmod(np.arange(n * n), n)
    cost = bits.edit_costs([p[i] for p in a], [p[k] for p in a], match == "infix")
    want = {(x, y): c for x, y, c in zip(i, k, cost, strict=True) if c <= 3 and x != y}
    place = {tuple(map(int, row)): x for x, row in enumerate(zip(*a, strict=True))}
    got = {}
    for part in range(4):
        rows, costs = meet.near(a, dict.fromkeys(meet.moves(part, match), a), part, match, 3, False, hot)
        found = [(place[tuple(map(int, r[:3]))], place[tuple(map(int, r[3:]))]) for r in zip(*rows, strict=True)]
        assert len(found) == len(set(found))
        got |= dict(zip(found, costs, strict=True))
    assert got == want and len(want) > 1000


def test_barcodes_take_nine_bytes():
    for d, size in ((family(5, 50), 9), ([*family(5, 50), "N" + "A" * 35], 14)):
        data = bits.packed(planes(d))
        assert len(data) == size * len(d)
        assert bits.spelled(bits.unpacked(data, len(d))).to_pylist() == d


def test_pieces_cover_what_they_must():
    for part in range(4):
        _, of = meet.pieces(part)
        assert min(size for _, size in of) >= 6
        third = meet.third_pieces(part, of[0], weight=np.arange(36.0))
        taken = [x for at, size in [(9 * part, 9), of[0], *third] for x in range(at, at + size)]
        assert len(third) == 4 and len(taken) == len(set(taken))
