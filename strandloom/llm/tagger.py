"""A character-level bidirectional LSTM with CRF transitions in numpy.

Arrays have the sequences of a batch as their last axis, so that gates are contiguous rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Character classes: the ASCII characters as they are, one class for all others, and 0 for padding.
CHARS = 130
HIDDEN = 6
#: Training takes so many steps whatever the size of the sample. Transitions stay within LIMIT of zero.
STEPS, BATCH, RATE, SEED, LIMIT, NOISE = 300, 96, 0.03, 11, 1.0, 0.02
#: A window begins every STRIDE characters; where two overlap, their emissions are faded into one another.
SIZE, STRIDE = 288, 256
FADE = SIZE - STRIDE
#: Windows that go through the network together, characters of texts that are tagged together, and cells of a decoding.
WINDOWS, CHARACTERS, CELLS = 2048, 400_000, 1 << 18
#: What a position that can't have a tag loses.
NEVER = np.float32(1e6)


def char_ids(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, points + 1, 129).astype(np.uint8)


def lstm(ids: np.ndarray, table: np.ndarray, u: np.ndarray, kept: list | None = None) -> np.ndarray:
    """States (H, T, B) from left to right of ids (T, B). table: gate inputs per character; kept gets what the way back needs.

    Gates are piecewise linear, a quarter of their input plus a half within 0 and 1, which costs a fifth of a sigmoid.
    """
    hidden = u.shape[0]
    scale = np.repeat(np.array([0.25, 0.25, 0.25, 1], table.dtype), hidden)
    rows, u = (table * scale).T, np.ascontiguousarray((u * scale).T)
    rows[: 3 * hidden] += 0.5
    rows = np.ascontiguousarray(rows)
    h = c = np.zeros((hidden, ids.shape[1]), table.dtype)
    out = np.empty((hidden, *ids.shape), table.dtype)
    for t, now in enumerate(ids):
        z = np.take(rows, now, axis=1, mode="clip")
        z += u @ h
        np.clip(z[: 3 * hidden], 0, 1, out=z[: 3 * hidden])
        i, f, o, g = z.reshape(4, hidden, -1)
        np.tanh(g, out=g)
        new = f * c
        new += i * g
        tc = np.tanh(new)
        if kept is not None:
            kept.append((h, c, i, f, o, g, tc))
        h, c = np.multiply(o, tc, out=out[:, t]), new
    return out


def slope(gate: np.ndarray) -> np.ndarray:
    """Of a piecewise linear gate, from its value."""
    return 0.25 * ((gate > 0) & (gate < 1))


def lstm_back(ids: np.ndarray, u: np.ndarray, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d_u = np.zeros_like(u)
    every = np.empty((len(ids), u.shape[1], ids.shape[1]), u.dtype)
    dh = dc = np.zeros_like(d_out[:, 0])
    for t in reversed(range(len(kept))):
        h, c, i, f, o, g, tc = kept[t]
        dh = dh + d_out[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = every[t]
        np.concatenate([dc * g * slope(i), dc * c * slope(f), dh * tc * slope(o), dc * i * (1 - g * g)], out=dz)
        d_u += h @ dz.T
        dh, dc = u @ dz, dc * f
    chosen = np.eye(CHARS, dtype=u.dtype)[ids.ravel()]
    return chosen.T @ every.transpose(0, 2, 1).reshape(len(chosen), -1), d_u


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


@dataclass
class Tagger:
    """Tag 0 is none. Before and after every text stands a position of tag 0."""

    tags: int
    params: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.params:
            rng = np.random.default_rng(SEED)
            draw = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
            bias = np.zeros(self.tags, np.float32)
            bias[0] = 2
            self.params = {
                "table": draw(CHARS, 4 * HIDDEN), "u": draw(HIDDEN, 4 * HIDDEN),
                "table_back": draw(CHARS, 4 * HIDDEN), "u_back": draw(HIDDEN, 4 * HIDDEN),
                "out": draw(2 * HIDDEN, self.tags), "bias": bias, "move": np.zeros((self.tags, self.tags), np.float32),
            }

    def emissions(self, ids: np.ndarray, kept: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tags, T, B) of ids (T, B), and the states (H, T, B) they come from, those from the left and those from the right."""
        p = self.params
        ahead = lstm(ids, p["table"], p["u"], kept and kept[0])
        back = lstm(ids[::-1], p["table_back"], p["u_back"], kept and kept[1])
        left, right = np.ascontiguousarray(p["out"][: len(ahead)].T), np.ascontiguousarray(p["out"][len(ahead) :].T)
        e = np.empty((len(left), *ids.shape), ahead.dtype)
        for t in range(len(ids)):  # products this small stay on one core
            e[:, t] = left @ ahead[:, t] + right @ back[:, -1 - t] + p["bias"][:, None]
        return e, ahead, back

    def gradients(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean negative log likelihood of gold (T, B) and its gradients."""
        p, n = self.params, ids.shape[1]
        kept: tuple[list, list] = ([], [])
        e, ahead, back = self.emissions(ids, kept)
        e = np.ascontiguousarray(e.transpose(1, 0, 2))
        steps, column, move = len(e), np.arange(n), p["move"]
        alpha, beta = np.empty_like(e), np.empty_like(e)
        alpha[0], beta[-1] = e[0] + move[0][:, None], move[:, 0][:, None]
        for t in range(1, steps):
            alpha[t] = logsum(alpha[t - 1][:, None] + move[:, :, None], 0) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = logsum(move[:, :, None] + (e[t + 1] + beta[t + 1])[None], 1)
        total = logsum(alpha[-1] + beta[-1], 0)
        share = np.exp(alpha + beta - total)
        d_move = np.zeros_like(move)
        d_move[0] += share[0].sum(1)
        d_move[:, 0] += share[-1].sum(1)
        pair = alpha[:-1, :, None] + move[:, :, None] + (e + beta - total)[1:, None]
        d_move += np.exp(pair).sum((0, 3))
        way = np.concatenate([np.zeros((1, n), np.int64), gold, np.zeros((1, n), np.int64)])
        np.subtract.at(d_move, (way[:-1], way[1:]), 1)
        score = np.take_along_axis(e, gold[:, None], 1).sum((0, 1)) + move[way[:-1], way[1:]].sum(0)
        d_e = share
        d_e[np.arange(steps)[:, None], gold, column] -= 1
        d_states = np.einsum("hk,tkb->htb", p["out"], d_e)
        half = len(ahead)
        table, u = lstm_back(ids, p["u"], kept[0], d_states[:half])
        table_back, u_back = lstm_back(ids[::-1], p["u_back"], kept[1], d_states[half:, ::-1])
        grads = {
            "table": table, "u": u, "table_back": table_back, "u_back": u_back,
            "out": np.einsum("htb,tkb->hk", np.concatenate([ahead, back[:, ::-1]]), d_e), "bias": d_e.sum((0, 2)), "move": d_move,
        }
        return float((total - score).mean()), {k: g / n for k, g in grads.items()}

    def fit(self, ids: np.ndarray, gold: np.ndarray) -> None:
        """Adam over rows of ids and gold (N, T)."""
        rng = np.random.default_rng(SEED)
        m = {k: np.zeros_like(x) for k, x in self.params.items()}
        v = {k: np.zeros_like(x) for k, x in self.params.items()}
        rows = np.concatenate([rng.permutation(len(ids)) for _ in range(-(-STEPS * BATCH // len(ids)))])
        for step in range(1, STEPS + 1):
            now = rows[(step - 1) * BATCH : step * BATCH]
            # some characters are others than they were, so that new ones among known ones confuse less
            seen = np.where(rng.random((len(now), ids.shape[1])) < NOISE, rng.integers(1, CHARS, (len(now), ids.shape[1])), ids[now])
            _, grads = self.gradients(seen.T.astype(np.uint8), gold[now].T.astype(np.int64))
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            rate = RATE * (1 - step / (STEPS + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grads.items():
                g = g * min(1, 5 / (size + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.params[k] = (self.params[k] - rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
            np.clip(self.params["move"], -LIMIT, LIMIT, out=self.params["move"])

    def slack(self) -> np.ndarray:
        """By how much a position's emission of tag 0 must exceed that of each other tag for every best path to have 0 there.

        Putting 0 in place of a tag changes two transitions, whatever stands around it; this is the most that can cost.
        """
        move = self.params["move"]
        return (move - move[:, :1]).max(0)[1:] + (move - move[:1]).max(1)[1:]

    def tags_of(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The tags of every character of each text: the best path over the whole text, with emissions from all its windows.

        Texts go together up to CHARACTERS; a longer one goes alone and takes some 40 bytes a character.
        """
        run: list[str] = []
        total = 0
        for text in texts:
            if run and total + len(text) > CHARACTERS:
                yield from self._tags_of(run)
                run, total = [], 0
            run.append(text)
            total += len(text)
        if run:
            yield from self._tags_of(run)

    def merged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Emissions (tags, positions) of the texts laid end to end, and where each begins; at least one padding ends each."""
        numbers = np.array([len(t) // STRIDE + 1 for t in texts])
        slots = numbers * STRIDE + FADE
        flat = np.zeros(slots.sum(), np.uint8)
        for at, t in zip(np.cumsum(slots) - slots, texts, strict=True):
            flat[at : at + len(t)] = char_ids(t)
        before = np.cumsum(numbers) - numbers
        text_of = np.repeat(np.arange(len(texts)), numbers)
        starts = np.arange(len(text_of)) * STRIDE + text_of * FADE
        first = np.arange(len(text_of)) == before[text_of]
        up = ((np.arange(FADE) + 0.5) / FADE).astype(np.float32)
        out = np.empty((self.tags, len(starts), STRIDE), np.float32)
        tail = np.zeros((self.tags, 1, FADE), np.float32)
        for at in range(0, len(starts), WINDOWS):
            here = slice(at, at + WINDOWS)
            e = self.emissions(np.ascontiguousarray(flat[starts[here, None] + np.arange(SIZE)].T))[0].transpose(0, 2, 1)
            out[:, here] = e[:, :, :STRIDE]
            joined = ~first[here]
            tails = np.concatenate([tail, e[:, :-1, STRIDE:]], 1)
            out[:, here][:, joined, :FADE] = e[:, joined, :FADE] * up + tails[:, joined] * (1 - up)
            tail = e[:, -1:, STRIDE:].copy()
        out = out.reshape(self.tags, -1)
        begins = before * STRIDE
        blank = np.ones(out.shape[1], bool)
        for begin, t in zip(begins, texts, strict=True):
            blank[begin : begin + len(t)] = False
        out[1:, blank] = -NEVER
        out[0, blank] = 0
        return out, begins

    def _tags_of(self, texts: list[str]) -> Iterator[np.ndarray]:
        e, begins = self.merged(texts)
        tags = self.best_path(e)
        for begin, t in zip(begins, texts, strict=True):
            yield tags[begin : begin + len(t)]

    def best_path(self, e: np.ndarray) -> np.ndarray:
        """The best tags of emissions (tags, positions), ties to the smaller tag.

        Where tag 0 is certain, the path falls apart: the stretches between such positions are decoded side by side.
        """
        certain = np.ones(e.shape[1], bool)
        for other, least in zip(e[1:], self.slack(), strict=True):
            certain &= (e[0] - other) > least
        tags = np.zeros(e.shape[1], np.uint8)
        edges = np.flatnonzero(np.diff(certain, prepend=True, append=True))
        start, size = edges[::2], edges[1::2] - edges[::2]
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            longest = size[order[at]]
            to = at + 1
            while to < len(order) and (to + 1 - at) * (longest := size[order[to]]) <= CELLS:
                to += 1
            rows, at = order[at:to], to
            place = np.arange(size[rows].max())
            inside = place[None, :] < size[rows][:, None]
            block = np.where(inside, e[:, np.minimum(start[rows][:, None] + place, e.shape[1] - 1)], -NEVER)
            block[0, ~inside] = 0
            found = self._viterbi(np.ascontiguousarray(block.transpose(2, 0, 1)))
            tags[(start[rows][:, None] + place)[inside]] = found.T[inside]
        return tags

    def _viterbi(self, e: np.ndarray) -> np.ndarray:
        """(T, B) of emissions (T, tags, B), between two positions of tag 0."""
        move = self.params["move"]
        best, came = e[0] + move[0][:, None], np.empty(e.shape, np.uint8)
        for t in range(1, len(e)):
            way = best[:, None] + move[:, :, None]
            came[t] = way.argmax(0)
            best = way.max(0) + e[t]
        tags = np.empty((len(e), e.shape[2]), np.uint8)
        tags[-1] = (best + move[:, 0][:, None]).argmax(0)
        column = np.arange(e.shape[2])
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = came[t][tags[t], column]
        return tags
