"""Personal data: what the patterns find, and what a bidirectional LSTM with CRF transitions finds besides."""

from __future__ import annotations

import random
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.tagger import Tagger, char_ids

KINDS = ["email", "ip", "card", "phone"]
LOCAL = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match never begins inside a run of digits that it could begin earlier in; saying so keeps the search linear.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Training sees the windows of at most so many documents that hold a digit or @, those of least hash: so many of each, of so many
#: characters.
SAMPLE_DOCS, SAMPLE_WINDOWS, LEARN = 700, 6, 128
#: Labelled spans are also learnt in worn forms: fixed lists of what stands for @, for the dots, and between the digits.
WORN = {
    "at": [" at ", " AT ", "(at)", "[at]", " (at) ", " [at] ", " @ "],
    "dot": [".", " dot ", " DOT ", "[.]", "(dot)", "[dot]", " . "],
    "ip": ["[.]", " . ", "(.)", " dot ", "[dot]", ", "],
    "card": [".", "/", "_", " - ", "  ", ". "],
    "phone": [".", "/", " / ", " . ", "_", "-"],
}

Span = tuple[int, int, int]  # (place in KINDS, start, end)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of a local part, @ and a dotted domain, from each @ outwards."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL))
        free = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[Span]:
    """What the contract's patterns find, by kind, then start; failing matches are dropped without another try."""
    out: list[Span] = []
    if "@" in text:
        out += [(0, *s) for s in emails(text)]
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def worn(kind: int, s: str, rng: random.Random, forms: dict[str, list[str]]) -> str:
    """A base span of KINDS[kind] written in another way, which the patterns need not find."""
    if kind == 0:
        local, domain = s.rsplit("@", 1)
        labels = domain.split(".")
        if rng.random() < 0.5:
            labels = [rng.choice(["mail", "web", "post", "corp", "uni"]) + str(rng.randrange(40)), rng.choice(["com", "org", "net", "de", "fr"])]
        return local + rng.choice(forms["at"]) + rng.choice(forms["dot"]).join(labels)
    sep, digits = rng.choice(forms[KINDS[kind]]), digits_of(s)
    if kind == 1:
        return sep.join(s.split("."))
    if kind == 2:
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    lead = rng.choice(["+", "00", "", "("])
    return lead + digits[:-7] + ")" * (lead == "(") + sep + digits[-7:-4] + sep + digits[-4:]


def decoy(rng: random.Random) -> str:
    """What looks like personal data and is none."""
    n = rng.randrange
    return rng.choice([
        f"{1900 + n(150)}-{n(12) + 1:02}-{n(28) + 1:02}", f"{n(28) + 1}.{n(12) + 1}.{1900 + n(150)}", f"{n(24)}:{n(60):02}:{n(60):02}",
        f"v{n(20)}.{n(20)}.{n(20)}", f"{n(1000)}.{n(100):02}", f"{n(10**9)}", f"{n(100)} at {n(100)}", "look at the dot", f"{n(10**6):,}",
        f"{rng.getrandbits(128):032x}", f"page {n(400)}", f"{n(100)} - {n(100)}",
    ])


def rewritten(text: str, rng: random.Random, forms: dict[str, list[str]], share: float = 0.8) -> tuple[str, list[Span]]:
    """The text with `share` of its base spans in worn forms and a decoy after each, and where all the spans then are."""
    out, spans, at, size = [], [], 0, 0
    for kind, start, end in sorted(base_spans(text), key=lambda s: s[1:]):
        if start < at:
            continue
        here = text[start:end]
        here = worn(kind, here, rng, forms) if rng.random() < share else here
        out += [text[at:start], here, " ", decoy(rng)]
        size += start - at
        spans.append((kind, size, size + len(here)))
        size += len(here) + 1 + len(out[-1])
        at = end
    return "".join([*out, text[at:]]), spans


def plausible(kind: int, s: str) -> bool:
    """Whether s can be of the kind at all: an exact check of what the tagger proposes."""
    numbers = re.findall("[0-9]+", s)
    n = sum(map(len, numbers))
    if kind == 0:
        return re.search(r"[A-Za-z0-9].*(@|\bat\b).*[A-Za-z0-9].*(\.|\bdot\b).*[A-Za-z]", s, re.I | re.S) is not None
    if kind == 1:
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    if kind == 2:
        return 13 <= n <= 19 and luhn("".join(numbers))
    return 9 <= n <= 15 and len(numbers) > 1


def added_spans(text: str, tags: np.ndarray, base: list[Span]) -> list[Span]:
    """Runs of one tag, trimmed, plausible for their kind and clear of every base span."""
    out: list[Span] = []
    if not tags.any():
        return out
    held = np.zeros(len(text) + 1, np.int64)
    for _, start, end in base:
        held[start + 1 : end + 1] = 1
    held = np.cumsum(held)  # how many characters before each place are in base spans
    edges = np.flatnonzero(np.diff(tags, prepend=0, append=0))
    for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        tag = int(tags[start])
        if not tag:
            continue
        while start < end and not text[start].isalnum() and text[start] not in "+(":
            start += 1
        while start < end and not text[end - 1].isalnum():
            end -= 1
        if start < end and held[end] == held[start] and plausible(tag - 1, text[start:end]):
            out.append((tag - 1, start, end))
    return out


def tag_texts(tagger: Tagger, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text."""
    out = []
    for text, tags in zip(texts, tagger.tags_of(texts), strict=True):
        base = base_spans(text)
        out.append((base, added_spans(text, tags, base)))
    return out


def labelled(text: str, spans: list[Span], rng: random.Random, most: int) -> list[tuple[bytes, bytes]]:
    """At most `most` windows of a text as character ids and tags (0: none, else the kind's place plus 1), those with spans first."""
    ids, gold = np.zeros(len(text) + LEARN, np.uint8), np.zeros(len(text) + LEARN, np.uint8)
    ids[: len(text)] = char_ids(text)
    places = []
    for kind, start, end in spans:
        gold[start:end] = kind + 1
        places.append(max(0, start - rng.randrange(LEARN // 2)))
    rng.shuffle(places)
    places = places[: most - 1] + [rng.randrange(len(text) + 1)]
    return [(ids[p : p + LEARN].tobytes(), gold[p : p + LEARN].tobytes()) for p in places]


def labelled_windows(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The bounded training sample, from base spans as they are and in worn forms."""
    order = (F.xxhash64("doc_id"), "doc_id")
    ids = docs.filter(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    ids = F.broadcast(ids.orderBy(*order).limit(SAMPLE_DOCS))  # at most SAMPLE_DOCS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                rng = random.Random(zlib.crc32(text.encode()))
                rows += labelled(text, base_spans(text), rng, SAMPLE_WINDOWS // 3)
                rows += labelled(*rewritten(text, rng, WORN), rng, SAMPLE_WINDOWS - SAMPLE_WINDOWS // 3)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], ["x", "y"])

    texts = docs.join(ids, "doc_id", "left_semi").select("text").filter(F.col("text").rlike("[0-9@]"))
    rows = texts.mapInArrow(run, "x binary, y binary").distinct()  # repeated rows give the same windows
    rows = rows.orderBy(F.xxhash64("x", "y"), "x", "y").limit(SAMPLE_DOCS * SAMPLE_WINDOWS).collect()
    both = [np.frombuffer(b"".join(bytes(r[i]) for r in rows), np.uint8).reshape(-1, LEARN) for i in (0, 1)]
    return both[0], both[1]


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and added of every row: spans as arrays of (kind, start, end) in code points, end exclusive.

    base has what the patterns find, by kind and start; added what the trained tagger finds clear of it: it learns base
    spans as they are and in worn forms, sees every window of every text, and takes one best path over the whole text
    from the merged emissions of its windows. What it proposes must be plausible for its kind (plausible()). A null or
    empty text has no spans; null doc_ids, repeated rows and texts of any length are taken like others; other columns
    take no part; an empty table gives an empty table. Without any digit or @ in the table nothing is learnt or added.
    """
    docs = docs.select("doc_id", "text")
    x, y = labelled_windows(docs)
    tagger = Tagger(len(KINDS) + 1)
    if len(x):
        tagger.fit(x, y)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = tag_texts(tagger, [t or "" for t in part.column("text").to_pylist()])
                spans = lambda k: [[{"kind": KINDS[n], "start": s, "end": e} for n, s, e in f[k]] for f in found]  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(spans(0), span), pa.array(spans(1), span)], ["doc_id", "base", "added"]
                )

    one = "array<struct<kind:string,start:int,end:int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, f"doc_id long, base {one}, added {one}"
    )


def op1_bilstm_crf(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    place = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    keyed = F.transform(
        F.concat("base", "added"),
        lambda s: F.struct(place(s).alias("n"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(text("base"), 256).alias("base_sha256"),
        text(F.array_sort(keyed)).alias("spans"),
    )
