"""Byte-level BPE: per task, DuckDB contracts token-position rows by recursion; an ordered aggregation decodes."""

from __future__ import annotations

import base64
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCAB = "byte_bpe_50k.tiktoken"
#: Words over so many bytes are contracted by the recursion with a key.
LONG_WORD = 64
#: Distinct words and bytes of them that one recursion takes; bounds the rows DuckDB holds. A longer word goes alone.
WORDS_A_QUERY, BYTES_A_QUERY = 30_000, 400_000
#: What DuckDB may take; a word longer than a query's bytes gets a quarter of a KB for each of its bytes besides.
MEMORY_MB = 150
#: Rows, characters of text and bytes of ids that are taken at once; a longer text is taken alone.
ROWS, TEXT_SLICE, IDS_SLICE = 4000, 12_000_000, 1_000_000
#: Pieces of text whose ids a Python worker keeps from one batch to the next; the rest are simply encoded again.
CACHED = 250_000
#: A space between two characters that aren't white space always begins a match of the pattern, so texts split there.
SAFE_SPLIT = re.compile(r"(?<=\S) (?=\S)")

#: Each step joins neighbouring tokens to the merge table and contracts, in every word that has a pair, the one of
#: least rank, the leftmost of equals. A word that has none is done. A row's place is the word's number
#: and, in the lower 10 bits, the position of the token's first byte.
CONTRACT = """
with recursive t(place, tok, done) as (
  select (w << 10) | pos, tok, false from start
  union all
  (with pairs as materialized (select place, tok, lead(tok) over o as nxt, lead(place) over o as gone
                               from t where not done window o as (order by place)),
   best as (select place >> 10 as w, min((m.rank::bigint << 20) | ((place & 1023) << 10) | (gone & 1023)) as b
            from pairs p join merges m on m.a = p.tok and m.b = p.nxt where p.place >> 10 = p.gone >> 10 group by 1)
   select p.place, case when p.place & 1023 = (b.b >> 10) & 1023 then (b.b >> 20)::int else p.tok end, b.b is null
   from pairs p left join best b on p.place >> 10 = b.w where b.b is null or p.place & 1023 <> b.b & 1023))
select place >> 10 as w, tok from t where done order by place
"""
#: The same for long words, whose earlier states would fill memory: a row's place, with 32 bits for the position, is its
#: key, so only the newest state is kept; a token contracted into the one before is null. Long words also repeat pairs.
#: Of a word's other pairs of the least rank those follow in the same step (`more`) that would be next anyhow: not
#: overlapping, and up to one that makes a pair of lesser rank with what stands beside it.
CONTRACT_LONG = """
with recursive t(place, tok) using key (place) as (
  select (w::bigint << 32) | pos, tok from start
  union all
  (with pairs as materialized (
     select place, tok, lead(tok) over o as nxt, lead(place) over o as gone from t where tok is not null window o as (order by place)),
   ranked as materialized (
     select place, gone, m.rank::bigint as rank from pairs p join merges m on m.a = p.tok and m.b = p.nxt where place >> 32 = gone >> 32),
   best as materialized (
     select w, (w << 32) + ((least >> 10) & 4294967295) as place, least & 1023 as size, least >> 42 as rank, (w << 32) + (last & 4294967295) as last
     from (select place >> 32 as w, min((rank << 42) + ((place & 4294967295) << 10) + (gone - place)) as least,
                  max(((1048575 - rank) << 32) + (place & 4294967295)) as last from ranked group by 1)),
   hits as materialized (
     select r.place, r.gone, r.rank, row_number() over o as i, r.place is distinct from lag(r.gone) over o as first
     from ranked r join best b on r.place >> 32 = b.w and r.rank = b.rank where b.place <> b.last window o as (order by r.place)),
   lowering as materialized (
     select h.place from hits h join pairs p on p.gone = h.place join merges m on m.a = p.tok and m.b = h.rank where m.rank < h.rank
     union all
     select h.place from hits h join pairs p on p.place = h.gone join merges m on m.a = h.rank and m.b in (p.nxt, h.rank) where m.rank < h.rank),
   more as materialized (
     select place, gone, rank from hits
     qualify (i - max(i) filter (first) over (order by place)) % 2 = 0
       and not coalesce(bool_or(place in (from lowering)) over (
         partition by place >> 32 order by place rows between unbounded preceding and 1 preceding), false))
   select p.place, case when p.place = b.place or k.place is not null then b.rank
                        when p.place <> b.place + b.size and g.gone is null then p.tok end
   from pairs p join best b on p.place >> 32 = b.w left join more k on p.place = k.place left join more g on p.place = g.gone))
select place >> 32 as w, tok from t where tok is not null order by place
"""
DECODE = """
select t.r, string_agg(v.hex, '' order by t.pos) as hex from tokens t join vocab v on v.id = t.id group by t.r
"""


class Odd(dict):
    """Whether white space, or nothing, stands beside a space that a piece was cut at; found once for each piece."""

    def __missing__(self, piece: str) -> bool:
        self[piece] = made = not piece or piece[0].isspace() or piece[-1].isspace()
        return made


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """The merge table of one vocabulary; its DuckDB, of one thread, lives from first use to close()."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        whole = [
            (self.ranks[t[:i]], self.ranks[t[i:]], r)
            for t, r in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        self.merges = np.array(whole, np.int32).reshape(-1, 3).T.copy()
        self.words: dict[str, bytes] = {}  # ids of pieces seen, as little-endian unsigned 32-bit integers
        self._db: duckdb.DuckDBPyConnection | None = None

    @property
    def db(self) -> duckdb.DuckDBPyConnection:
        if self._db is None:
            self._db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB"})
            self.put("merges", a=self.merges[0], b=self.merges[1], rank=self.merges[2])
            self.put("vocab", id=pa.array(self.ranks.values(), pa.int32()), hex=[t.hex() for t in self.ranks])
        return self._db

    def close(self) -> None:
        """Give back what a task needed; a worker may go on to other work."""
        self.words.clear()
        if self._db is not None:
            self._db.close()
            self._db = None

    def put(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"create or replace temp table {name} as select * from given").fetchall()
        self.db.unregister("given")

    def contract(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        # words of like length take like numbers of steps, each of which has a cost of its own
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        first_long = sum(len(w) <= LONG_WORD for w in words)
        for sql, some in ((CONTRACT, order[:first_long]), (CONTRACT_LONG, order[first_long:])):
            for run in slices(some, lambda i: len(words[i]), BYTES_A_QUERY):
                for at in range(0, len(run), WORDS_A_QUERY):
                    part = run[at : at + WORDS_A_QUERY]
                    for i, ids in zip(part, self.contracted(sql, [words[i] for i in part]), strict=True):
                        out[i] = ids
        return out

    def contracted(self, sql: str, words: list[bytes]) -> Iterator[bytes]:
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        w = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = (np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        if len(data) > BYTES_A_QUERY:  # one word that is longer than that
            self.db.execute(f"set memory_limit = '{MEMORY_MB + len(data) // 4000}MB'")
        self.put("start", w=w, pos=pos, tok=self.byte_id[data])
        got = self.db.execute(sql).fetchnumpy()
        ids = np.asarray(got["tok"]).astype("<u4")
        ends = np.cumsum(np.bincount(np.asarray(got["w"]), minlength=len(words)))
        for begin, end in zip([0, *ends], ends, strict=False):
            yield ids[begin:end].tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Texts are cut where a match always begins; all pieces but a text's first have lost their space."""
        if len(self.words) > CACHED:
            self.words.clear()
        known, find = self.words, self.pattern.findall
        fresh: Counter[str] = Counter()
        index: dict[str, int] = {}  # of the distinct matches
        at_odd, uneven, begins = Odd(), [], []
        for text in texts:
            parts = text.split(" ")
            new = [p for p in parts if p not in known]
            wide = len(parts) > 1 and (not parts[0] or parts[0][-1].isspace() or any(map(at_odd.__getitem__, new)))
            if wide:
                parts = SAFE_SPLIT.split(text)
                new = [p for p in parts if p not in known]
            uneven.append(wide)
            begins.append([index.setdefault(m, len(index)) for m in find(parts[0])])
            fresh.update(new)
        flat, sizes = array("i"), array("i")
        for p in fresh:
            matches = find(" " + p)
            sizes.append(len(matches))
            flat.extend([index.setdefault(m, len(index)) for m in matches])
        ids = self.contract([m.encode() for m in index])
        at = 0
        for p, n in zip(fresh, sizes, strict=True):
            known[p] = b"".join([ids[i] for i in flat[at : at + n]])
            at += n
        out = []
        for text, begin, wide in zip(texts, begins, uneven, strict=True):
            parts = SAFE_SPLIT.split(text) if wide else text.split(" ")
            out.append(b"".join([*[ids[i] for i in begin], *[known[p] for p in parts[1:]]]))
        for p, n in fresh.items():  # what came once is not worth its memory, and odd pieces must not pass for plain ones
            if n == 1 or at_odd[p]:
                del known[p]
        return out

    def decode(self, rows: list[bytes]) -> list[bytes]:
        sizes = np.array([len(r) // 4 for r in rows])
        ids = np.frombuffer(b"".join(rows), "<u4").astype(np.int32)
        r = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
        pos = (np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        self.put("tokens", r=r, pos=pos, id=ids)
        out = [b""] * len(rows)
        for i, text in self.db.execute(DECODE).fetchall():
            out[i] = bytes.fromhex(text)
        return out


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker and vocabulary."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def close_codecs() -> None:
    for used in _CODECS.values():
        used.close()


def slices(values: list, size, most: int) -> Iterator[list]:
    """Runs of values whose sizes sum to about `most` at the most; a larger value is a run of its own."""
    run, total = [], 0
    for v in values:
        if run and total + size(v) > most:
            yield run
            run, total = [], 0
        run.append(v)
        total += size(v)
    if run:
        yield run


def _mapped(df: DataFrame, steps: list[tuple], drop: tuple[str, ...] = ()) -> DataFrame:
    """df with binary columns made batch by batch: steps has (column, name, function of a list of values, values' size).

    All steps of a batch run in one Python worker.
    """
    made_here = [name for _, name, *_ in steps]  # a column of such a name is replaced
    names = [*[c for c in df.columns if c not in drop and c not in made_here], *made_here]

    def made(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for column, name, of, most in steps:
                parts = slices(columns[column].to_pylist(), lambda v: len(v or ""), most)
                columns[name] = pa.array([x for part in parts for x in of(part)], pa.binary())
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for whole in batches:
                yield from made(whole)
        finally:
            close_codecs()

    fields = {f.name: f for f in df.schema.fields} | {n: T.StructField(n, T.BinaryType()) for _, n, *_ in steps}
    return df.mapInArrow(run, T.StructType([fields[n] for n in names]))


def _encoder(path: str, pattern: str):
    return lambda part: codec(path, pattern).encode([x or "" for x in part])


def _decoder(path: str, pattern: str):
    return lambda part: codec(path, pattern).decode([x or b"" for x in part])


def encode(
    df: DataFrame, column: str, to: str, path: str | None = None, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """df with the binary column `to`: the ids of df[column] as little-endian unsigned 32-bit integers.

    Each match of the pattern is encoded separately, without special tokens. A null text counts as empty and has no
    ids; repeated rows and other columns pass through; an empty table gives an empty table; no text is cut. A match takes
    some 250 bytes of memory for each of its own, whatever its length.
    """
    return _mapped(df, [(column, to, _encoder(path or public_tokenizers.path(VOCAB), pattern), TEXT_SLICE)])


def decode(
    df: DataFrame, column: str, to: str, path: str | None = None, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """df with the binary column `to`: the bytes that the ids of df[column] stand for; null counts as no ids."""
    return _mapped(df, [(column, to, _decoder(path or public_tokenizers.path(VOCAB), pattern), IDS_SLICE)])


def round_trip(
    df: DataFrame, column: str, ids: str, decoded: str, path: str | None = None, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """df without `column`, with its ids and what they decode to: encode() and decode() in one pass."""
    path = path or public_tokenizers.path(VOCAB)
    steps = [(column, ids, _encoder(path, pattern), TEXT_SLICE), (ids, decoded, _decoder(path, pattern), IDS_SLICE)]
    return _mapped(df, steps, (column,))


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, "text", "ids", "decoded").select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
