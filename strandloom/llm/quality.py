"""Quality classifier: a byte-level convolutional network in numpy, trained here and run over whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes a filter sees, values a byte is embedded in, filters, and window starts in a chunk. Chunks overlap by WIDTH - 1.
WIDTH, EMBED, FILTERS, CHUNK = 6, 8, 16, 512
#: Training sees at most so many labelled documents of each label, those of least hash, and so many chunks of each,
#: spread over the whole document. Scoring always sees all chunks.
SAMPLE_DOCS, SAMPLE_CHUNKS = 1500, 4
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.01, 7
#: A document is kept from this score on.
KEEP = 0.7
ROWS = 8192


@dataclass
class Network:
    embed: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (WIDTH * EMBED, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (FILTERS,)
    out_bias: np.ndarray  # (1,)

    def windows(self, data: np.ndarray) -> np.ndarray:
        """The embedded bytes of each window, side by side; data ends with WIDTH - 1 bytes in which none starts."""
        e = np.ascontiguousarray(self.embed[data])
        n = len(data) - WIDTH + 1
        return np.lib.stride_tricks.as_strided(e, (n, WIDTH * EMBED), (e.strides[0], e.strides[1]))

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """One for each text: the mean of its chunks' logits, weighted by their window starts."""
        gap = b"\0" * (WIDTH - 1)
        data = np.frombuffer(b"".join(t + gap + b"\0" * (not t) for t in texts), np.uint8)
        sizes = np.array([max(len(t), 1) for t in texts])
        begins = np.cumsum(sizes + WIDTH - 1) - sizes - WIDTH + 1
        chunks = -(-sizes // CHUNK)
        doc = np.repeat(np.arange(len(texts)), chunks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        start = begins[doc] + nth * CHUNK
        weight = np.minimum(CHUNK, sizes[doc] - nth * CHUNK)
        pooled = np.empty((len(doc), FILTERS), np.float32)
        # chunks are taken in runs of about ROWS windows, each run from its first start to its last window
        at = 0
        while at < len(doc):
            to = max(at + 1, int(np.searchsorted(start, start[at] + ROWS)))
            first, last = start[at], start[to - 1] + weight[to - 1]
            z = self.windows(data[first : last + WIDTH - 1]) @ self.filters
            edges = np.stack([start[at:to] - first, start[at:to] + weight[at:to] - first], 1).ravel()
            pooled[at:to] = np.maximum.reduceat(z, edges[:-1], axis=0)[::2]
            at = to
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        return np.bincount(doc, z * weight, len(texts)) / np.bincount(doc, weight, len(texts))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -30, 30)))


NAMES = ("embed", "filters", "bias", "out", "out_bias")


def gradients(net: Network, data: np.ndarray, size: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, dict]:
    """The log loss of chunks weighted by share, and its gradients; these reach each filter at its best window alone.

    data has a row of CHUNK + WIDTH - 1 bytes for each chunk, of whose windows the first `size` count.
    """
    n = len(data)
    flat = np.append(data.ravel(), np.zeros(WIDTH - 1, np.uint8))
    z = (net.windows(flat) @ net.filters).reshape(n, -1, FILTERS)[:, :CHUNK]
    z[np.arange(CHUNK)[None, :] >= size[:, None]] = -np.inf
    best = z.argmax(axis=1)
    top = np.take_along_axis(z, best[:, None], 1)[:, 0] + net.bias
    on = np.maximum(top, 0)
    logit = np.clip(on @ net.out + net.out_bias, -30, 30)
    p = 1 / (1 + np.exp(-logit))
    loss = float(np.sum((np.log1p(np.exp(logit)) - y * logit) * share) / n)
    d = (p - y) * share / n
    d_top = d[:, None] * net.out * (top > 0)
    seen = data[np.arange(n)[:, None, None], best[:, :, None] + np.arange(WIDTH)]
    wide = net.embed[seen].reshape(n, FILTERS, -1)
    d_wide = (d_top[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
    d_embed = np.zeros_like(net.embed)
    np.add.at(d_embed, seen.ravel(), d_wide)
    return loss, {"embed": d_embed, "filters": np.einsum("nf,nfw->wf", d_top, wide), "bias": d_top.sum(0),
                  "out": on.T @ d, "out_bias": d.sum(keepdims=True)}


def train(chunks: list[bytes], labels: list[int], prior: float = 0.5) -> Network:
    """Fit by Adam on the log loss of chunks, weighted as if a share `prior` had label 1, whatever share the sample has."""
    rng = np.random.default_rng(SEED)
    f32 = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    net = Network(rng.standard_normal((256, EMBED)).astype(np.float32) * 0.5, f32(WIDTH * EMBED, FILTERS),
                  np.zeros(FILTERS, np.float32), f32(FILTERS), np.zeros(1, np.float32))
    y = np.array(labels, np.float32)
    if not 0 < y.sum() < len(y):  # nothing to tell apart
        net.out[:] = 0
        net.out_bias[:] = -5 if len(y) and not y.any() else 5
        return net
    share = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    x = np.zeros((len(chunks), CHUNK + WIDTH - 1), np.uint8)
    size = np.array([min(max(len(c), 1), CHUNK) for c in chunks])
    for row, c in zip(x, chunks, strict=True):
        row[: len(c)] = np.frombuffer(c, np.uint8)
    m = {k: np.zeros_like(getattr(net, k)) for k in NAMES}
    v = {k: np.zeros_like(getattr(net, k)) for k in NAMES}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            _, grads = gradients(net, x[rows], size[rows], y[rows], share[rows])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                setattr(net, k, (getattr(net, k) - rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32))
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of every document that isn't held out; the least of several labels."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.min("quality").alias("quality"))


def training_chunks(docs: DataFrame, labels: DataFrame) -> list[tuple[bytes, int]]:
    """The bounded sample: at most 2 * SAMPLE_DOCS * SAMPLE_CHUNKS chunks, none of a held-out document."""
    known = known_labels(labels)
    order = (F.xxhash64("doc_id"), "doc_id")
    picked = [known.filter(F.col("quality") == q).orderBy(*order).limit(SAMPLE_DOCS) for q in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * SAMPLE_DOCS rows at most

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks, quality = [], []
            for text, q in zip(batch.column("text").to_pylist(), batch.column("quality").to_pylist(), strict=True):
                data = (text or "").encode()
                n = max(1, -(-len(data) // CHUNK))
                for i in sorted({n * k // SAMPLE_CHUNKS for k in range(SAMPLE_CHUNKS)}):
                    chunks.append(data[i * CHUNK : (i + 1) * CHUNK + WIDTH - 1])
                    quality.append(q)
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.binary()), pa.array(quality, pa.int32())], ["chunk", "quality"])

    texts = docs.select("doc_id", "text").join(ids, "doc_id").select("text", F.col("quality").cast("int").alias("quality"))
    rows = texts.mapInArrow(cut, "chunk binary, quality int").distinct()  # repeated rows give the same chunks
    rows = rows.orderBy(F.xxhash64("chunk"), "chunk", "quality").limit(2 * SAMPLE_DOCS * SAMPLE_CHUNKS).collect()
    return sorted((bytes(r.chunk), r.quality) for r in rows)


def score(docs: DataFrame, labels: DataFrame, sample_of: DataFrame | None = None, to: str = "__score") -> DataFrame:
    """docs with a column `to`, from 0 to 1: how likely label 1 is. Training texts come from sample_of, or docs.

    A null text counts as empty; an empty text has a score like any other; every chunk of a long text counts; repeated
    rows score alike; other columns, ids included, are no input and pass through; an empty table gives an empty table.
    A column that is named `to` already is replaced. Labels of one value, or none, give all documents the same score (over KEEP, unless every label is 0).
    """
    names = [c for c in docs.columns if c != to]
    sample = training_chunks(docs if sample_of is None else sample_of, labels)
    prior = known_labels(labels).agg(F.avg("quality")).first()[0] or 0.0  # over all labels
    net = train([c for c, _ in sample], [q for _, q in sample], prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 2000) for whole in batches for at in range(0, whole.num_rows, 2000)):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            found, run_, total = [], [], 0
            for t in texts:
                run_.append(t)
                total += len(t)
                if total > 1_000_000:
                    found.append(net.scores(run_))
                    run_, total = [], 0
            if run_:
                found.append(net.scores(run_))
            scores = np.concatenate([np.zeros(0), *found])
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], [*names, to])

    fields = [f for f in docs.schema.fields if f.name != to]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(to, T.DoubleType())]))


def op9_byte_cnn(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score(docs, labels).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= KEEP).cast("int").alias("predicted"),
    )
