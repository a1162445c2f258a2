"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes, of BITS bits, of its words, adjacent word pairs, and pairs with one word between (ASCII
lower case; words are runs of letters, digits and non-ASCII bytes). FTRL-proximal keeps a learning rate for each coordinate and an L1
term that leaves few weights. There are at most 2 ** BITS weights, by the hash itself, so what is sent to the workers is bounded
(12 bytes each) and no learnt weight is left out; every whole text is scored once.

Fit: at most SAMPLE labelled training rows (bound on what one task holds), the first by a hash of the id. Rows whose
crc32(id) mod 5 is 0 are held out. Nothing but the text enters a score.

Defined results: null and empty texts score the intercept; without labels of both kinds every score is 0; repeated rows are
scored each; of texts that share a labelled id the one whose features come first in byte order is learnt from; a null id is not held
out; an empty table gives an empty result; other columns pass through score(), one of the score's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, byte_codes, lean, mix, slices, span_hashes, table, text_bytes, words_of

SAMPLE = 16_000
#: Bits of a feature's hash.
BITS = 22
SLICE = 1 << 20
#: A feature is learned if this many documents of the sample have it.
MIN_DOCS = 3
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 3.0, 0.1, 6

_CODES = byte_codes(71, lower=True)
_BREAKS = np.array([not (chr(b).isalnum() and b < 128 or b >= 128) for b in range(256)])


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features with the row of each, repeats included."""
    starts, ends, first = words_of(raw, offsets, _BREAKS)
    h = span_hashes(raw, starts, ends, _CODES)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(first))
    hashes, rows = [h], [row]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > gap:
            same = row[:-gap] == row[gap:]
            hashes.append(mix(h[:-gap] * np.uint64(salt) + h[gap:])[same])
            rows.append(row[:-gap][same])
    return (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.uint32), np.concatenate(rows)


@lean
def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(order, doc_id, y, text) -> (order, doc_id, y, features): distinct features of each row as little-endian 32-bit integers."""
    for batch in batches:
        raw, offsets = text_bytes(batch.column(3))
        for i, j in slices(offsets, SLICE):
            f, row = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            key = np.unique((row.astype(np.uint64) << np.uint64(32)) | f)
            cut = np.searchsorted(key >> np.uint64(32), np.arange(j - i + 1))
            low = key.astype(np.uint32)
            out = [low[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:3]), pa.array(out, pa.binary())], ["order", "doc_id", "y", "features"])


def fit_ftrl(docs: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Features with a weight, the weights, the intercept."""
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(0, np.uint32), np.zeros(0), float("-inf")
    known, n_docs = np.unique(np.concatenate(docs), return_counts=True)
    known = known[n_docs >= MIN_DOCS]
    at = []
    for d in docs:
        i = np.searchsorted(known, d)
        i[i == len(known)] = 0
        at.append(np.append(i[known[i] == d] + 1 if len(known) else i[:0], 0))  # 0: the intercept
    z, n = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    l1 = np.full(len(known) + 1, L1)
    l1[0] = 0.0

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1[i], 0.0, -(zi - np.sign(zi) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i, label in zip(at, y.tolist(), strict=True):
            w = weights(i)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35.0, 35.0))) - label
            ni = n[i]
            grown = ni + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * w
            n[i] = grown
    w = weights(np.arange(len(z)))
    keep = np.flatnonzero(w[1:])
    return known[keep], w[1:][keep], float(w[0])


@lean
def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: features, weights (both packed), intercept."""
    order, y, docs = [], [], []
    for batch in batches:
        order += batch.column(0).to_pylist()
        y += batch.column(1).to_pylist()
        docs += [np.frombuffer(x, np.uint32) for x in batch.column(2).to_pylist()]
    by = sorted(range(len(y)), key=lambda i: (order[i], docs[i].tobytes(), y[i]))
    f, w, b = fit_ftrl([docs[i] for i in by], np.array([y[i] for i in by], float))
    yield pa.RecordBatch.from_arrays([pa.array([f.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary()), pa.array([b])], ["features", "weights", "intercept"])


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """The model (features, weights, intercept); what comes to the driver are its weights, 2 ** BITS at most."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(label_col).cast("double").alias("y"))
    # `sample` rows at most, so the broadcast is bounded
    chosen = bounded_sample(known, "doc_id", sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id").select("order", "doc_id", "y", "text")
    featured = rows.mapInArrow(_featured, f"order bigint, doc_id {rows.schema['doc_id'].dataType.simpleString()}, y double, features binary")
    # one text for each sampled id: however many rows share one, the fitting task gets `sample` rows
    single = featured.groupBy("doc_id").agg(F.min(F.struct("features", "order", "y")).alias("x")).select("x.order", "x.y", "x.features")
    got = single.repartition(1).mapInArrow(_fitted, "features binary, weights binary, intercept double").collect()
    if not got:  # a plan without rows may have no task
        return fit_ftrl([], np.zeros(0))
    return np.frombuffer(got[0].features, np.uint32), np.frombuffer(got[0].weights, float), got[0].intercept


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns (but one of the new column's name) and the score of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, intercept = sent.value
        weighs = np.zeros(1 << BITS, bool)  # looked at before the search
        weighs[known] = True
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            total = np.full(batch.num_rows, intercept)
            for i, j in slices(offsets, SLICE) if len(known) else ():
                f, row = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hit = weighs[f]
                pairs = np.unique((row[hit].astype(np.int64) << 32) | np.searchsorted(known, f[hit]))  # each feature once a text
                np.add.at(total, i + (pairs >> 32), weights[pairs & 0xFFFFFFFF])
            with np.errstate(over="ignore"):
                p = 1.0 / (1.0 + np.exp(-total))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p)], names)

    rest = [c for c in docs.columns if c != score_col]
    names = [*rest, score_col]
    given = docs.select(F.col(text_col), *rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[1:])
    return given.mapInArrow(run, f"{schema}, `{score_col}` double")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
