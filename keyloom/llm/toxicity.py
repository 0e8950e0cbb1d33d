"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on the wording that toxic texts share and ordinary texts
lack. Each window of a text is compressed with the ordinary dictionary and with both; the bytes that the toxic dictionary
saves are the window's distance. Trained on whole toxic texts, a dictionary holds what is frequent in any text, as toxic words
are few among many, and the two lengths tell little (figures in the README); so the words that hold telling grams are chosen
before zstandard's trainer sees them. How many windows pass each of a ladder of thresholds, calibrated by a logistic
regression on labelled documents that the dictionaries have not seen, is the document's score.

The fit uses a bounded sample: at most SAMPLE[label] labelled documents of each label, the first by a hash of their id, each
whole, as scoring reads them. Scoring goes through a text in windows; its memory is a chunk of windows.

Defined results: null, blank and empty texts have no window and get the score that calibration gives to no evidence; a
document with several labels counts as toxic if any says so; without labels of both kinds every score is the share of
toxic labels (0 without any); repeated rows are scored each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import arrow, read, unused

WINDOW, STRIDE, GRAM, CHUNK = 4, 2, 5, 8192
SAMPLE = {0: 6000, 1: 2000}
#: Calibration sees each sampled document under dictionaries trained on the other folds; the final ones train on all.
FOLDS = 3
#: A gram is telling if its share of toxic texts is so many times its share of ordinary texts.
CONTRAST = 20
ORDINARY_BYTES, TOXIC_BYTES, SEGMENT, DMER = 32_768, 4_096, 16, 6
THRESHOLDS = range(1, 9)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def windows_of(ws: list[bytes]) -> Iterator[list[bytes]]:
    """Chunks of windows of WINDOW words, STRIDE apart; the last one may be shorter."""
    for at in range(0, len(ws), CHUNK * STRIDE):
        yield [b" " + b" ".join(ws[i : i + WINDOW]) + b" " for i in range(at, min(len(ws), at + CHUNK * STRIDE), STRIDE)]


def _grams(word: bytes) -> set[bytes]:
    padded = b" " + word + b" "
    return {padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)}


def train_dictionaries(ordinary: list[list[bytes]], toxic: list[list[bytes]]) -> tuple[bytes, bytes]:
    """The contents of the two dictionaries. Too little text for zstandard's trainer serves as the dictionary itself."""

    def trained(samples: list[bytes], size: int, **how: int) -> bytes:
        try:
            return zstd.train_dictionary(size, samples, **how).as_bytes()
        except zstd.ZstdError:
            return b"".join(samples)[-size:]

    shared: Counter[bytes] = Counter()
    for ws in toxic:
        shared.update(set().union(*map(_grams, set(ws))) if ws else ())
    need = max(3, len(toxic) // 200)
    likely = {g for g, n in shared.items() if n >= need}
    common: Counter[bytes] = Counter()
    for ws in ordinary:
        common.update(likely & set().union(*map(_grams, set(ws))) if ws else ())
    telling = {g for g in likely if shared[g] * len(ordinary) >= CONTRAST * common[g] * len(toxic)}
    samples = []
    for ws in toxic:
        own = [w for w in ws if not telling.isdisjoint(_grams(w))]
        samples += [b" " + b" ".join(own[i : i + 4]) + b" " for i in range(0, len(own), 4)]
    plain = [w for ws in ordinary for chunk in windows_of(ws) for w in chunk[::2]]
    return trained(plain, ORDINARY_BYTES), trained(samples, TOXIC_BYTES, k=SEGMENT, d=DMER)


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    how = zstd.ZstdCompressionParameters(
        strategy=zstd.STRATEGY_DFAST, min_match=5, window_log=17, chain_log=15, hash_log=15, search_log=5, target_length=32, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    words = zstd.ZstdCompressionDict(content or b"\0" * 16, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(compression_params=how)
    return zstd.ZstdCompressor(dict_data=words, compression_params=how)


class Distance:
    """Counts of windows by the bytes that the toxic dictionary saves."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.both = _compressor(ordinary), _compressor(ordinary + toxic)

    def counts(self, text: str | None) -> np.ndarray:
        """Windows, then windows at or over each threshold."""
        out = np.zeros(1 + len(THRESHOLDS))
        for chunk in windows_of(words_of(text)):
            sizes = [[len(r[i]) for i in range(len(r))] for r in (c.multi_compress_to_buffer(chunk) for c in (self.plain, self.both))]
            saved = np.array(sizes[0]) - np.array(sizes[1])
            out += [len(chunk), *((saved >= t).sum() for t in THRESHOLDS)]
        return out


def features(counts: np.ndarray) -> np.ndarray:
    x = np.atleast_2d(counts)
    over = x[:, 1:]
    return np.column_stack([np.log1p(over), 10 * over / np.maximum(x[:, :1], 1), np.minimum(over, 3), np.log1p(x[:, :1])])


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a small ridge. Returns weights of the raw features, bias first."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w, ridge = np.zeros(a.shape[1]), np.r_[1e-6, np.ones(a.shape[1] - 1)]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (weight * (p - y)) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    raw = w[1:] / spread
    return np.r_[w[0] - raw @ mean, raw]


def fit(sample: list[tuple[str | None, int]], share: float) -> tuple[bytes, bytes, np.ndarray] | float:
    """The dictionaries and weights from (text, label) rows; the share of toxic labels if a label is missing."""
    rows = {y: [t for t, label in sample if label == y] for y in (0, 1)}
    if not rows[0] or not rows[1]:
        return float(share)
    words = {y: [words_of(t) for t in rows[y]] for y in (0, 1)}
    apart = lambda ws, k: [w for i, w in enumerate(ws) if i % FOLDS != k] or ws
    counts, y = [], []
    for k in range(FOLDS):
        distance = Distance(*train_dictionaries(apart(words[0], k), apart(words[1], k)))
        for label in (0, 1):
            own = rows[label][k::FOLDS]
            counts += [distance.counts(t) for t in own]
            y += [label] * len(own)
    labels = np.array(y)
    weight = np.where(labels == 1, share / len(rows[1]), (1 - share) / len(rows[0])) * len(labels)
    return *train_dictionaries(words[0], words[1]), calibrate(features(np.array(counts)), labels, weight)


@cache
def _distance(ordinary: bytes, toxic: bytes) -> Distance:
    return Distance(ordinary, toxic)


def score(docs: DataFrame, model: tuple[bytes, bytes, np.ndarray] | float, keys: list[str], text: str = "text") -> DataFrame:
    """The columns `keys` of docs and `score`."""
    (body,) = unused(docs, "text")
    rows = docs.select(*keys, F.col(text).alias(body))
    schema = rows.drop(body).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(model, float):
                scores = np.full(batch.num_rows, model)
            else:
                ordinary, toxic, w = model
                counts = np.array([_distance(ordinary, toxic).counts(x.as_py()) for x in batch.column(batch.num_columns - 1)])
                scores = 1 / (1 + np.exp(-np.clip(features(counts.reshape(-1, 1 + len(THRESHOLDS))) @ w[1:] + w[0], -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*keys, "score"])

    return arrow(rows, run, schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[bytes, bytes, np.ndarray] | float:
    """A model from labelled documents. labels: doc_id, toxic. The sample is bounded by SAMPLE."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy((F.col("toxic") != 0).cast("int")).count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    picked = None
    for label, n in SAMPLE.items():
        some = known.where((F.col("toxic") != 0) == bool(label)).select("doc_id", F.lit(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = some if picked is None else picked.union(some)
    text = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most sum(SAMPLE) ids
    # of repeated rows of an id one, so that the bound is on rows
    sample = text.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    sample.sort(key=lambda r: (hash((r.doc_id * 2654435761) % (1 << 32)), r.doc_id, r.text or ""))
    return fit([(r.text, r.y) for r in sample], share)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(~held_out())
    out = score(docs, learn(docs, labels), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
