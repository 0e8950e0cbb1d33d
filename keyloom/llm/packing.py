"""Packing documents into fixed windows by non-negative least squares.

1. Tokenize each text once, whole; cut a document only at multiples of the window. A piece keeps its length, its checksum
   and checksums of short blocks, so no later step needs ids or texts: what is shuffled is a few dozen bytes a piece.
2. Count pieces by length class (WINDOW / GRID classes of GRID lengths). Enumerate the shallow combinations of classes that
   fill a window exactly; solve for their repeat counts by non-negative least squares against the histogram; round within
   what each class has.
3. A piece's rank in its class (running count in its input partition plus the partitions before it) names its sequence and
   slot. No class is sorted or gathered, however many pieces it holds.
4. Pieces beyond the rounded counts are packed greedily end to end, cut at block borders where a window is full.

The driver sees the histogram (WINDOW / GRID rows) and the chosen combinations (as few), at any input size.

Defined results: null text is empty and is the single end id; repeated rows are packed each; a null doc_id is kept; an
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import arrow, read, ship, staged

WINDOW, GRID, BLOCK, END = 4096, 16, 32, 2
CLASSES = WINDOW // GRID
VOCABULARY = "word_bpe_49k.json"
CACHE = 400_000

#: Texts of these characters alone are split at white space and cached by word; any other goes through the tokenizer whole.
_PLAIN = regex.compile(r"[\x20-\x7e\n\r\tÀ-ÖØ-öø-ſ]*")
#: The vocabulary's own splitting rule.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PIECE_SCHEMA = "doc_id long, start long, length int, crc long, blocks binary, doc_tokens long, part int, row long, class int, rank long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next of U+0100 onwards."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Ids:
    """Little-endian unsigned 32-bit ids of texts. Words repeat, so each is looked up; the caches are bounded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def part(self, p: str) -> bytes:
        if (found := self.parts.get(p)) is None:
            mapped = p if p.isascii() else "".join(self.letters[b] for b in p.encode())
            found = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
            if len(self.parts) >= CACHE:
                self.parts.clear()
            self.parts[p] = found
        return found

    def word(self, w: str) -> bytes:
        if (found := self.words.get(w)) is None:
            found = b"".join(map(self.part, _SPLIT.findall(w.lower())))
            if len(self.words) >= CACHE:
                self.words.clear()
            if len(w) < 64:
                self.words[w] = found
        return found

    def text(self, text: str) -> bytes:
        if "<|" in text or not _PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known, word = self.words, self.word
        return b"".join([known.get(w) or word(w) for w in text.split()])


@cache
def _ids(path: str) -> Ids:
    return Ids(path)


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents: at most WINDOW ids each, cut at multiples of WINDOW; ranked by class in their partition."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, seen, row = _ids(path), TaskContext.get().partitionId(), Counter(), 0
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for key, body in zip(batch.column(0), batch.column(1)):
                data = ids.text(body.as_py() or "") + end
                view, n = memoryview(data), len(data) // 4
                for at in range(0, n, WINDOW):
                    piece = view[4 * at : 4 * min(n, at + WINDOW)]
                    length = len(piece) // 4
                    blocks = np.array([zlib.crc32(piece[i : i + 4 * BLOCK]) for i in range(0, len(piece), 4 * BLOCK)], "<u4")
                    k = -(-length // GRID)
                    out.append((key.as_py(), at, length, zlib.crc32(piece), blocks.tobytes(), n, part, row, k, seen[k]))
                    seen[k] += 1
                    row += 1
                if len(out) >= 10_000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    return arrow(rows, run, _PIECE_SCHEMA)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in _PIECE_SCHEMA.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def combinations(present: list[int], total: int = CLASSES) -> list[dict[int, int]]:
    """Shallow combinations of the present classes that sum to total: one or two classes with repeats, and three singly."""
    have, out = set(present), []
    for x in present:
        if total % x == 0:
            out.append({x: total // x})
        for a in range(1, total // x + 1):
            left = total - a * x
            out += [{x: a, y: left // y} for y in present if y > x and y <= left and left % y == 0]
        out += [{x: 1, y: 1, total - x - y: 1} for y in present if x < y < total - x - y and total - x - y in have]
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative x of least |a x - b|, by active sets; ends when no column can lower the rest any more."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    least = math.inf
    while True:
        rest = float(np.square(b - a @ x).sum())
        if not rest < least:  # rounding makes no more progress
            break
        least = rest
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        if free.all() or slope.max() <= scale:
            break
        free[int(slope.argmax())] = True
        while True:
            trial = np.zeros_like(x)
            trial[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (trial[free] > 0).all():
                x = trial
                break
            low = free & (trial <= 0)
            step = (x[low] / np.maximum(x[low] - trial[low], 1e-300)).min()
            x = x + step * (trial - x)
            free &= x > 1e-12 * max(1.0, x.max())
            x[~free] = 0
    return x


def plan(histogram: dict[int, int]) -> list[tuple[dict[int, int], int]]:
    """(combination, repeats), never more of a class than the histogram has."""
    present = sorted(k for k, n in histogram.items() if n)
    combos = combinations(present)
    if not combos:
        return []
    row = {k: i for i, k in enumerate(present)}
    a = np.zeros((len(present), len(combos)))
    for j, c in enumerate(combos):
        for k, m in c.items():
            a[row[k], j] = m * k / CLASSES
    b = np.array([histogram[k] * k / CLASSES for k in present], float)
    x, left, out = nnls(a, b), dict(histogram), []

    def take(j: int, most: float) -> None:
        n = min([int(most), *(left[k] // m for k, m in combos[j].items())])
        if n > 0:
            out.append((combos[j], n))
            for k, m in combos[j].items():
                left[k] -= n * m

    order = np.argsort(-x, kind="stable")
    for j in order:
        if x[j] < 0.5:
            break
        take(j, x[j] + 0.5)
    for j in sorted(np.flatnonzero(x > 0), key=lambda j: -x[j]):  # what rounding left
        take(j, 1 << 62)
    return out


def slots(chosen: list[tuple[dict[int, int], int]]) -> tuple[list[tuple], int]:
    """Rows (class, lo, hi, first sequence, pieces a sequence, first slot) for the ranks of each class; sequences used."""
    at, base, rows = Counter(), 0, []
    for combo, n in chosen:
        slot = 0
        for k, m in combo.items():
            rows.append((k, at[k], at[k] + n * m, base, m, slot))
            at[k] += n * m
            slot += m
        base += n
    return rows, base


@cache
def _shift(n: int) -> tuple[int, ...]:
    """The CRC-32 of each of the 32 register bits after n zero bytes."""
    if n == 0:
        return tuple(1 << i for i in range(32))
    if n > 1:
        a, b = _shift(n // 2), _shift(n - n // 2)
        return tuple(_apply(b, v) for v in a)
    table = [i for i in range(256)]
    for i in range(256):
        for _ in range(8):
            table[i] = table[i] >> 1 ^ (0xEDB88320 if table[i] & 1 else 0)
    return tuple(table[(1 << i) & 255] ^ (1 << i) >> 8 for i in range(32))


def _apply(matrix: tuple[int, ...], v: int) -> int:
    out, i = 0, 0
    while v:
        if v & 1:
            out ^= matrix[i]
        v >>= 1
        i += 1
    return out


def combined_crc(crcs: list[int], lengths: list[int]) -> int:
    """The CRC-32 of parts joined, from theirs."""
    out = 0
    for c, n in zip(crcs, lengths):
        out = _apply(_shift(n), out) ^ c
    return out


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Residual pieces with their places end to end -> parts of them that end where a window is full."""
    room = WINDOW - BLOCK
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "seq", "slot"]
    for pdf in batches:
        out = []
        for doc, start, length, crc, blocks, tokens, place in zip(pdf.doc_id, pdf.start, pdf.length, pdf.crc, pdf.blocks, pdf.doc_tokens, pdf.place):
            place, length, a, s = int(place), int(length), 0, int(place) // room
            if place + length <= room * (s + 1):
                out.append((doc, start, length, crc, tokens, s, place))
                continue
            sums, b = np.frombuffer(blocks, "<u4").tolist(), 0
            while a < length:
                b = min(length, -(-(room * (s + 1) - place) // BLOCK) * BLOCK)
                if b > a:
                    own = range(a // BLOCK, -(-b // BLOCK))
                    value = crc if (a, b) == (0, length) else combined_crc([sums[i] for i in own], [4 * (min(b, (i + 1) * BLOCK) - i * BLOCK) for i in own])
                    out.append((doc, start + a, b - a, value, tokens, s, place + a))
                a, s = max(a, b), s + 1
        frame = pd.DataFrame(out, columns=columns)
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        yield frame


def pack(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every id of every document in one place."""
    spark = docs.sparkSession
    rows = staged(pieces(docs, path or vocabulary_path(), doc_id, text), "packing-pieces")
    by_part = staged(rows.groupBy("part", "class").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    histogram = {r[0]: r[1] for r in by_part.groupBy("class").agg(F.sum("n")).collect()}
    ranges, used = slots(plan(histogram))
    table = spark.createDataFrame(ranges, "k int, lo long, hi long, base long, m long, first long")
    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("part")) - F.col("n")).drop("n")
    ranked = rows.join(before, ["part", "class"]).withColumn("g", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(table), (F.col("class") == F.col("k")) & (F.col("g") >= F.col("lo")) & (F.col("g") < F.col("hi")), "left")
    placed = staged(placed.select("doc_id", "start", "length", "crc", "blocks", "doc_tokens", "part", "row", (F.col("base") + F.expr("(g - lo) div m")).alias("seq"), (F.col("first") + (F.col("g") - F.col("lo")) % F.col("m")).alias("slot")), "packing-placed")
    planned = placed.where("seq IS NOT NULL").select("doc_id", "start", F.col("length").cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", "seq", "slot")

    rest = placed.where("seq IS NULL")
    sums = rest.groupBy("part").agg(F.sum("length").alias("n"))
    first = sums.withColumn("first", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")  # a row for each partition
    running = F.sum("length").over(Window.partitionBy("part").orderBy("row")) - F.col("length")
    ends = rest.withColumn("running", running).join(first, "part").withColumn("place", F.col("first") + F.col("running"))
    ship(spark)
    cut = ends.select("doc_id", "start", "length", "crc", "blocks", "doc_tokens", "place").mapInPandas(_cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, seq long, slot long")
    both = planned.union(cut.withColumn("seq", F.col("seq") + used))
    inside = F.sum("length").over(Window.partitionBy("seq").orderBy("slot")) - F.col("length")
    return both.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("seq").alias("sequence_id"), inside.cast("long").alias("offset"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
