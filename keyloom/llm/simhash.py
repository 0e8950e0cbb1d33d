"""SimHash near-duplicates by pigeonhole blocks.

A document's 64-bit fingerprint is the bitwise majority of the XXH64 of its 4-word shingles. Fingerprints within RADIUS
bits are links. Cut into B blocks, two such fingerprints agree on at least B - RADIUS of them, so they meet in one of the
C(B, RADIUS) buckets keyed by B - RADIUS blocks; B grows with the number of fingerprints, to hold buckets small at any
size without losing a link. Only distinct fingerprints enter the buckets. In a bucket a breadth-first search over Hamming
distances emits a spanning forest, never all pairs; components join the forests.

Hashing per shingle needs XXH64 over joined words and a count per bit, which numpy does in a fraction of the time of SQL
lambdas, so this operator maps Arrow batches; its memory is one batch of texts.

Defined results: null, blank and empty texts have fingerprint zero, linked like any other; repeated rows and equal ids are
each returned; a null doc_id is never a component id unless its component has no other; extra columns are ignored by
`fingerprints` and kept by `drop_near_duplicates`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import arrow, fits_broadcast, read, staged, unused
from .graph import components

RADIUS, SHINGLE, BITS, SEED = 4, 4, 64, 42
#: Expected fingerprints a bucket at most, under which the number of blocks is chosen.
BUCKET = 16
#: Components whose ids are attached by a broadcast; more are joined by shuffle, over SALTS keys each.
MAX_BROADCAST, SALTS = 200_000, 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text."""
    ws = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(ws) - shingle + 1)
    lo, hi = starts[:n].tolist(), ends[-n:].tolist()
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        part = range(at, min(n, at + _CHUNK))
        h = np.fromiter((digest(joined[lo[i] : hi[i]], SEED) for i in part), np.uint64, len(part))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The columns `keys` of docs and `fp`, the fingerprint as a signed long."""
    (body,) = unused(docs, "text")
    rows = docs.select(*keys, F.col(text).alias(body))
    schema = rows.drop(body).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter(map(fingerprint, (x.as_py() for x in batch.column(batch.num_columns - 1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names=[*keys, "fp"])

    return arrow(rows, run, schema)


def masks(n: int, radius: int = RADIUS, bucket: int = BUCKET) -> list[int]:
    """Signed masks of the bucket keys for n fingerprints, of which a bucket is to hold `bucket` at most."""
    b = next((b for b in range(radius + 2, radius + 9) if n <= bucket << (BITS * (b - radius) // b)), radius + 9)
    edges = [BITS * i // b for i in range(b + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(b)]
    out = [sum(block[i] for i in chosen) for chosen in combinations(range(b), b - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints (uint64), as index pairs."""
    left, out = np.arange(len(fps)), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]) <= RADIUS
            if near.any():
                hit = left[near]
                out += [(int(x), int(y)) for y in hit]
                front += hit.tolist()
                left = left[~near]
    return out


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, v, fp) sorted by them -> the links (a, b) of each bucket's forest. Holds one bucket and one batch."""
    rest = np.empty((0, 3), np.int64)

    def links(rows: np.ndarray) -> pa.RecordBatch:
        fps = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
        a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        if len(rows):
            new = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1))))
            size = np.diff(np.concatenate((new, [len(rows)])))
            group = np.repeat(np.arange(len(new)), size)
            small = size[group] <= 4
            for d in (1, 2, 3):
                ok = (group[d:] == group[:-d]) & small[d:] & (np.bitwise_count(fps[d:] ^ fps[:-d]) <= RADIUS)
                a.append(fps[:-d][ok])
                b.append(fps[d:][ok])
            for at, n in zip(new[size > 4].tolist(), size[size > 4].tolist()):
                if pairs := forest(fps[at : at + n]):
                    i = np.array(pairs)
                    a.append(fps[at + i[:, 0]])
                    b.append(fps[at + i[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    for batch in batches:
        rows = np.concatenate((rest, np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])))
        if not len(rows):
            continue
        cut = np.flatnonzero((rows[:, :2] == rows[-1, :2]).all(axis=1))[0]
        rest = rows[cut:]
        yield links(rows[:cut])
    yield links(rest)


def link_components(fps: DataFrame) -> DataFrame:
    """(fp, root) for the distinct fingerprints of column fp that have a link; root is one fingerprint of the component."""
    distinct = staged(fps.select("fp").distinct(), "simhash-distinct")
    keys = [F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks(distinct.count()))]
    rows = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp").select("key.k", "key.v", "fp")
    dealt = rows.repartition("k", "v").sortWithinPartitions("k", "v", "fp")
    links = staged(arrow(dealt, _bucket_links, "a long, b long").distinct(), "simhash-links")
    return components(links).select(F.col("node").alias("fp"), "root")


def near_duplicate_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    fps = staged(fingerprints(docs, [doc_id], text).withColumnRenamed(doc_id, "doc_id"), "simhash-fingerprints")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # a component may hold a third of all fingerprints: its minimum is taken map-side, and its id goes back over salted keys
    rooted = staged(least.join(link_components(fps), "fp", "left"), "simhash-rooted")
    linked, names = rooted.where("root IS NOT NULL"), rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component_id"))
    if fits_broadcast(names, MAX_BROADCAST):
        named = linked.join(F.broadcast(names), "root")
    else:
        salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")
        named = linked.withColumn("salt", salt).join(names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["root", "salt"])
    named = named.select("fp", "component_id").union(rooted.where("root IS NULL").select("fp", "least"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicate_components(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each component: that of least doc_id, and of equal ids the first by a hash of its text.

    Only ids travel: the rows to stay are found from (doc_id, hash of the text). Rows equal in both are one.
    """
    from .similar import keep_first

    key, mark = F.col(doc_id).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    fps = staged(fingerprints(docs.select(key.alias("id"), mark.alias("mark"), F.col(text).alias("body")), ["id", "mark"], "body"), "simhash-fingerprints")
    rooted = fps.join(link_components(fps), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "mark")
    firsts = staged(rooted.groupBy("root").agg(F.min(rank).alias("first")).select("first.id", "first.mark"), "simhash-firsts")
    return keep_first(docs, firsts, key, mark)
