"""Near-duplicates by SimHash and pigeonhole blocks, every link verified; a prefix filter brings the links beyond the blocks' reach.

Two documents are linked if the Jaccard similarity of their sets of SHINGLE-word shingles (lower-cased in ASCII) is
SIMILARITY or more. First, the SimHash of a set is the bitwise majority of its shingles' hashes. Fingerprints within RADIUS bits
agree on at least BLOCKS - RADIUS of BLOCKS blocks, so all such pairs meet in buckets keyed by as many blocks; a bucket's spanning
forest gives candidates, never all pairs, and those that reach the similarity are links.

At a similarity of 0.8 fingerprints differ in 10 bits in the mean and in over 18 at times, and within so many bits blocks of 64
bits select nothing. So what may be linked beyond RADIUS comes from a filter that loses no pair, for documents still in different
components: in any fixed order of all shingles, two sets of similarity s share one of their first n - ceil(s n) + 1 shingles. The
order is by hash, with shingles that are common in a sample of documents last; the sample decides speed, never the result. At the
first shingle that two sets share, only what follows it can be shared as well: pairs for which that is too little go.

Most candidates that merely share a passage go before they become rows: each set brings BITS parities of its hashes into a bucket, and
two sets differ in at least as many shingles as parities do. With some hundred shingles that is nearly their difference, so of a group
of near copies only pairs that are linked or just miss it leave the bucket. Of sets too large for that many go by a sketch: they also
differ in as many shingles as the counts of their hashes by ranges do, added up, and these counts have a thirtieth of the set's
bytes. Sets themselves are never stored: those of the few documents in candidate pairs are hashed again from their texts.

Documents of equal sets are one from the start. In large buckets of one shingle each document first meets the few of other components
whose parities are nearest; then all pairs of a bucket that still lie in different components and may be linked are verified, so no
link between components is lost and a large group of copies needs no pairs of all with all. A pair that shares several buckets is
tested in few: each row names the buckets before its own, and where both rows name the same one the pair is left to that.

Defined results: a text of fewer than SHINGLE words has one shingle, the whole; null, blank and empty texts have none and are
one group; rows equal in id and text are one row, and null ids come last; extra columns are kept; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import arrow, fits_broadcast, staged, unused
from .graph import components
from .simhash import masks

SHINGLE, SIMILARITY = 5, 0.8
#: Documents in the sample for common shingles (at least so many, or one in so many), in how many of them a shingle is common,
#: and common shingles at most.
SAMPLE, SHARE, COMMON, MAX_COMMON = 10_000, 50, 3, 100_000
#: Bits within which blocks find pairs, and fingerprints expected in a bucket of blocks at most: ten blocks up to 16 million sets.
RADIUS, BUCKET = 8, 4096
#: The bucket size of one shingle up to which all pairs come at once, how many of the nearest come first in larger ones, and earlier
#: buckets that a row names.
SMALL, NEAREST, BEFORE = 8, 3, 3
#: Parities of a set, a multiple of 64. Sets of over about BITS shingles are told apart by their sketches rather.
BITS = 1024
#: Documents whose texts are read again by a broadcast list of their ids; more are found by a shuffle.
MAX_BROADCAST = 200_000
_SLICE, _CHUNK, SEED = 500, 1 << 15, 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_rng = np.random.Generator(np.random.PCG64(58))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_rng.integers(1, 1 << 61)) * 8 + 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers at least of the base and of its inverse."""
    if len(_powers[0]) <= n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            full = np.full(2 * n + 1, base, np.uint64)
            full[0] = 1
            _powers[i] = np.multiply.accumulate(full)
    return _powers[0], _powers[1]


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the shingles of one text: differences of a running polynomial over its bytes, mixed."""
    ws = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not ws:
        return np.empty(0, np.uint64)
    data = np.frombuffer(b" ".join(ws), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    n = max(1, len(ws) - shingle + 1)
    lo, hi = np.concatenate(([0], ends[: n - 1] + 1)), ends[-n:]
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    h = (total[hi] - total[lo]) * down[lo]
    for shift in (31, 29):  # differences of sums carry little into low bits
        h ^= h >> np.uint64(shift)
        h *= _MIX
    return np.unique(h ^ h >> np.uint64(32))


def least_overlap(n: int, similarity: float) -> int:
    """Shingles that a set of n shares at least with any set of that similarity."""
    return math.ceil(similarity * n - 1e-9)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def sketch(own: np.ndarray) -> bytes:
    """Counts of a set's hashes in equal ranges, about four to a range, 255 at most."""
    bits = max(4, min(16, len(own).bit_length() - 2))
    return np.minimum(np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def may_reach(x: bytes, y: bytes, n_x: int, n_y: int, similarity: float) -> bool:
    """Whether two sets can have the similarity, by their sketches and sizes. Never false for sets that have it."""
    m = min(len(x), len(y))
    a, b = (np.minimum(np.frombuffer(s, np.uint8).reshape(m, -1).sum(axis=1, dtype=np.int64), 255) for s in (x, y))
    return int(np.abs(a - b).sum()) * (1 + similarity) <= (1 - similarity) * (n_x + n_y) + 1e-6


def parities(own: np.ndarray) -> np.ndarray:
    """Whether each of BITS classes of hashes holds an odd number of the set's. Two sets' differ in no more bits than the sets in hashes."""
    odd = np.bincount((own & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def fingerprint(own: np.ndarray) -> int:
    """The SimHash of a set of hashes: each bit as in the majority of them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(own), _CHUNK):
        part = np.ascontiguousarray(own[at : at + _CHUNK])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(own), bitorder="little").view(np.uint64)[0])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, _SLICE):
            yield whole.slice(at, _SLICE)


def prefix(own: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a sorted set in the order of all: one of them is shared with each set of that similarity."""
    n = len(own) - least_overlap(len(own), similarity) + 1 if len(own) else 0
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        late = common[at] == own
        own = np.concatenate((own[~late], own[late]))
    return own[:n]


def _common(rows: DataFrame, shingle: int) -> np.ndarray:
    """The sorted hashes of the shingles that many documents of a sample hold. rows: (id, mark, body)."""
    total = rows.count()
    size = max(SAMPLE, total // SHARE)
    key, mark, body = rows.columns
    some = rows if total <= size else rows.where(F.pmod(F.xxhash64(key, mark), F.lit(total)) < size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            own = [shingle_set(x.as_py(), shingle) for x in batch.column(0)]
            h, times = np.unique(np.concatenate(own), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(times)], names=["h", "times"])

    counted = arrow(some.select(body), run, "h long, times long").groupBy("h").agg(F.sum("times").alias("times")).where(F.col("times") >= COMMON)
    top = counted.orderBy(F.desc("times"), "h").limit(MAX_COMMON).select("h").collect()
    return np.sort(np.array([r.h for r in top], np.int64).view(np.uint64))


_PREFIXED = "id long, mark long, sig long, n int, sketch binary, fp long, bits array<long>, prefix array<long>"


def _prefixed(rows: DataFrame, common: np.ndarray, shingle: int, similarity: float) -> DataFrame:
    """(id, mark, body) -> (id, mark, sig, n, sketch, fp, bits, prefix): the hash of the set, its size, sketch, SimHash, parities and first shingles.

    Equal sets of one task give their prefix once, so a group of copies costs a bucket one row a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _slices(batches):
            sigs, sizes, sketches, fps, bits, firsts = [], [], [], [], [], []
            for x in batch.column(2):
                own = shingle_set(x.as_py(), shingle)
                sig = xxhash.xxh64_intdigest(own.tobytes(), SEED)
                sigs.append(sig)
                sizes.append(len(own))
                sketches.append(sketch(own))
                fps.append(fingerprint(own))
                bits.append(parities(own).view(np.int64))
                firsts.append(None if sig in seen else prefix(own, common, similarity).view(np.int64))
                seen.add(sig)
            sig, fp = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sigs, fps))
            columns = [batch.column(0), batch.column(1), sig, pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), fp, *(pa.array(x, pa.list_(pa.int64())) for x in (bits, firsts))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "sig", "n", "sketch", "fp", "bits", "prefix"])

    return arrow(rows, run, _PREFIXED)


def _groups(batches: Iterator[pa.RecordBatch], by: int = 1) -> Iterator[np.ndarray]:
    """Rows sorted by their first `by` columns -> stretches of whole groups of them. Holds one group and one batch. Lists are parities."""
    rest = None
    for batch in batches:
        plain = [c.flatten().to_numpy().reshape(-1, BITS // 64) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rows = np.column_stack([c.astype(np.int64, copy=False) for c in plain])
        rows = rows if rest is None else np.concatenate((rest, rows))
        if len(rows):
            cut = int(np.flatnonzero((rows[:, :by] == rows[-1, :by]).all(axis=1))[0])
            rest = rows[cut:]
            if cut:
                yield rows[:cut]
    if rest is not None and len(rest):
        yield rest


def _near_links(sigs: np.ndarray, fps: np.ndarray) -> list[np.ndarray]:
    """A spanning forest of the pairs of a bucket within RADIUS bits, as arrays of two signatures a row."""
    left, out = np.arange(len(fps)), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]) <= RADIUS
            if near.any():
                hit, left = left[near], left[~near]
                out.append(np.column_stack((np.minimum(sigs[hit], sigs[x]), np.maximum(sigs[hit], sigs[x]))))
                front += hit.tolist()
    return out


def _near(sets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of a spanning forest of each bucket of blocks. sets: staged rows (sig, fp), each set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 2):
            new = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1))))
            fp, found = np.ascontiguousarray(rows[:, 3]).view(np.uint64), []
            for at, size in zip(new.tolist(), np.diff(np.concatenate((new, [len(rows)]))).tolist()):
                own = fp[at : at + size]
                # most buckets hold no pair; large ones find out as they go
                if size > 1 and (size > 64 or (np.bitwise_count(own[:, None] ^ own) <= RADIUS).sum() > size):
                    found += _near_links(rows[at : at + size, 2], own)
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    keys = [F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks(sets.count(), RADIUS, BUCKET))]
    rows = sets.select(F.explode(F.array(*keys)).alias("key"), "sig", "fp").select("key.k", "key.v", "sig", "fp")
    return arrow(rows.repartition("k", "v").sortWithinPartitions("k", "v"), run, "a long, b long").distinct()


#: place: the set's size (its upper 32 bits) and where the shingle stands in its prefix (the lower 32).
_BUCKET = "k long, sig long, place long"
_NAMED = [f"before_{d}" for d in range(1, BEFORE + 1)]


def _buckets(prefixed: DataFrame) -> DataFrame:
    """(k, sig, place, before...) of the prefix shingles that at least two sets hold, each set once.

    before: such shingles ahead of k in the set's prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            rows = rows[np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))]
            same = rows[1:, 0] == rows[:-1, 0]
            rows = rows[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(3)], names=["k", "sig", "place"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            sig, place, k = rows.T
            columns = [k, sig, place]
            for d in range(1, BEFORE + 1):
                x = sig.copy()  # a signature names no bucket, and differs in any two sets
                x[d:] = np.where(sig[d:] == sig[:-d], k[:-d], sig[d:])
                columns.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["k", "sig", "place", *_NAMED])

    keys = prefixed.select("sig", "n", F.posexplode("prefix").alias("at", "k")).select("k", "sig", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("at")).alias("place"))
    shared = arrow(keys.repartition("k").sortWithinPartitions("k", "sig"), run, _BUCKET)
    dealt = shared.select("sig", "place", "k").repartition("sig").sortWithinPartitions("sig", "place")
    return arrow(dealt, named, ", ".join([_BUCKET, *(f"{x} long" for x in _NAMED)]))


def _candidates(labelled: DataFrame, nearest: bool, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of one bucket and different roots, whose sizes, places and parities allow the similarity.

    nearest: in buckets over SMALL only the NEAREST by parities of each set. A pair is left to an earlier bucket that both rows
    name: its places there allow at least as much, and all pairs of each bucket come in one of the two rounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            new = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))
            found = []
            for at, size in zip(new.tolist(), np.diff(np.concatenate((new, [len(rows)]))).tolist()):
                own = rows[at : at + size]
                if (own[:, 3] == own[0, 3]).all():
                    continue
                _, which, count = np.unique(own[:, 3], return_inverse=True, return_counts=True)
                last = which == np.argmax(count)  # the largest component needs no pairs of its own
                own = own[np.argsort(last, kind="stable")]
                sig, root, before = own[:, 1], own[:, 3], own[:, 4 : 4 + BEFORE]
                bits = np.ascontiguousarray(own[:, 4 + BEFORE :]).view(np.uint64)
                n = own[:, 2] >> 32
                left = n - (own[:, 2] & 0xFFFFFFFF)  # the shingle and those after it
                few = nearest and size > SMALL
                for i in range(size - int(last.sum())):
                    other = np.arange(0 if few else i + 1, size)
                    able = np.minimum(left[other], left[i]) * (1 + similarity) >= similarity * (n[other] + n[i]) - 1e-6
                    ok = other[(root[other] != root[i]) & able]
                    ok = ok[~(before[ok][:, :, None] == before[i]).any(axis=(1, 2))]
                    far = np.bitwise_count(bits[ok] ^ bits[i]).sum(axis=1, dtype=np.int64)
                    near = far * (1 + similarity) <= (1 - similarity) * (n[ok] + n[i]) + 1e-6
                    ok, far = ok[near], far[near]
                    if few and len(ok) > NEAREST:
                        ok = ok[np.argpartition(far, NEAREST)[:NEAREST]]
                    if len(ok):
                        found.append(np.column_stack((np.minimum(sig[ok], sig[i]), np.maximum(sig[ok], sig[i]))))
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return arrow(labelled.select("k", "sig", "place", "root", *_NAMED, "bits").repartition("k").sortWithinPartitions("k"), run, "a long, b long").distinct()


def _able(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sketches (sig, n, sketch) allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [may_reach(*x, similarity) for x in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = (sketches.select(F.col("sig").alias(key), F.col("sketch").alias(f"s_{key}"), F.col("n").alias(f"n_{key}")) for key in "ab")
    return arrow(pairs.join(x, "a").join(y, "b").select("a", "b", "s_a", "s_b", "n_a", "n_b"), run, "a long, b long")


def _sets(needed: DataFrame, firsts: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """(sig, hashes) of the sets in `needed`, hashed again. firsts: (sig, id, mark) of one document of each set."""
    key, mark, body = rows.columns
    chosen = staged(firsts.join(needed, "sig", "left_semi"), "similar-needed")
    keys = chosen.select("sig", "id", "mark")
    keys = F.broadcast(keys) if fits_broadcast(keys, MAX_BROADCAST) else keys
    texts = rows.join(keys, F.col(key).eqNullSafe(F.col("id")) & (F.col(mark) == F.col("mark"))).select("sig", body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            own = [shingle_set(x.as_py(), shingle).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], names=["sig", "hashes"])

    # rows equal in id and text are several rows of one document
    return arrow(texts, run, "sig long, hashes array<long>").dropDuplicates(["sig"])


def _verified(pairs: DataFrame, firsts: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The staged pairs whose sets have the similarity. In SQL: batches of two sets a row would fill Arrow's memory."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    sets = staged(_sets(needed, firsts, rows, shingle), "similar-sets")
    both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("sig").alias("b"), F.col("hashes").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    counted = both.select("a", "b", (F.size("x") + F.size("y")).alias("total"), shared.alias("shared"))
    return counted.where(F.col("shared") >= similarity * (F.col("total") - F.col("shared")) - 1e-9).select("a", "b")


def similar_components(prefixed: DataFrame, rows: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(sig, root) of the sets that are linked to another. prefixed: staged rows of _prefixed; rows: what they were made from."""
    rank = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "mark")).alias("f")
    once = prefixed.groupBy("sig").agg(rank, *(F.first(x).alias(x) for x in ("n", "sketch", "fp", "bits")))
    firsts = staged(once.select("sig", "f.id", "f.mark", "n", "sketch", "fp", "bits"), "similar-sketches")

    def linked(pairs: DataFrame) -> DataFrame:
        return staged(_verified(staged(_able(pairs, firsts, similarity), "similar-pairs"), firsts, rows, shingle, similarity), "similar-links")

    def rooted(links: DataFrame) -> DataFrame:
        return staged(components(links).select(F.col("node").alias("sig"), "root"), "similar-roots")

    links = linked(_near(firsts.select("sig", "fp")))
    roots = rooted(links)
    buckets = staged(_buckets(prefixed), "similar-buckets")
    for nearest in (True, False):
        # buckets go on while they hold several components; in small ones all pairs are done in the first round
        labelled = buckets.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
        several = labelled.groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).where(F.col("lo") != F.col("hi"))
        several = several if nearest else several.where(F.col("size") > SMALL)
        unsettled = labelled.join(several.select("k"), "k", "left_semi").join(firsts.select("sig", "bits"), "sig")
        pairs = _candidates(unsettled, nearest, similarity)
        links = links.union(linked(pairs))
        roots = rooted(links)
    return roots


def keep_first(docs: DataFrame, firsts: DataFrame, key: Column, mark: Column) -> DataFrame:
    """One row of docs for each (id, mark) of firsts; key and mark give those of a row of docs. Null ids are matched as well."""
    name, seen, gone = unused(docs, "key", "mark", "null")
    # as three plain columns: a struct as join key is compared field by field in interpreted code
    keyed = docs.withColumns({name: F.coalesce(key, F.lit(0).cast("long")), gone: key.isNull(), seen: mark})
    keys = firsts.select(F.coalesce("id", F.lit(0).cast("long")).alias(name), F.col("id").isNull().alias(gone), F.col("mark").alias(seen))
    return keyed.join(keys, [name, gone, seen], "left_semi").dropDuplicates([name, gone, seen]).select(*docs.columns)


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each group of linked documents: that of least doc_id, and of equal ids the first by a hash of its text."""
    key, mark = F.col(doc_id).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(key.alias("__id"), mark.alias("__mark"), F.col(text).alias("__body"))
    prefixed = staged(_prefixed(rows, _common(rows, shingle), shingle, similarity), "similar-prefixes")
    rooted = prefixed.select("id", "mark", "sig").join(similar_components(prefixed, rows, shingle, similarity), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "mark")
    firsts = staged(rooted.groupBy("root").agg(F.min(rank).alias("first")).select("first.id", "first.mark"), "similar-firsts")
    return keep_first(docs, firsts, key, mark)
