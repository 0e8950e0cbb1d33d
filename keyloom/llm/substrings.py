"""Exact removal of repeated 100-byte strings, by suffix sorting.

Any LENGTH-byte string holds GRAMS = LENGTH - GRAM + 1 grams of GRAM bytes; the leftmost gram of least hash is its anchor,
and depends on the string alone. So equal strings have equal anchors, and:

1. Copies of a whole text keep their first document; every other is repeated from end to end.
2. Anchors of the first documents are dealt by hash, each with a hash of its context, the bytes of the strings it anchors.
   An anchor that stands once covers no repeated string; of equal contexts (by the two hashes, 128 bits in all, and not byte
   by byte) all but the first are repeated throughout, and no byte of them has to travel.
3. The first of each context goes, where its anchor has several, to the task of its anchor. An anchor of more than HOT
   contexts is dealt by the bytes beside it too: those right of it for strings that start near it, left for the rest.
4. A task sorts the suffixes of its contexts in two stages: suffixes smaller than their successors are sorted directly, the
   rest induced by scanning the buckets; adjacent suffixes with a common prefix of LENGTH are repeats, all but the first.
5. Repeats return to their documents as byte ranges.

Texts are shuffled once (the joins reuse that exchange). A task holds one chunk of contexts; a thousand copies of a passage
cost one context and a thousand rows of four longs.

Defined results: null text is empty; texts under LENGTH bytes stay whole; rows of one doc_id are ordered by a 64-bit hash of
their text, and equal rows of one doc_id are one document, returned for each row; null doc_id counts as the least; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import arrow, read, staged

LENGTH, GRAM = 100, 32
GRAMS = LENGTH - GRAM + 1
#: Strings whose anchor lies up to so far from their start hold the bytes right of it up to BESIDE; the others those left of it.
NEAR = (LENGTH - GRAM) // 2
CHUNK = 1 << 20
HOT = 500
#: Texts whose anchors or remains a worker holds at once.
ROWS = 500
_LEAST = -(1 << 63)
_rng = np.random.Generator(np.random.PCG64(20))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = {n: np.uint64(int(_rng.integers(1, 1 << 62)) * 2 + 1) for n in (1, 2, 4, 8, 16)}
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWER = int(_rng.integers(1, 1 << 61)) * 8 + 5
_INVERSE = pow(_POWER, -1, 1 << 64)
#: A place packs the start of its first string and the number of its strings (7 bits).
_AT_SHIFT = 7


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place, by doubling."""
    h, n = _BYTE[data], 1
    while n < GRAM:
        h = h[:-n] * _STEP[n] + h[n:]
        n *= 2
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the grams, and for each LENGTH-byte string the place of its anchor."""
    h = gram_hashes(data)
    low, at, n = h, np.arange(len(h), dtype=np.int32), 1
    while n < GRAMS:
        m = min(n, GRAMS - n)
        right = low[m:] < low[:-m]
        low, at = np.where(right, low[m:], low[:-m]), np.where(right, at[m:], at[:-m])
        n += m
    return h, at


def suffix_order(t: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """All suffixes of t by their first `depth` bytes at least (ties in any order), in two stages."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    rise = np.sign(np.diff(t.astype(np.int16), append=-1))  # the end is less than any byte
    known = np.where(rise != 0, np.arange(n), n)
    rise = rise[np.minimum.accumulate(known[::-1])[::-1]]
    larger = rise < 0  # suffixes larger than their successor
    padded = np.concatenate((t, np.zeros(depth + 16, np.uint8))).astype(np.uint64)
    word = np.zeros(n + depth + 8, np.uint64)
    for j in range(8):
        word = word << np.uint64(8) | padded[j : j + len(word)]
    # first stage: the smaller suffixes, eight bytes at a time, only those still tied going on
    own = np.flatnonzero(~larger)
    own = own[np.argsort(word[own], kind="stable")]
    rank = word[own]
    new = np.concatenate(([True], rank[1:] != rank[:-1])) if len(own) else np.empty(0, bool)
    for at in range(8, depth, 8):
        group = np.cumsum(new)
        tied = ~new
        tied[:-1] |= ~new[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        ids, keys = own[where], word[own[where] + at]
        by = np.lexsort((keys, group[where]))
        own[where], keys, g = ids[by], keys[by], group[where][by]
        new[where[1:]] |= (keys[1:] != keys[:-1]) & (g[1:] == g[:-1]) & (np.diff(where) == 1)
    # second stage: scan the buckets upwards; what was just placed puts its larger predecessor into that one's bucket
    edge = np.searchsorted(t[own], np.arange(257))
    heads: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(placed: np.ndarray) -> None:
        before = placed[placed > 0] - 1
        before = before[larger[before]]
        if len(before):
            first = t[before]
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            cut = np.flatnonzero(np.diff(first)) + 1
            for part in np.split(before, cut):
                heads[t[part[0]]].append(part)

    induce(np.array([n]))
    out = []
    for c in range(256):
        done = 0
        while done < len(heads[c]):
            now = heads[c][done:]
            done = len(heads[c])
            now = np.concatenate(now)
            out.append(now)
            induce(now)
        small = own[edge[c] : edge[c + 1]]
        out.append(small)
        induce(small)
    return np.concatenate(out)


def repeats(contexts: list[bytes], counts: list[int], order: np.ndarray) -> np.ndarray:
    """Of the strings from the first counts[i] places of each context, whether an equal one stands earlier; order: of contexts."""
    t = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    starts, n = np.cumsum(sizes) - sizes, np.array(counts)
    owner = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = starts[owner] + inside
    label = np.full(len(t), -1, np.int64)
    label[at] = np.arange(len(at))
    sorted_labels = label[suffix_order(t)]
    sorted_labels = sorted_labels[sorted_labels >= 0]
    place = at[sorted_labels]
    padded = np.concatenate((t, np.zeros(8, np.uint8)))
    same = np.ones(max(0, len(place) - 1), bool)  # the common prefix of neighbours reaches LENGTH
    for j in range(LENGTH):
        live = np.flatnonzero(same)
        if not len(live):
            break
        same[live] = padded[place[live] + j] == padded[place[live + 1] + j]
    group = np.concatenate(([0], np.cumsum(~same))) if len(place) else np.empty(0, np.int64)
    first = np.lexsort((inside[sorted_labels], order[owner[sorted_labels]], group))
    head = np.concatenate(([True], group[first][1:] != group[first][:-1])) if len(first) else np.empty(0, bool)
    out = np.ones(len(at), bool)
    out[sorted_labels[first[head]]] = False
    return out


def _data(text) -> np.ndarray:
    return np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _context_hashes(data: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of the bytes of the n strings from each of the places `first`, by differences of a running polynomial."""
    size = len(data)
    up = _powers(_POWER, size)
    down = _powers(_INVERSE, size)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:size], dtype=np.uint64)))
    h = (total[first + n + LENGTH - 1] - total[first]) * down[first] + n.astype(np.uint64) * _MIX
    h ^= h >> np.uint64(31)
    return h * _MIX


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tie, text) -> (h, ctx, id, tie, place, dup) for every anchor; place packs the first string's start and their number.

    Of equal contexts in one batch all but the first are repeats for sure (dup); they get a key of their own each, so that a
    passage of very many documents is no hot key: it comes to one row a batch.
    """
    for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
        columns: list[list] = [[], [], [], [], []]
        for key, tie, text in zip(batch.column(0), batch.column(1), batch.column(2)):
            data = _data(text)
            if len(data) >= LENGTH:
                h, at = anchors(data)
                first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                n = np.diff(np.concatenate((first, [len(at)])))
                place = (first.astype(np.int64) << np.int64(_AT_SHIFT)) | n
                own = np.full(len(n), key.as_py(), np.int64), np.full(len(n), tie.as_py(), np.int64)
                for c, x in zip(columns, (h[at[first]].view(np.int64), _context_hashes(data, first, n).view(np.int64), *own, place)):
                    c.append(x)
        if columns[0]:
            h, ctx, id_, ties, place = (np.concatenate(x) for x in columns)
            by = np.lexsort((place, ties, id_, ctx, h))
            dup = np.zeros(len(h), np.int32)
            dup[by[1:]] = (h[by[1:]] == h[by[:-1]]) & (ctx[by[1:]] == ctx[by[:-1]])
            spread = ((id_.view(np.uint64) ^ ties.view(np.uint64)) * _MIX + place.view(np.uint64)) * _MIX
            h = np.where(dup == 1, (spread ^ spread >> np.uint64(32)).view(np.int64), h)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, ctx, id_, ties, place, dup)], names=["h", "ctx", "id", "tie", "place", "dup"])


_CONTEXT = "key long, id long, tie long, start int, n int, context binary"


def _emit_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tie, text, list of (h, place, hot)) -> the contexts, those of hot anchors split by what lies beside the anchor."""
    names = ["key", "id", "tie", "start", "n", "context"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for key, tie, text, places in zip(*(batch.column(i) for i in range(4))):
            raw, k, x = (text.as_py() or "").encode("utf-8", "surrogatepass"), key.as_py(), tie.as_py()
            for one in places.as_py():
                first, n = one["place"] >> _AT_SHIFT, one["place"] & (1 << _AT_SHIFT) - 1
                context = raw[first : first + n + LENGTH - 1]
                if not one["hot"]:
                    rows.append((one["h"], k, x, first, n, context))
                else:
                    p = first + int(anchors(np.frombuffer(context[:LENGTH], np.uint8))[1][0])
                    split = min(max(p - NEAR, first), first + n)  # strings from here on hold the bytes right of the anchor
                    for a, b, side, beside in ((first, split, b"l", raw[max(0, p - NEAR - 1) : p]), (split, first + n, b"r", raw[p + GRAM : p + LENGTH - NEAR])):
                        if a < b:
                            deal = hashlib.blake2b(beside + raw[p : p + GRAM], digest_size=8, person=side).digest()
                            rows.append((int.from_bytes(deal, "little", signed=True), k, x, a, b - a, raw[a : b + LENGTH - 1]))
                size += n + LENGTH
            if size > CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _emit_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by (key, context, id, tie, start) -> repeated ranges (id, tie, start, stop)."""
    out: list[tuple] = []
    held: list[tuple] = []
    size = 0
    last_key, last_context = None, None

    def flush(cut: int) -> None:
        """The repeats among held[:cut]."""
        nonlocal held, size
        rows, held = held[:cut], held[cut:]
        size = sum(len(r[4]) for r in held)
        if len(rows) > 1:
            by = sorted(range(len(rows)), key=lambda i: rows[i][:3])
            order = np.empty(len(rows), np.int64)
            order[by] = np.arange(len(rows))
            hit = repeats([r[4] for r in rows], [r[3] for r in rows], order)
            edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
            ends = np.cumsum([r[3] for r in rows])
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                while a < b:
                    i = int(np.searchsorted(ends, a, "right"))
                    c, origin = min(b, int(ends[i])), int(ends[i]) - rows[i][3]
                    out.append((rows[i][0], rows[i][1], rows[i][2] + a - origin, rows[i][2] + c - origin + LENGTH - 1))
                    a = c

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["id", "tie", "start", "stop"])

    border = 0
    for batch in batches:
        for key, id_, tie, start, n, context in zip(*(c.to_pylist() for c in batch.columns)):
            if key != last_key:
                if size > CHUNK:
                    flush(len(held))
                border = len(held)
            elif context == last_context:
                out.append((id_, tie, start, start + n + LENGTH - 1))
                continue
            last_key, last_context = key, context
            held.append((id_, tie, start, n, context))
            size += len(context)
            if size > 2 * CHUNK and border:
                flush(border)
                border = 0
        yield batch_of()
    flush(len(held))
    yield batch_of()


def _removal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, copy, ranges) -> the result and the kept bytes."""
    for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
        rows = []
        for doc, text, copy, ranges in zip(*(batch.column(i) for i in range(4))):
            data, spans = (text.as_py() or "").encode("utf-8", "surrogatepass"), []
            found = [(0, len(data))] if copy.as_py() and len(data) >= LENGTH else sorted((r["start"], r["stop"]) for r in ranges.as_py() or ())
            for a, b in found:
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            kept, at = [], 0
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            body = b"".join(kept) + data[at:]
            rows.append((doc.as_py(), len(data), len(data) - len(body), len(spans), body))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row; kept is binary, as a cut may split a character."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # both keys are never null by type: else an inner join filters its texts for that, and can't reuse the other joins' exchange
    keyed = rows.select(F.coalesce("doc_id", F.lit(_LEAST)).alias("id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie"), "text")
    digests = keyed.select("id", "tie", F.sha2("text", 256).alias("digest")).distinct()
    firsts = digests.groupBy("digest").agg(F.min(F.struct("id", "tie")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = digests.join(firsts, "digest").where(F.struct("id", "tie") != F.col("first")).select("id", "tie")
    copies = staged(copies.withColumn("copy", F.lit(True)), "repeats-copies")

    texts = keyed.select("id", "tie", "text")
    single = texts.join(copies.select("id", "tie").hint("shuffle_hash"), ["id", "tie"], "left_anti")
    placed = arrow(single, _emit_anchors, "h long, ctx long, id long, tie long, place long, dup int")
    # not by dup: a filter on a key of both windows would be pushed below the exchange, which then served one reader only
    anchor, context = Window.partitionBy("h"), Window.partitionBy("h", "ctx").orderBy("id", "tie", "place")
    placed = placed.repartition("h")  # serves both windows
    placed = placed.withColumn("first", (F.row_number().over(context) == 1).cast("int")).withColumn("contexts", F.sum("first").over(anchor))
    ends = [F.shiftright("place", _AT_SHIFT).cast("int"), F.col("place").bitwiseAND(F.lit((1 << _AT_SHIFT) - 1)).cast("int")]
    whole = placed.where("first = 0 OR dup = 1").select("id", "tie", ends[0].alias("start"), (ends[0] + ends[1] + (LENGTH - 1)).alias("stop"))
    lists = placed.where("first = 1 AND contexts > 1 AND dup = 0").select("id", "tie", F.struct("h", "place", (F.col("contexts") > HOT).alias("hot")).alias("p")).groupBy("id", "tie").agg(F.collect_list("p").alias("places"))
    dealt = arrow(texts.join(lists.hint("shuffle_hash"), ["id", "tie"]).select("id", "tie", "text", "places"), _emit_contexts, _CONTEXT)
    dealt = dealt.repartition("key").sortWithinPartitions("key", "context", "id", "tie", "start")
    ranges = arrow(dealt, _emit_repeats, "id long, tie long, start int, stop int").union(whole)
    found = ranges.groupBy("id", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"), F.lit(False).alias("copy"))
    marks = found.select("id", "tie", "ranges", "copy").union(copies.select("id", "tie", F.lit(None).cast("array<struct<start:int,stop:int>>"), "copy"))
    joined = texts.join(marks.hint("shuffle_hash"), ["id", "tie"], "left")
    doc = F.when(F.col("id") != _LEAST, F.col("id")).alias("doc_id")
    return arrow(joined.select(doc, "text", F.coalesce("copy", F.lit(False)).alias("copy"), "ranges"), _removal, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op2_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
