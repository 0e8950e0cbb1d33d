"""Merkle fixity audit of WARC replicas, in DataFrame operations only.

Records lie in files of FILE_RECORDS, ordered by their offset. A leaf is the SHA-256 of one record's bytes with its offset
range; a node is the SHA-256 of its up to FANOUT children's digests in order; the root of each file is a leaf of the
collection's tree. Two replicas are compared root first: only the children of nodes that differ are looked at, so a sound
replica costs one comparison, and each corrupt record is found in log(records) steps. Both trees get the height that the
larger replica needs (a smaller one has only children above its root), so replicas of any sizes are compared so.

Each level is one aggregation by the level above; no group has more than FANOUT children. The trees are staged, level by
level, and a level's comparison reads only its own rows. The leaves that differ are then told apart: `corrupt` (other bytes),
`moved` (the same bytes at another place), `missing` (the replica lacks the record) and `extra` (only the replica has it).

Defined results: null url or html are empty; records of equal id are ordered by their digest, so ties and repeated rows keep
one order; records without id are dealt to NULL_FILES files by their url; empty tables give an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import read, staged

FILE_RECORDS, FANOUT, COLLECTION, DAMAGE, NULL_FILES = 1024, 16, -1, 251, 4096
#: Makes the numbers of all files non-negative: those of records without id come first.
FIRST_FILE = NULL_FILES + 2


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC/1.0 resource record as text; its UTF-8 bytes are the record."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def manifest(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """file, ordinal, page_id, start, stop, digest of every record, as written: files hold FILE_RECORDS consecutive ids."""
    rec = record_bytes(F.col(page_id), F.col(url), F.col(html))
    head = F.conv(F.substr(F.md5(F.coalesce(F.col(url), F.lit("")).cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("long")
    file = F.coalesce(F.floor(F.col(page_id) / FILE_RECORDS).cast("long"), -2 - head % NULL_FILES)
    rows = pages.select(F.col(page_id).alias("page_id"), file.cast("long").alias("file"), F.octet_length(rec).cast("long").alias("size"), F.sha2(rec, 256).alias("digest"))
    order = Window.partitionBy("file").orderBy("page_id", "digest")
    stop = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("file", (F.row_number().over(order) - 1).cast("long").alias("ordinal"), "page_id", (stop - F.col("size")).alias("start"), stop.alias("stop"), "digest")


def _parents(level: DataFrame) -> DataFrame:
    """One level up: (file, node, hash), each of up to FANOUT children in order."""
    rows = level.groupBy("pfile", "pnode").agg(F.sort_array(F.collect_list(F.struct("file", "node", "hash"))).alias("c"))
    return rows.select(F.col("pfile").alias("file"), F.col("pnode").alias("node"), F.sha2(F.array_join(F.transform("c", lambda x: x["hash"]), ""), 256).alias("hash"))


def _level(nodes: DataFrame, pfile: Column, place: Column, name: str) -> DataFrame:
    return staged(nodes.select("file", "node", "hash", pfile.cast("long").alias("pfile"), F.floor(place / FANOUT).cast("long").alias("pnode")), name)


def heights(*replicas: DataFrame) -> tuple[int, int]:
    """Levels above the records in a file, and above the files' roots: those that the largest of the replicas needs."""
    most, files = 0, 0
    for r in replicas:
        top, hi = r.agg(F.coalesce(F.max("ordinal"), F.lit(0)), F.coalesce(F.max("file"), F.lit(0))).first()
        most, files = max(most, top), max(files, hi + FIRST_FILE)
    levels = lambda n: max(1, math.ceil(math.log(n + 1, FANOUT) - 1e-12))
    return levels(most), levels(files)


def tree(records: DataFrame, name: str, height: tuple[int, int]) -> list[DataFrame]:
    """Levels from the records up to the single root: (file, node, hash) and the parent's (pfile, pnode).

    Above the files' roots, file is COLLECTION and nodes number the files.
    """
    leaf = F.sha2(F.concat_ws(":", F.col("start").cast("string"), F.col("stop").cast("string"), "digest"), 256)
    nodes, levels = records.select("file", F.col("ordinal").alias("node"), leaf.alias("hash")), []
    for _ in range(height[0]):
        levels.append(_level(nodes, F.col("file"), F.col("node"), f"{name}-{len(levels)}"))
        nodes = _parents(levels[-1])
    nodes = nodes.select("file", "node", "hash")
    # the files' roots, dealt to the collection's tree
    levels.append(_level(nodes, F.lit(COLLECTION), F.col("file") + FIRST_FILE, f"{name}-roots"))
    for _ in range(height[1]):
        levels.append(_level(_parents(levels[-1]), F.lit(COLLECTION), F.col("node"), f"{name}-{len(levels)}"))
    return levels


def compare(one: list[DataFrame], two: list[DataFrame]) -> tuple[DataFrame, list[int]]:
    """(file, node) of the records that differ, and how many nodes each level compared, from the root down."""
    suspect, looked = None, []
    for i in range(len(one) - 1, -1, -1):
        a, b = (x[i] if suspect is None else x[i].join(suspect, ["pfile", "pnode"], "left_semi") for x in (one, two))
        both = a.select("file", "node", "hash").join(b.select("file", "node", F.col("hash").alias("other")), ["file", "node"], "full")
        both = staged(both.select(F.col("file").alias("pfile"), F.col("node").alias("pnode"), (~F.col("hash").eqNullSafe(F.col("other"))).alias("differ")), f"fixity-{i}")
        looked.append(both.count())
        suspect = both.where("differ").select("pfile", "pnode")
    return suspect.select(F.col("pfile").alias("file"), F.col("pnode").alias("node")), looked


def findings(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """The records at places that differ, each once: the primary's columns (the replica's for `extra`) and `status`."""
    height = heights(primary, replica)
    bad, _ = compare(tree(primary, "fixity-primary", height), tree(replica, "fixity-replica", height))
    bad = bad.select("file", F.col("node").alias("ordinal"))
    columns = ["file", "ordinal", "page_id", "start", "stop", "digest"]
    there = [F.coalesce("page_id", F.lit(0)).alias("id"), F.col("page_id").isNull().alias("no_id")]
    sides = []
    for records in (primary, replica):
        own = records.join(bad, ["file", "ordinal"], "left_semi")
        # equal records of one file are told apart by their order
        nth = F.row_number().over(Window.partitionBy("file", "digest", "page_id").orderBy("ordinal"))
        sides.append(own.select(F.struct(*columns).alias("r"), "file", "digest", nth.alias("nth"), *there))
    keys = ["file", "id", "no_id", "digest", "nth"]
    both = sides[0].withColumnRenamed("r", "p").join(sides[1].withColumnRenamed("r", "q"), keys, "full")
    both = staged(both, "fixity-suspects")
    moved = both.where("p IS NOT NULL AND q IS NOT NULL AND (p.ordinal != q.ordinal OR p.start != q.start)").select("p.*", F.lit("moved").alias("status"))
    # what is left over: other bytes under the same id, or no counterpart at all
    rest = both.where("p IS NULL OR q IS NULL").withColumn("side", F.col("p").isNull())
    at = F.row_number().over(Window.partitionBy("file", "id", "no_id", "side").orderBy(F.coalesce("p.ordinal", "q.ordinal")))
    rest = rest.withColumn("at", at).select("file", "id", "no_id", "at", "p", "q", "side")
    lost, found = rest.where("NOT side").drop("q", "side"), rest.where("side").drop("p", "side")
    paired = lost.join(found, ["file", "id", "no_id", "at"], "full")
    status = F.when(F.col("p").isNull(), "extra").when(F.col("q").isNull(), "missing").otherwise("corrupt")
    return moved.union(paired.select(F.coalesce("p", "q").alias("r"), status.alias("status")).select("r.*", "status"))


def damaged(pages: DataFrame, html: str = "html") -> DataFrame:
    """A replica for drills: the records whose html's leading MD5 bits are a multiple of DAMAGE have their first character replaced."""
    body = F.coalesce(F.col(html), F.lit(""))
    hit = (F.conv(F.substr(F.md5(body.cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("long") % DAMAGE == 0) & (F.length(body) > 0)
    return pages.withColumn(html, F.when(hit, F.concat(F.when(body.startswith("#"), "!").otherwise("#"), F.substr(body, F.lit(2)))).otherwise(F.col(html)))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Manifest rows of the primary, then those only the replica has, with `status` (sound or as in findings) and `corrupt`."""
    found = staged(findings(primary, replica), "fixity-findings")
    marked = primary.join(found.where("status != 'extra'").select("file", "ordinal", "status"), ["file", "ordinal"], "left").withColumn("status", F.coalesce("status", F.lit("sound")))
    return marked.unionByName(found.where("status = 'extra'")).withColumn("corrupt", F.col("status") == "corrupt")


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of a replica of all pages with planted damage: one row a record."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    primary = staged(manifest(pages), "fixity-manifest")
    replica = staged(manifest(damaged(pages)), "fixity-manifest")
    return audit(primary, replica).select("page_id", F.col("file").alias("warc_file"), "ordinal", "start", "stop", "digest", "corrupt")



_RECORD = """'WARC/1.0' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || e || 'WARC-Target-URI: ' || coalesce(url, '')
  || e || 'Content-Type: text/html' || e || 'Content-Length: ' || CAST(strlen(body) AS VARCHAR) || e || e || body || e || e"""
#: Holds where the first character of a damaged html is one byte, as in `<`; a longer one would move the offsets behind it.
OP1_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, chr(13) || chr(10) AS e FROM pages),
r AS (SELECT page_id, coalesce(page_id // {FILE_RECORDS}, -2 - CAST('0x' || substr(md5(coalesce(url, '')), 1, 8) AS BIGINT) % {NULL_FILES}) AS warc_file, {_RECORD} AS rec,
  length(body) > 0 AND CAST('0x' || substr(md5(body), 1, 8) AS BIGINT) % {DAMAGE} = 0 AS corrupt FROM p),
d AS (SELECT page_id, warc_file, strlen(rec) AS size, sha256(rec) AS digest, corrupt FROM r),
o AS (SELECT *, row_number() OVER w - 1 AS ordinal, CAST(sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM d WINDOW w AS (PARTITION BY warc_file ORDER BY page_id, digest))
SELECT page_id, warc_file, ordinal, CAST(stop - size AS BIGINT) AS start, stop, digest, corrupt FROM o
"""
