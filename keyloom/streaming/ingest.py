"""Late and live rows: a Structured Streaming sink that routes each micro-batch into a managed dataset."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.move import fresh_rows
from ..operators.route import route
from ..plans.config import TableConfig
from ..plans.layout import DEFAULT
from ..plans.model import Segment
from ..sources.catalog import Catalog, merged


def append_batch(catalog: Catalog, config: TableConfig, batch: DataFrame, today: date, batch_id: int | None = None, stream: str = "") -> int:
    """Routes a batch to the attached children and commits it once: an id at or below the stream's last one does nothing.

    Rows that no child takes go to default, for maintenance to drain. Keys that are stored already are left out; if the conflict
    key holds the partition key, only children that can hold the batch's keys are read for that.
    """
    t = config.table_name
    m = catalog.manifest(t)
    if batch_id is not None and m.get("batches", {}).get(stream, -1) >= batch_id:
        return 0
    stored = None
    if config.partition_key_column in config.conflict_key:
        key = F.col(config.partition_key_column)
        lo, hi = batch.agg(F.min(key).cast("string"), F.max(key).cast("string")).first()
        stored = [] if lo is None else catalog.meeting(t, lo, hi)
    fresh = fresh_rows(batch, catalog.read(t, children=stored, version=m["version"]), list(config.conflict_key), list(config.cursor))
    default = f"{t}_{DEFAULT}"
    if config.child is not None and config.layout not in ("list_split", "hash_branches"):
        routed = fresh.withColumn("child", F.lit(default))  # bounds of two levels: maintenance routes them, with both plans
    else:
        routed = route(fresh, config, catalog.attached(t), today)
    stats = catalog.write_rows(t, routed)
    for child, s in stats.items():
        name = child if child in m["children"] else default
        old = m["children"].get(name) or catalog.child_entry(Segment(default, None, None, DEFAULT), None, default=True)
        m["children"][name] = merged(old, s, catalog.key_type(m))
    seen = {"batches": m.get("batches", {}) | {stream: batch_id}} if batch_id is not None else {}
    catalog.commit(t, m | seen | {"signature": None}, m["version"])
    return sum(s["rows"] for s in stats.values())


def ingest(stream: DataFrame, catalog: Catalog, config: TableConfig, today: date, checkpoint: str) -> StreamingQuery:
    """Starts the stream; each batch is exactly once, by its id in the manifest. The checkpoint's folder names the stream."""
    return stream.writeStream.foreachBatch(lambda batch, n: append_batch(catalog, config, batch, today, n, checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
