"""What the corpus operators share: table reads, staged tables, free column names, word splitting."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of all contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SEPARATOR = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset a local session gets a folder of its own; a cluster's executors would not see that, so there it raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            found = jvm_dir.get()
        elif spark.sparkContext.master.startswith("local["):
            found = tempfile.mkdtemp(prefix="keyloom-")
            spark.sparkContext.setCheckpointDir(found)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, as a zip in the shared folder."""
    context = spark.sparkContext
    if getattr(context, "_keyloom_shipped", False):
        return
    root, packed = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    path = f"{shared_dir(spark)}/keyloom-{uuid.uuid4().hex}.zip"
    fs, p = _file_system(spark, path)
    stream = fs.create(p, False)
    try:
        stream.write(bytearray(packed.getvalue()))
    finally:
        stream.close()
    fs.deleteOnExit(p)
    context.addPyFile(path)
    context._keyloom_shipped = True


def arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow, with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is staged inside, unless kept, is removed at the end; only for work whose result is written inside as well."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            fs, p = _file_system(spark, path)
            fs.delete(p, True)


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written as Parquet in the shared folder and read back: computed once, lineage cut, survives lost executors.

    The folder goes with the enclosing `scratch`, else (or if kept) with the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _open and not keep:
        _open[-1].append(path)
    else:
        fs, p = _file_system(spark, path)
        fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *stems: str) -> list[str]:
    """For each stem a column name that df does not have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def words(text: Column) -> Column:
    """array<string> of the words `[^\\x20\\x09-\\x0D]+`; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SEPARATOR))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body and its lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fits_broadcast(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows; reads no more than that many."""
    return df.limit(max_rows + 1).count() <= max_rows
