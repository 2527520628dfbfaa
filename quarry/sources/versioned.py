"""Tables kept as versions: copy-on-write files and one manifest per version.

A store is a folder with any number of tables. A version is a small JSON manifest that names, per
table and bucket, the folder that holds the bucket's rows; files are never changed once written. A
commit writes the touched buckets to new folders, then the manifest beside its place, and renames it
to ``versions/<number>``: the rename is the commit, and fails if another writer has taken the
number. A crash before it leaves files that no manifest names. Readers take one manifest and see that
version of all tables, whatever is committed meanwhile.

The driver holds the manifest (a row per bucket) and nothing of the tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The bucket's number while rows are written; not a column of the tables.
BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer committed the version first; nothing of this commit is visible."""


@dataclass
class Change:
    """What a commit does to one table.

    ``upserts`` replace the rows of their keys, ``deletes`` (the key columns) remove theirs, or
    ``merge`` makes a touched bucket's new rows from its rows and the upserts. ``replace`` writes the
    whole table anew. Keys are compared null-safe.
    """

    upserts: DataFrame | None = None
    deletes: DataFrame | None = None
    merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    replace: DataFrame | None = None


@dataclass
class Snapshot:
    """One version of all tables of a store."""

    spark: SparkSession
    path: str
    version: int = 0
    tables: dict = field(default_factory=dict)
    applied: dict = field(default_factory=dict)

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The table as of this version, or only some of its buckets."""
        t = self.tables[name]
        schema = T.StructType.fromJson(t["schema"])
        folders = [f"{self.path}/{f}" for b, f in sorted(t["folders"].items()) if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)


def bucket_of(keys: list[str], buckets: int) -> Column:
    """Bucket of a row, by its keys: a large repository or user spreads over all buckets."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _read_text(spark: SparkSession, path: str) -> str:
    at, fs = _fs(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a file whole or not at all, and never over another: a rename that doesn't overwrite."""
    jvm = spark._jvm
    to, fs = _fs(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, False)
    out.write(bytearray(text.encode()))
    out.close()
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(),
                                                                  spark._jsc.hadoopConfiguration())
    try:
        context.rename(tmp, to, none)
    except Exception as error:
        fs.delete(tmp, False)
        if "FileAlreadyExists" in str(error):
            raise Conflict(f"version exists: {path}") from error
        raise


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions, ascending."""
    at, fs = _fs(spark, f"{path}/versions")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n) for n in names if n.isdigit())


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The newest version (an empty one, number 0, before the first commit) or a stated one."""
    if version is None:
        version = max(versions(spark, path), default=0)
    if version == 0:
        return Snapshot(spark, path)
    m = json.loads(_read_text(spark, f"{path}/versions/{version:012d}"))
    return Snapshot(spark, path, version, m["tables"], m["applied"])


def _write_buckets(df: DataFrame, path: str, folder: str, keys: list[str], buckets: int) -> dict[str, str]:
    """Rows in one new folder per bucket: bucket -> folder."""
    spark = df.sparkSession
    (df.withColumn(BUCKET, bucket_of(keys, buckets)).repartitionByRange(BUCKET, *keys)
     .write.partitionBy(BUCKET).parquet(f"{path}/{folder}"))
    at, fs = _fs(spark, f"{path}/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    return {n.split("=", 1)[1]: f"{folder}/{n}" for n in names if n.startswith(BUCKET + "=")}


def _changed(base: Snapshot, name: str, change: Change, keys: list[str], buckets: int) -> tuple[DataFrame, list[int] | None]:
    """New rows of the touched buckets, and which these are (None: the whole table)."""
    if change.replace is not None:
        return change.replace, None
    parts = [d.select(bucket_of(keys, buckets).alias("b")) for d in (change.upserts, change.deletes) if d is not None]
    some = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    touched = sorted(r.b for r in some.distinct().collect())  # at most ``buckets`` numbers
    if name not in base.tables:
        none = base.spark.createDataFrame([], change.upserts.schema)
        return (change.merge(none, change.upserts) if change.merge else change.upserts), None
    rows = base.read(name, touched)
    if change.merge is not None:
        return change.merge(rows, change.upserts), touched
    for gone in (change.deletes, change.upserts):
        if gone is not None:
            # Renamed, so that a frame made from this very table is told apart.
            other = gone.select(*[F.col(k).alias("_k_" + k) for k in keys]).distinct()
            on = F.lit(True)
            for k in keys:
                on = on & F.col(k).eqNullSafe(F.col("_k_" + k))
            rows = rows.join(other, on, "left_anti")
    if change.upserts is not None:
        rows = rows.unionByName(change.upserts.select(*rows.columns))
    return rows, touched


def commit(base: Snapshot, changes: dict[str, Change], keys: dict[str, list[str]], buckets: dict[str, int],
           applied: dict[str, int] | None = None) -> Snapshot:
    """All ``changes`` as the version after ``base``, or none of them.

    ``keys`` and ``buckets`` (choose about 1 GB a bucket) count for tables that are new; a table
    keeps its own. ``applied`` records stream batches: a batch that ``base`` has applied already
    changes nothing, so a retried batch is applied once. Raises :class:`Conflict` if another writer
    was first: take a new snapshot and try again.
    """
    applied = applied or {}
    if applied and all(base.applied.get(s, -1) >= b for s, b in applied.items()):
        return base
    spark, tables = base.spark, dict(base.tables)
    for name, change in changes.items():
        old = tables.get(name)
        own_keys, n = (old["keys"], old["buckets"]) if old else (keys[name], buckets[name])
        # Read several times below, and again by the sample for the ranges: made once.
        kept_once = {k: d.persist(StorageLevel.MEMORY_AND_DISK) for k in ("upserts", "deletes")
                     if (d := getattr(change, k)) is not None and d.storageLevel == StorageLevel.NONE}
        try:
            rows, touched = _changed(base, name, replace(change, **kept_once), own_keys, n)
            folder = f"data/{name}-{base.version + 1}-{uuid.uuid4().hex[:12]}"
            written = _write_buckets(rows, base.path, folder, own_keys, n)
        finally:
            for d in kept_once.values():
                d.unpersist()
        kept = {} if touched is None else {b: f for b, f in old["folders"].items() if int(b) not in touched}
        schema = rows.schema.jsonValue() if touched is None else old["schema"]
        tables[name] = {"schema": schema, "keys": own_keys, "buckets": n, "folders": {**kept, **written}}
    version = base.version + 1
    made = Snapshot(spark, base.path, version, tables, {**base.applied, **applied})
    _publish(spark, f"{base.path}/versions/{version:012d}",
             json.dumps({"version": version, "tables": tables, "applied": made.applied}))
    return made


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Forget all but the newest ``keep`` versions and delete the folders that only these named.

    Folders that no manifest names are left alone: they may belong to a commit under way.
    """
    numbers = versions(spark, path)
    old, kept = numbers[:-keep], numbers[-keep:]
    named = lambda ns: {f for n in ns for t in snapshot(spark, path, n).tables.values() for f in t["folders"].values()}
    gone = sorted(named(old) - named(kept))
    for n in old:
        at, fs = _fs(spark, f"{path}/versions/{n:012d}")
        fs.delete(at, False)
    for f in gone:
        at, fs = _fs(spark, f"{path}/{f}")
        fs.delete(at, True)
    return gone
