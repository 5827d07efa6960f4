"""Versioned parquet tables with the mutations that plain parquet lacks.

A table is a folder of data folders and a log with one small file per version. A version lists the data folders, one for
each partition of each write, that make up the table. Every mutation writes fresh folders and then creates the file of the
next version, which fails if another writer was faster; it is then tried again on what that writer left. So readers never
see half a change, no writer loses the work of another, and nothing that a version lists is ever overwritten.

Mutations by key rewrite only the partitions in which the batch has keys. Tables without a partition column that are
changed by key are cut into buckets of the key for that. All files go through the Hadoop file system of the root, which
must be shared by all executors and rename without overwriting, as HDFS and local folders do.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCD2_COLUMNS = ("is_current", "valid_from", "valid_to")
#: Buckets of tables that are changed by key and have no partition column; a bucket is the least that a change rewrites.
BUCKETS = 16
#: How often a mutation is tried on newer versions before it gives up.
TRIES = 20
_BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Other writers were faster each time."""


class Files:
    """Small files and folders below a root on its Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._bytes = spark._jvm.org.apache.commons.io.IOUtils
        path = self._path(root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.root = self._fs.makeQualified(path).toString()
        self._local = self._fs.makeQualified(path).toUri().getPath() if self.root.startswith("file:") else None

    def at(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def names(self, *parts: str) -> list[str]:
        path = self._path(self.at(*parts))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def read(self, *parts: str) -> str:
        stream = self._fs.open(self._path(self.at(*parts)))
        try:
            return self._bytes.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, text: str, *parts: str) -> bool:
        """A new file with all its text at once; false if it exists."""
        folder, draft = self.at(*parts[:-1]), f"_draft-{uuid.uuid4().hex}"
        self._fs.mkdirs(self._path(folder))
        if self._local:
            # Renaming would overwrite here; a link doesn't.
            below = os.path.join(self._local, *parts[:-1])
            with open(os.path.join(below, draft), "w") as out:
                out.write(text)
            try:
                os.link(os.path.join(below, draft), os.path.join(below, parts[-1]))
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(os.path.join(below, draft))
        stream = self._fs.create(self._path(f"{folder}/{draft}"))
        stream.write(text.encode())
        stream.close()
        done = not self._fs.exists(self._path(self.at(*parts))) and self._fs.rename(self._path(f"{folder}/{draft}"), self._path(self.at(*parts)))
        if not done:
            self._fs.delete(self._path(f"{folder}/{draft}"), False)
        return done

    def delete(self, *parts: str) -> None:
        self._fs.delete(self._path(self.at(*parts)), True)


class TableStore:
    """Tables under ``root``, addressed as ``schema.table``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    # --- versions ---

    def _state(self, name: str) -> dict | None:
        versions = [n for n in self.files.names(*name.split("."), "_log") if n.endswith(".json") and n[0] != "_"]
        return json.loads(self.files.read(*name.split("."), "_log", versions[-1])) if versions else None

    def _change(self, name: str, change: Callable[[dict | None], dict | None]) -> None:
        """Commits ``change`` of the current state; ``change`` runs again on a newer state if another writer was faster.
        It gives the new state, of which ``added`` is what streams read, or None if there is nothing to do."""
        for _ in range(TRIES):
            old = self._state(name)
            new = change(old)
            if new is None:
                return
            new = {"added": []} | new | {"version": (old or {"version": 0})["version"] + 1}
            if self.files.create(json.dumps(new), *name.split("."), "_log", f"{new['version']:012d}.json"):
                return
        raise Conflict(f"{name} was changed by others {TRIES} times")

    def _write(self, name: str, df: DataFrame, partition_by: str | None, bucket_key: str | None = None) -> list[str]:
        """Writes the rows to fresh folders; their names below the table, one for each partition."""
        batch = f"__batch={uuid.uuid4().hex}"
        path = self.files.at(*name.split("."), batch)
        if bucket_key:
            df, partition_by = df.withColumn(_BUCKET, bucket(bucket_key)).repartition(_BUCKET), _BUCKET
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
        below = [n for n in self.files.names(*name.split("."), batch) if "=" in n] if partition_by else []
        return [f"{batch}/{n}" for n in below] if partition_by else [batch]

    def exists(self, name: str) -> bool:
        return self._state(name) is not None

    def version(self, name: str) -> int:
        return (self._state(name) or {"version": 0})["version"]

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(self._state(name)["schema"])

    def _load(self, name: str, schema: T.StructType, parts: Iterable[str]) -> DataFrame:
        """One reader over data folders, so the plan doesn't grow with their number."""
        folder, parts = self.files.at(*name.split(".")), [*parts]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", folder).parquet(*[f"{folder}/{p}" for p in parts])

    def read(self, name: str) -> DataFrame:
        state = self._state(name)
        if state is None:
            raise FileNotFoundError(f"no table {name}")
        schema = T.StructType.fromJson(state["schema"])
        return self._load(name, schema, [p["path"] for p in state["parts"]]).select(*schema.names)

    def read_or_empty(self, name: str, schema: T.StructType) -> DataFrame:
        return self.read(name) if self.exists(name) else self.spark.createDataFrame([], schema)

    def commits(self, name: str) -> DataFrame:
        """The versions of a table as a stream; ``added`` reads the rows that a batch of them brings."""
        log = self.files.at(*name.split("."), "_log")
        return self.spark.readStream.schema("version long, added array<string>").json(log)

    def added(self, name: str, commits: DataFrame) -> DataFrame:
        """The rows that were appended in the given versions. The driver reads one name per data folder."""
        schema = self.schema(name)
        parts = [p for r in commits.orderBy("version").collect() for p in r["added"] or []]
        return self._load(name, schema, parts).select(*schema.names)

    def vacuum(self, name: str, keep: int = 1) -> int:
        """Removes the data folders that none of the last ``keep`` versions lists, and older versions; returns the number
        of folders. Readers and streams must be done with older versions."""
        table = name.split(".")
        log = [n for n in self.files.names(*table, "_log") if n.endswith(".json")]
        live = {p["path"] for n in log[-keep:] for p in json.loads(self.files.read(*table, "_log", n))["parts"]}
        roots, stale = {p.split("/")[0] for p in live}, 0
        for batch in self.files.names(*table):
            if not batch.startswith("__batch="):
                continue
            below = [n for n in self.files.names(*table, batch) if "=" in n] or [None]
            if batch not in roots:
                self.files.delete(*table, batch)
                stale += len(below)
                continue
            for n in below:
                if n and f"{batch}/{n}" not in live and batch not in live:
                    self.files.delete(*table, batch, n)
                    stale += 1
        for n in log[:-keep]:
            self.files.delete(*table, "_log", n)
        return stale

    def compact(self, name: str, most: int = 32) -> int:
        """Joins the data folders of each partition that has more than ``most``; returns the number of partitions."""
        joined = 0

        def change(state: dict | None) -> dict | None:
            nonlocal joined
            groups = defaultdict(list)
            for p in (state or {"parts": []})["parts"]:
                groups[p["path"].partition("/")[2]].append(p["path"])
            many = {p for g in groups.values() if len(g) > most for p in g}
            joined = sum(len(g) > most for g in groups.values())
            if not many:
                return None
            schema = T.StructType.fromJson(state["schema"])
            rows = self._load(name, schema, sorted(many)).select(*schema.names)
            fresh = self._write(name, rows, state["partition_by"], state["bucket_key"])
            return state | {"parts": [*[p for p in state["parts"] if p["path"] not in many], *_parts(fresh)], "added": []}

        self._change(name, change)
        return joined

    # --- mutations ---

    def overwrite(self, name: str, df: DataFrame, partition_by: str | None = None) -> None:
        fresh = _parts(self._write(name, df, partition_by))
        self._change(name, lambda _: {"parts": fresh, "schema": df.schema.jsonValue(), "partition_by": partition_by, "bucket_key": None})

    def append(self, name: str, df: DataFrame, partition_by: str | None = None, batch_id: int | str | None = None) -> None:
        """Adds rows by name; new columns join the schema and are null in older rows.

        A replayed batch, one with a ``batch_id`` that the table has, takes the place of the first one.
        """
        now = self._state(name) or {"schema": T.StructType().jsonValue(), "partition_by": partition_by}
        label, kept_by = None if batch_id is None else str(batch_id), now["partition_by"]
        df = _as_before(df, T.StructType.fromJson(now["schema"]))
        fresh = _parts(self._write(name, df, kept_by), label)

        def change(state: dict | None) -> dict:
            state = state or {"parts": [], "schema": df.schema.jsonValue(), "partition_by": kept_by, "bucket_key": None}
            old = T.StructType.fromJson(state["schema"])
            wider = T.StructType([*old, *[f for f in df.schema if f.name not in old.names]])
            parts = [p for p in state["parts"] if label is None or p["batch"] != label]
            return state | {"parts": parts + fresh, "schema": wider.jsonValue(), "added": [p["path"] for p in fresh]}

        self._change(name, change)

    def _touched(self, name: str, state: dict, hit: Callable[[DataFrame], DataFrame]) -> list[str]:
        """Data folders of the rows that ``hit`` keeps. One name per folder comes to the driver."""
        schema = T.StructType.fromJson(state["schema"])
        paths = [p["path"] for p in state["parts"]]
        if not paths:
            return []
        rows = self._load(name, schema, paths)
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"(__batch=[^/]+(?:/[^/]*=[^/]*)?)/[^/]+$", 1)
        found = hit(rows.withColumn("__folder", folder)).select("__folder").distinct().collect()
        known = {*paths}
        return sorted({p for r in found for p in (r[0], unquote(r[0])) if p in known})

    def _rewrite(self, name: str, state: dict, touched: Iterable[str], rows: Callable[[DataFrame], DataFrame]) -> dict:
        """The state after the touched folders were replaced by what ``rows`` makes of them."""
        touched, schema = {*touched}, T.StructType.fromJson(state["schema"])
        df = _as_before(rows(self._load(name, schema, sorted(touched)).select(*schema.names)), schema)
        fresh = _parts(self._write(name, df, state["partition_by"], state["bucket_key"]))
        return state | {"parts": [*[p for p in state["parts"] if p["path"] not in touched], *fresh], "schema": df.schema.jsonValue(), "added": []}

    def _by_key(self, name: str, batch: DataFrame, key: str, partition_by: str | None, rows: Callable[[DataFrame | None], DataFrame]) -> None:
        """Replaces the folders in which the batch has keys by ``rows`` of them; None stands for a new table."""

        def change(state: dict | None) -> dict:
            if state is None:
                first = rows(None)
                buckets = None if partition_by else key
                return {"parts": _parts(self._write(name, first, partition_by, buckets)), "schema": first.schema.jsonValue(), "partition_by": partition_by, "bucket_key": buckets}
            if state["bucket_key"] == key:
                numbers = {f"{_BUCKET}={r[0]}" for r in batch.select(bucket(key)).distinct().collect()}
                touched = [p["path"] for p in state["parts"] if p["path"].partition("/")[2] in numbers]
            else:
                touched = self._touched(name, state, lambda current: current.join(batch.select(key).distinct(), key, "left_semi"))
            return self._rewrite(name, state, touched, rows)

        self._change(name, change)

    def upsert(self, name: str, batch: DataFrame, key: str, partition_by: str | None = None) -> None:
        """Rows of the batch replace the rows of their key; other keys are added; the batch always wins.

        Null keys never match, so such rows are added each time. A batch with a repeated non-null key is rejected.
        """
        batch = batch.persist()
        try:
            if not batch.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").isEmpty():
                raise ValueError(f"the batch repeats values of {key}")
            self._by_key(name, batch, key, partition_by, lambda current: batch if current is None else upserted(current, batch, key))
        finally:
            batch.unpersist()

    def replace_partition(self, name: str, df: DataFrame, column: str, value) -> None:
        """The rows of one partition value become ``df``; an empty ``df`` empties the partition."""

        def change(state: dict | None) -> dict:
            if state is None:
                return {"parts": _parts(self._write(name, df, column)), "schema": df.schema.jsonValue(), "partition_by": column, "bucket_key": None}
            same = F.col(column).eqNullSafe(F.lit(value).cast(T.StructType.fromJson(state["schema"])[column].dataType))
            touched = self._touched(name, state, lambda rows: rows.filter(same))
            return self._rewrite(name, state, touched, lambda rows: rows.filter(~same).unionByName(df, allowMissingColumns=True))

        self._change(name, change)

    def scd2_merge(self, name: str, batch: DataFrame, key: str, effective: str) -> None:
        """One commit of ``scd2_merged``: idempotent, safe against late batches, one current row per key."""
        self._by_key(name, batch, key, None, lambda current: scd2_merged(current, batch, key, effective))


def bucket(key: str, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int").alias(_BUCKET)


def _as_before(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns that the table has are cast to their types there."""
    types = {f.name: f.dataType for f in schema}
    return df.select(*[F.col(f"`{f.name}`").cast(types.get(f.name, f.dataType)).alias(f.name) for f in df.schema])


def _parts(paths: Iterable[str], batch: str | None = None) -> list[dict]:
    return [{"path": p, "batch": batch} for p in paths]


def upserted(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """``target`` with the rows of ``batch`` put in by key. Only keys are compared; the batch side is reduced to them."""
    kept = target.join(batch.select(key).distinct(), key, "left_anti").select(*target.columns)
    return kept.unionByName(batch, allowMissingColumns=True)


def scd2_latest(batch: DataFrame, key: str, effective: str) -> DataFrame:
    """The newest row of each key. Ties on ``effective`` are broken by the other columns, so the choice is stable."""
    ties = [F.col(c).desc_nulls_last() for c in batch.columns if c not in (key, effective)]
    newest = Window.partitionBy(key).orderBy(F.col(effective).desc_nulls_last(), *ties)
    return batch.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")


def scd2_blockers(target: DataFrame, latest: DataFrame, key: str, effective: str) -> DataFrame:
    """Keys of which the current row is as new as the batch's row, or newer."""
    current = target.filter("is_current").select(F.col(key), F.col(effective).alias("__have"))
    return current.join(latest.select(key, F.col(effective).alias("__new")), key).filter("__have >= __new").select(key).distinct()


def scd2_to_insert(target: DataFrame, latest: DataFrame, key: str, effective: str) -> DataFrame:
    return latest.join(scd2_blockers(target, latest, key, effective), key, "left_anti")


def scd2_merged(target: DataFrame | None, batch: DataFrame, key: str, effective: str) -> DataFrame:
    """History after a batch: the newest row per key closes an older current row and becomes current itself; a row that
    isn't newer than the current one changes nothing."""
    latest = scd2_latest(batch, key, effective)
    opened = lambda df: df.withColumns({"is_current": F.lit(True), "valid_from": F.col(effective), "valid_to": F.lit(None).cast("timestamp")})
    if target is None:
        return opened(latest)
    starts = latest.select(F.col(key), F.col(effective).alias("__new"))
    closing = F.col("is_current") & F.coalesce(F.col("__new") > F.col(effective), F.lit(False))
    closed = (
        target.join(starts, key, "left")
        .withColumn("__close", closing)
        .withColumns({"valid_to": F.when(F.col("__close"), F.col("__new")).otherwise(F.col("valid_to")), "is_current": F.col("is_current") & ~F.col("__close")})
        .select(*target.columns)
    )
    return closed.unionByName(opened(scd2_to_insert(target, latest, key, effective)), allowMissingColumns=True)
