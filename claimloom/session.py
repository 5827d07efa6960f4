"""Session factory and the settings that every operator relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Set on sessions built here. Sessions built elsewhere keep their own sizes; only the time zone is required.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.enableVectorizedReader": "true",
    "spark.ui.showConsoleProgress": "false",
}

#: Unions of equally partitioned inputs are zipped by this Spark version, which fails where adaptive execution gives the
#: inputs different numbers of partitions.
_UNION = "spark.sql.unionOutputPartitioning"


def get_spark(app_name: str = "claimloom", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A UTC session with adaptive execution; existing sessions are reused."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | (conf or {})).items():
        builder = builder.config(key, value)
    return guarded(builder.getOrCreate())


def guarded(spark: SparkSession) -> SparkSession:
    """The session with plain unions (see ``_UNION``), whose Python workers can import this package."""
    spark.conf.set(_UNION, "false")
    _ship(spark)
    return spark


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once an application, unless their path already has it."""
    root = Path(__file__).resolve().parents[1]
    on_path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if root in on_path or Path.cwd() == root and context.master.startswith("local[") or context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="claimloom-")) / "claimloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in (root / "claimloom").rglob("*.py"):
            z.write(source, source.relative_to(root))
    context.addPyFile(str(archive))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's own setting, or a local folder where none is set (tests)."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix=f"claimloom-{os.getpid()}-")
    context.setCheckpointDir(folder)
    return folder


_stored: dict[str, list[str]] = {}


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a table in the shared checkpoint folder, where the loss of an executor can't undo it.
    The table stays until ``clear_stored``, as frames read from it may be evaluated at any later time."""
    context = df.sparkSession.sparkContext
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/claimloom/{uuid.uuid4().hex}"
    _stored.setdefault(context.applicationId, []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> int:
    """Deletes what ``stored`` has written in this application; call it when no frame of it is needed any more."""
    paths = _stored.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)


def dealt(df: DataFrame) -> DataFrame:
    """An input of a single partition, such as one small or unsplittable file, dealt to all cores before costly work on its
    rows; any other input stays as it is. Rows keep deterministic places, so retries see the same rows. Inputs that come
    from a shuffle are not looked at, as asking for their partitions would compute them."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString() or df.rdd.getNumPartitions() != 1:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def row_hash(df: DataFrame) -> Column:
    """A hash of the rows by their columns of plain types; maps can't be hashed."""
    plain = [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain], F.lit(0))


#: Parts over which ``salted_join`` spreads each value of the key.
SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, key: str, salt: Column, salts: int = SALTS) -> DataFrame:
    """Left join on ``key`` where a value of it may hold most rows of ``left``: each value is spread over ``salts`` parts
    by a hash of ``salt``, and ``right``, which must have one row a value, comes to each part. Null keys match nothing
    and are spread too."""
    w = free_prefix(left, right)
    part = F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int")
    many = right.withColumnRenamed(key, f"{w}key").withColumn(f"{w}many", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    joined = left.withColumn(f"{w}part", part).join(many, (F.col(key) == F.col(f"{w}key")) & (F.col(f"{w}part") == F.col(f"{w}many")), "left")
    return joined.drop(f"{w}key", f"{w}part", f"{w}many")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of a data folder."""
    return guarded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free_prefix(*frames: DataFrame) -> str:
    """A prefix that no column of the frames has, for the working columns of an operator."""
    prefix, names = "__w", [c.lower() for f in frames for c in f.columns]
    while any(n.startswith(prefix) for n in names):
        prefix += "_"
    return prefix
