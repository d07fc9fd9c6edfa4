"""Session defaults for local runs, and the shared folder that intermediate tables go to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Most bytes of rows of a side that adaptive execution broadcasts. The driver holds a table several times their size, twice over
#: while it is sent, and several joins of a query at once.
BROADCAST_BYTES = 1 << 20
#: Tables written by this process and not yet deleted.
_PATHS: list[str] = []


def local_session(cores: int | str = "*", app: str = "pagelens", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submitter configures Spark."""
    return prepare(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings results depend on.

    Spark 4.1 lets a union keep its children's partitioning and drops the exchange above it. When
    an exchange below the union is reused the union no longer lines partitions up, and a window or
    aggregate on top sees split groups. The setting is absent, and not needed, before 4.1.
    """
    try:
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    except Exception:  # noqa: BLE001 - unknown or static in this Spark version
        pass
    return spark


def measured_joins(spark: SparkSession) -> SparkSession:
    """Leave broadcasts to adaptive execution, which knows how large a shuffled side has become.

    Before a run Spark goes by file sizes. A few MB of packed runs or of pages can explode into
    gigabytes of pixels, which a join would then collect on the driver. Joins on more columns than a
    side is dealt by also keep that dealing: a raster dealt by page stays where it is.
    """
    static = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if static != "-1":
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(min(size_in_bytes(static), BROADCAST_BYTES)))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # runs shrink tenfold and more in a shuffle file: 8 MB of them are what a task can sort
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")
    return spark


def size_in_bytes(text: str) -> int:
    """A size as Spark's settings write it: ``10485760b``, ``256k``, ``10MB``, or plain bytes."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", text.lower()).groups()
    return int(number) << 10 * "bkmgtp".index((unit or "b")[0])


def reduce_tasks(spark: SparkSession, least: int) -> None:
    """At least so many parts of a shuffle before adaptive execution joins small ones."""
    known = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(known, least)))


def page_tasks(spark: SparkSession) -> int | None:
    """Tasks that pages are dealt over, if a corpus has set them."""
    known = spark.conf.get("spark.pagelens.tasks", None)
    return int(known) if known else None


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt over the tasks of its pages: what has one ``key`` stands in one task, and stays there for joins, windows and groups."""
    n = page_tasks(df.sparkSession)
    return df.repartition(n, key) if n else df.repartition(key)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local master may go without one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, stem: str) -> str:
    path = f"{shared_folder(spark)}/{stem}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    return path


def materialize(df: DataFrame, stem: str = "table") -> DataFrame:
    """Cut lineage through a parquet table in the shared folder.

    Compared with ``checkpoint()`` the plan runs once instead of twice, lost executors cost
    nothing that was already written, and the re-read carries real size statistics.
    """
    spark = df.sparkSession
    path = fresh_path(spark, stem)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = True
    return out


def written(df: DataFrame, stem: str = "table") -> DataFrame:
    """``df`` itself if it is such a table already, else :func:`materialize`; for inputs that are read more than once."""
    return df if getattr(df, "_written", False) else materialize(df, stem)


def release(spark: SparkSession) -> int:
    """Delete the tables that this process has written for ``spark`` so far; results that still read them must be stored before."""
    dropped = 0
    for path in [p for p in _PATHS if p.startswith(shared_folder(spark))]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        dropped += bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))
        _PATHS.remove(path)
    return dropped
