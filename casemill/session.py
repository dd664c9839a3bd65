"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables, under the shared `spark.checkpoint.dir`.

    Only a local-mode session without that setting gets a temporary folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="casemill-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's own setting that removes a query's shuffle files when the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, path: str) -> None:
    """Write a Parquet table; the shuffle files behind it go as soon as it is whole."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table in the scratch folder: cuts the lineage durably."""
    path = scratch_dir(df.sparkSession, name)
    store(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Stored:
    """Intermediate tables of one job, each removed once nothing reads it any more.

    A table may be dropped when every table made from it is stored: stored rows need no lineage, so
    an executor lost later asks for nothing that is gone.
    """

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._paths: dict[str, str] = {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of `df` read back from a new table; an older one of that name goes."""
        path = scratch_dir(self._spark, name)
        store(df, path)
        self.drop(name)
        self._paths[name] = path
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self._paths.pop(name, None):
                folder = self._spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Stored bytes of a part that needs no spreading, as the runtime sizes its own.
PART_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over tasks, for costly work per row after a scan of few or uneven files.

    A stated number of parts, which the runtime does not merge by their bytes: one a core. By the
    optimizer's estimate, without a job; inputs that fill all cores anyway stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size >= cores * PART_BYTES else df.repartition(cores)


def for_costly_rows(df: DataFrame) -> DataFrame:
    """Rows in as many parts as the session shuffles into, or one per core if that is more.

    After an aggregation the runtime merges parts by their bytes. For short texts that each take
    long to process that leaves far too few tasks; a stated number of parts is not merged.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, spark.sparkContext.defaultParallelism))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
