"""Sessions and the shared folder for checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; for tests and single machines."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; a temporary one on a single machine without it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="entspark-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` written to the shared folder: its lineage ends there, and lost executors lose nothing of it."""
    if frame._jdf.queryExecution().logical().getClass().getSimpleName() == "LogicalRDD":
        return frame  # nothing has been done to it since it was written
    shared_dir(frame.sparkSession)
    return frame.checkpoint()


#: Bytes, as the optimizer estimates them, of what one task of a wide step takes.
TASK_BYTES = 4 << 20
_MOST_PARTS = 10_000


def parts(*frames: DataFrame) -> int:
    """Into how many parts frames go: as many as their size asks for, the session's number at least, so that a task's share doesn't grow with the input.

    The estimate follows from the files' sizes and needs no pass; where there is
    none (rows of unknown origin, products of joins) it's the session's number.
    """
    least = int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = sum(int(str(f._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for f in frames)
    return max(least, min(-(-size // TASK_BYTES), _MOST_PARTS)) if size < _MOST_PARTS * TASK_BYTES * 8 else least


def spread(frame: DataFrame, n: int, *keys: str) -> DataFrame:
    """``frame`` by hash of ``keys`` in ``n`` parts; as it is where ``n`` is the session's number, as any join or sum then does so itself."""
    return frame if n <= int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")) else frame.repartition(n, *keys)
