"""Stage boundaries of long plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(session: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``, which driver and executors share.

    Where none is set, a local session (tests) gets a temporary one; a cluster gets an error, since a folder of one
    machine would be lost with it.
    """
    folder = session.conf.get("spark.checkpoint.dir", None) or session.sparkContext.getCheckpointDir()
    if folder is None and not session.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or tempfile.mkdtemp(prefix="medspan-checkpoint-")).rstrip("/")


#: Staged tables of more rows are joined by shuffles, whatever their estimate; those of an estimate beyond any broadcast are not counted.
MAX_BROADCAST_ROWS, COUNTED_BYTES = 50_000, 1 << 30
#: The estimate of a plan whose own is larger.
BEYOND = 1 << 63


def stage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and go on from its checkpoint in the shared folder.

    Long plans that use a table several times would otherwise compute and analyse it each time, and lost executors
    would set them back to the start.

    A checkpoint keeps the estimate of its plan, which starts from the bytes of compressed files: some megabytes of them may be millions of
    rows, which the driver would collect for a broadcast.  Rows are counted, now that they are there, and many are kept from it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    made = df.checkpoint(eager=True)
    return made.hint("merge") if estimated_bytes(df) < COUNTED_BYTES and made.count() > MAX_BROADCAST_ROWS else made


def few_rows(staged: DataFrame) -> DataFrame:
    """A staged table of narrow rows, broadcast to what it is joined to where it has up to ``MAX_BROADCAST_ROWS``: the other side is not moved."""
    return F.broadcast(staged) if has_few_rows(staged) else staged


def has_few_rows(staged: DataFrame) -> bool:
    return staged.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS


def estimated_bytes(df: DataFrame) -> int:
    """The plan's own estimate of its size, or a number beyond any table; nothing is run for it.

    A join is estimated as the product of its sides, so a chain of them soon has more digits than Python turns into a number (ValueError).
    """
    try:
        return min(BEYOND, int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except ValueError:
        return BEYOND


def qualified(session: SparkSession, path: str) -> str:
    """``path`` with its file system, absolute."""
    target = session._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).makeQualified(target).toString()


def remove(session: SparkSession, path: str) -> None:
    target = session._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


#: The least bytes of a table that a scan gives a task.
SPLIT_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over all cores where it is too small for a scan to do so: for costly work on each row of a small table.

    The plan's own estimate of its size decides, so nothing is run for it; a table of any size worth a cluster is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if estimated_bytes(df) < cores * SPLIT_BYTES else df


#: Estimated bytes of a partition that ``dealt`` makes, and the most partitions.
DEALT_BYTES, MAX_DEALT = 2 << 20, 10_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in partitions whose number grows with its estimate; a small table is left as it is.

    For hash tables over narrow rows read from files: adaptive execution joins partitions up to 64 MB of compressed rows, which are millions of them.
    """
    parts = min(estimated_bytes(df) // DEALT_BYTES, MAX_DEALT)
    return df.repartition(parts, *keys) if parts > df.sparkSession.sparkContext.defaultParallelism else df
