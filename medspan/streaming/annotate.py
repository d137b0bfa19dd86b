"""Annotation of a stream of notes by micro-batches (an addition: the plan is stateless, the index static)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from medspan.plans.annotate import Options, Prepared, annotate
from medspan.sources.index import Index


def annotate_stream(notes: DataFrame, index: Index | Prepared, out_dir: str, checkpoint_dir: str, options: Options | None = None, **trigger) -> StreamingQuery:
    """Annotate each micro-batch of a streaming (doc_id, text) frame and write it as Parquet, one folder for each batch.

    A batch that is run again overwrites its own folder, so results hold every note once.  The dictionary is read and broadcast once for
    all batches.
    """
    ready = index if isinstance(index, Prepared) else Prepared(index, options)

    def write(batch: DataFrame, number: int) -> None:
        annotate(batch, ready).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    return notes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir).trigger(**(trigger or {"availableNow": True})).start()
