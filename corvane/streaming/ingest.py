"""Extension: documentation records that arrive as files become chunks as they come, and rows of a stream points of a collection, each batch once."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.embed import Embedder
from ..operators import doc_chunks
from ..schemas import RAW_DOC
from ..sources import jsonl, manifest
from ..sources.collection import Collection

#: How often a batch is tried against what other writers make meanwhile.
RETRIES = 5


def stream_docs(spark: SparkSession, source: str, classes: DataFrame, target: str, checkpoint: str):
    """Starts a query that chunks new JSON-lines files under source into Parquet under target, partitioned by batch.

    A batch that is repeated after a failure overwrites its own partition.
    """
    raw = spark.readStream.schema(RAW_DOC).json(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        chunks = doc_chunks.chunk_docs(jsonl.with_doc_defaults(batch), classes)
        chunks.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_collection(
    rows: DataFrame, name: str, path: str, embedder: Embedder | None, checkpoint: str, key: str = "id", deleted: str | None = None, stream: str = "stream", trigger: dict[str, Any] | None = None, **create: Any,
) -> StreamingQuery:
    """Starts a query that upserts rows as they come into the collection at path, which the first batch creates with **create.

    The number of a stream's last batch stands in the manifest that makes the batch's rows hold, so a batch that comes again after a
    failure changes nothing, whenever the failure was. Statistics and indexes stay exact, as upserts keep them. In a batch the
    last row of an id by its JSON stays, of batches the later one; rows without an id are left out. deleted: a boolean
    column, true where a row takes its id away. Where another writer comes in between, the batch is applied to what that one
    has made, RETRIES times. trigger: as of DataStreamWriter.trigger, by default all there is.
    """
    spark = rows.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        gone = None if deleted is None else batch.filter(F.col(deleted)).select(F.col(key).cast("long").alias("id"))
        new = batch if deleted is None else batch.filter(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)
        for left in reversed(range(RETRIES)):
            version, about = manifest.load(spark, path)
            done = about.get("batches", {})
            if done.get(stream, -1) >= batch_id:
                return
            try:
                held = Collection.read(spark, name, path) if version else Collection.create(name, path, new.limit(0), embedder, key=key, **create)
                held.upsert(new, embedder, gone, note={"batches": done | {stream: batch_id}})
                return
            except manifest.Conflict:
                if not left:
                    raise

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
