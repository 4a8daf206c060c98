"""The same plans over streams: extraction is stateless, counts are windowed, the index is upserted by batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..canon import Canon
from ..functions.refs import Options
from ..operators.extract import extract_refs


def read_documents(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(docs: DataFrame, canon: Canon, time: str, length: str, slide: str | None = None, late: str | None = None, keys: list[str] | None = None, options: Options = Options()) -> DataFrame:
    """``window_start, window_end, book_id, refs``; the same for a table and a stream.

    With ``late`` a watermark drops what comes later than that, so that a stream's state stays bounded.
    """
    refs = extract_refs(docs, canon, keys=keys, options=options, located=False)
    if late:
        refs = refs.withWatermark(time, late)
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return refs.groupBy(w.alias("w"), "book_id").agg(F.count("*").alias("refs")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "book_id", "refs")


def session_counts(docs: DataFrame, canon: Canon, time: str, gap: str, by: str, late: str, keys: list[str] | None = None) -> DataFrame:
    """References per session of ``by``: a session ends after ``gap`` without one."""
    refs = extract_refs(docs, canon, keys=keys, located=False).withWatermark(time, late)
    return refs.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("refs")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "refs")


def first_sightings(docs: DataFrame, canon: Canon, time: str, late: str, keys: list[str]) -> DataFrame:
    """References, each document's only once, though a stream may deliver a document again."""
    once = docs.withWatermark(time, late).dropDuplicatesWithinWatermark([keys[0]])
    return extract_refs(once, canon, keys=keys, located=False)


def upsert_index(docs: DataFrame, canon: Canon, index_path: str, checkpoint: str, keys: list[str], partition: str = "pack", packs: int = 32, once: bool = True) -> StreamingQuery:
    """Keep an index of references by document: each batch replaces its documents' references.

    Only the packs that a batch touches are read and written (dynamic partition overwrite), and a batch
    that is run again after a failure writes the same rows. A pack is written beside and put in place by
    the overwrite's commit, so it is read into a table of the batch first.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        pack = F.pmod(F.xxhash64(*keys), F.lit(packs)).cast("int")
        batch = batch.dropDuplicates(keys).withColumn(partition, pack)
        touched = [r[0] for r in batch.select(partition).distinct().collect()]  # at most `packs` numbers
        if not touched:
            return
        found = extract_refs(batch, canon, keys=[*keys, partition], located=False)
        # A document without references keeps a row, which says that it was searched.
        bare = batch.select(*keys, partition).join(found.select(*keys), keys, "left_anti")
        new = found.unionByName(bare.withColumn("ref_no", F.lit(0)), allowMissingColumns=True)
        try:
            old = spark.read.parquet(index_path).where(F.col(partition).isin(touched)).join(batch.select(*keys), keys, "left_anti")
            merged = old.select(*new.columns).unionByName(new)
        except AnalysisException:  # the first batch has no index to read
            merged = new
        staged = f"{index_path}_stage/{number}"
        merged.write.mode("overwrite").partitionBy(partition).parquet(staged)
        spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(index_path)

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
