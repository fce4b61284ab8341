"""Thin Structured Streaming entry points: documents one by one, and the orphan state batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import annotate, documents
from ..operators.orphans import REFERENCE, OrphanState, advance, initial_state
from ..sources.readers import CLUSTERS


def merge_cluster_stream(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Clusters of arriving documents, merged; what has arrived is worked off and the query ends."""
    docs = spark.readStream.schema(f"article_id long, clusters {CLUSTERS}").parquet(source)
    return documents.merge_clusters(docs).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def annotate_stream(spark: SparkSession, source: str, ddl: str, wiki: DataFrame, aliases: DataFrame, relation: DataFrame, sink: str, checkpoint: str, opt: annotate.Options = annotate.Options()) -> StreamingQuery:
    """Annotates arriving documents batch by batch against the graph's tables; a document's annotations depend on no other's.

    A repeated batch writes its own folder again, so no document comes out twice.
    """

    def step(batch: DataFrame, number: int) -> None:
        annotate.annotate(batch, wiki, aliases, relation, opt=opt).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    docs = spark.readStream.schema(ddl).parquet(source)
    return docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def orphan_stream(spark: SparkSession, source: str, ddl: str, state_dir: str, checkpoint: str) -> StreamingQuery:
    """Keeps the orphan state under ``state_dir`` up to date with arriving references and parent changes.

    Every batch writes its state under its own number and reads the one before it, so a repeated batch
    gives the same state; what it settles and how the open counts change is written beside it, once.
    """

    def step(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        refs = batch.where("kind = 'ref'").select(*REFERENCE, F.col("at").alias("loaded_at"))
        changes = batch.where("kind = 'parent'").select("target", "at", "created", "delta")
        if number:
            state = OrphanState(s.read.parquet(f"{state_dir}/{number - 1}/parents"), s.read.parquet(f"{state_dir}/{number - 1}/waiting"))
        else:
            state = initial_state(refs, s.createDataFrame([], "id string"))
        found = advance(state, refs, changes)
        for name, df in (("parents", found.state.parents), ("waiting", found.state.waiting), ("settled", found.settled), ("flows", found.flows)):
            df.write.mode("overwrite").parquet(f"{state_dir}/{number}/{name}")
        s.createDataFrame([(number,)], "n long").write.mode("append").parquet(f"{state_dir}/batches")

    events = spark.readStream.schema(ddl).parquet(source)
    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_orphans(spark: SparkSession, state_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(settled, waiting, open references per table and month) after the last batch."""
    last = spark.read.parquet(f"{state_dir}/batches").agg(F.max("n")).first()[0]
    every = lambda name: spark.read.parquet(*[f"{state_dir}/{n}/{name}" for n in range(last + 1)])
    upto = Window.partitionBy("ref_table").orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = every("flows").groupBy("ref_table", "month").agg(F.sum("opened").alias("opened")).select("ref_table", "month", F.sum("opened").over(upto).alias("open"))
    return every("settled"), spark.read.parquet(f"{state_dir}/{last}/waiting"), opened
