"""Directory records that keep landing: an extension over the batch inventory, with the same operators per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.operators import inventory as I
from cytoframe.sources.tables import DIRECTORY


def landing_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(DIRECTORY).json(path)


def score_landing(records: DataFrame, out: str, checkpoint: str):
    """Scores each micro-batch's directories and writes them under its batch id, so a batch run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        names = batch.select("path", F.explode("sampleNames").alias("name"))
        I.scored(names).select("path", "origin", "z_score", "tracking_score").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
