"""Session helpers, as the base operators have them, and one for tables that come in few pieces."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoframe.functions.session import durable, partitions, shared_dir, table

__all__ = ["durable", "partitions", "shared_dir", "spread", "table"]


def spread(rows: DataFrame) -> DataFrame:
    """A table as it was read, or dealt to all cores by a hash of its first two columns where it comes in fewer partitions than there are cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, F.xxhash64(*rows.columns[:2]))
