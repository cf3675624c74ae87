"""A lookup in a table with one row a key, where one key may be that of a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoframe.llm._session import partitions

#: A key that more rows hold is dealt out by a salt; it must also hold a HOT_SHARE-th of all rows, so there are HOT_SHARE such keys at most.
HOT_ROWS, HOT_SHARE = 1000, 10_000


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], counts: DataFrame, total: int, spread: str) -> DataFrame:
    """rows with the columns of table, null where it lacks the key.

    counts: (keys, _n), rows by key; total: all rows. Hot keys are broadcast, HOT_SHARE at most, and
    dealt out by a hash of the column `spread`; their rows of the table are repeated for each salt.
    """
    salts = 2 * partitions(rows.sparkSession)
    hot = F.broadcast(counts.where(F.col("_n") > max(HOT_ROWS, total // HOT_SHARE)).select(*keys, F.lit(True).alias("_hot")))
    left = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    right = table.join(hot, keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")
