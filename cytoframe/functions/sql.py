"""The library's functions for spark.sql: scalar functions over sums and values, and sliding segments as a table function.

    register(spark)
    spark.sql("SELECT ploidy, avg(v), standard_error(stddev_samp(v), count(v)) FROM steps GROUP BY ploidy")
    spark.sql("SELECT * FROM sliding_segments(TABLE(runs) PARTITION BY (track_id, run_index) ORDER BY (frame), 3)")
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Expressions of the scalar functions, by their signature.
SCALARS = {
    "standard_error(sd DOUBLE, n BIGINT) RETURNS DOUBLE": "sd / sqrt(n)",
    "effective_n(w DOUBLE, w2 DOUBLE) RETURNS DOUBLE": "w * w / w2",
    "weighted_standard_error(w DOUBLE, w2 DOUBLE, wv DOUBLE, wv2 DOUBLE) RETURNS DOUBLE": "sqrt(greatest(wv2 / w - (wv / w) * (wv / w), 0D) / (w * w / w2))",
    "finite_or_null(v DOUBLE) RETURNS DOUBLE": "CASE WHEN NOT isnan(v) AND abs(v) < double('infinity') THEN v END",
    "step_bin(d DOUBLE) RETURNS STRING": "CASE WHEN d <= 5 THEN '0-5 px' WHEN d <= 10 THEN '5-10 px' WHEN d <= 20 THEN '10-20 px' WHEN d IS NOT NULL THEN '>=20 px' END",
    "frame_window(f INT) RETURNS STRING": "CASE WHEN f < 10 THEN 'frames 0-9' WHEN f < 20 THEN 'frames 10-19' WHEN f <= 40 THEN 'frames 20-40' END",
}


class SlidingSegments:
    """All windows of `size` rows in a row of a partition, a row for each window and position.

    Adds segment_start and segment_end, the frames of a window's first and last row, and segment_position
    from 1. Only `size` rows are held at once. The table is partitioned by run and ordered by frame.
    """

    def __init__(self):
        self.held: deque | None = None

    @staticmethod
    def analyze(table: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or "frame" not in table.dataType.fieldNames():
            raise ValueError("sliding_segments takes a table with a column frame")
        if not isinstance(size.value, int) or size.value < 1:
            raise ValueError("the size of a segment is a constant of 1 or more")
        more = [T.StructField(n, T.IntegerType()) for n in ("segment_start", "segment_end", "segment_position")]
        return AnalyzeResult(T.StructType([*table.dataType.fields, *more]))

    def eval(self, table: Row, size: int) -> Iterator[tuple]:
        if self.held is None:
            self.held = deque(maxlen=size)
        self.held.append(table)
        if len(self.held) == size:
            for position, row in enumerate(self.held, 1):
                yield (*row, self.held[0]["frame"], self.held[-1]["frame"], position)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session, for as long as it lasts."""
    for signature, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udtf.register("sliding_segments", udtf(SlidingSegments))
