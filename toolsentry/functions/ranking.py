"""Positions in a global order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolsentry.session import scratch_path

#: ``monotonically_increasing_id`` keeps the partition above these bits and the row's place in it below.
_PLACE_BITS = 33


def positioned(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """The rows with their place (1, 2, 3 ...) in ``order``.

    Rows are dealt by ranges of the order and sorted within them, which is the only shuffle; the sorted ranges are
    written to the scratch folder, where a row's partition and place in it are read off its row number. What a place
    lacks is the number of rows in earlier ranges: a running sum over one count for each range. Rows that are equal
    in ``order`` are dealt too, so a hot value does not fill one range; their places among each other are any. Ranges come
    from a sample, which reads the rows once more: land rows that are costly to make.
    """
    spark = rows.sparkSession
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranges = tied.repartitionByRange(*order, F.col("_tie").asc()).sortWithinPartitions(*order, F.col("_tie").asc())
    numbered = ranges.withColumn("_row", F.monotonically_increasing_id()).drop("_tie")
    path = scratch_path(spark, "ranges")
    numbered.write.parquet(path)
    sorted_rows = spark.read.schema(numbered.schema).parquet(path)
    range_of = F.shiftright("_row", _PLACE_BITS)
    # at most one row for each range, so a few thousand: bounded by the number of partitions, not by the rows
    counts = sorted_rows.groupBy(range_of.alias("range")).agg(F.count("*").alias("n")).orderBy("range").collect()
    starts, before = {}, 0
    for row in counts:
        starts[row.range] = before
        before += row.n
    last = max(starts, default=0)
    start = F.get(F.lit([starts.get(i, 0) for i in range(last + 1)]).cast("array<bigint>"), range_of.cast("int"))
    place = F.col("_row").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return sorted_rows.withColumn(name, start + place + 1).drop("_row")
