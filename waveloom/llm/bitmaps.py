"""A bounded filter in front of joins: rows whose key cannot be on the other side are not shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A bitmap of at most 1024 x 4 KB is broadcast, whatever the corpus holds. With more keys than bits it
#: lets most rows pass, and the join behind it does the work.
BITMAP_ROWS, BITMAP_BITS = 1024, 32768


def _bitmap(keys: DataFrame) -> DataFrame:
    slot = F.pmod("key", F.lit(BITMAP_ROWS * BITMAP_BITS))
    rows = keys.select((slot / BITMAP_BITS).cast("int").alias("map_row"), F.pmod(slot, F.lit(BITMAP_BITS)).alias("map_bit"))
    return rows.groupBy("map_row").agg(F.expr("bitmap_construct_agg(map_bit)").alias("map_bits"))


def flagged(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """``df`` with may: false only where the key is not among ``keys`` (a column key, long)."""
    slot = F.pmod(key, F.lit(BITMAP_ROWS * BITMAP_BITS))
    bit = F.pmod(slot, F.lit(BITMAP_BITS)).cast("int")
    marked = df.withColumn("map_row", (slot / BITMAP_BITS).cast("int")).withColumn("map_bit", bit)
    byte = F.ascii(F.decode(F.substring("map_bits", F.expr("map_bit div 8 + 1"), F.lit(1)), "ISO-8859-1"))
    return (
        marked.join(F.broadcast(_bitmap(keys)), "map_row", "left")
        .withColumn("may", F.coalesce(F.getbit(byte, F.expr("map_bit % 8")) == 1, F.lit(False)))
        .drop("map_row", "map_bit", "map_bits")
    )
