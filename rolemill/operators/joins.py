"""Joins on more than equality."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def earlier_within(rows: DataFrame, key: str, order: str, width: int) -> DataFrame:
    """Pairs of rows of one key whose ``order`` numbers differ by 1 to ``width``.

    The order is cut into bands as wide as that, and a row meets only those of its own
    band and of the one before, so a key with very many rows is spread over its bands
    and never joined with itself as a whole. Returns the columns of the later row and
    those of the earlier one with the prefix ``earlier_``; rows with a null key or order
    meet none."""
    band = F.floor(F.col(order) / width)
    later = rows.withColumn("_band", band)
    earlier = rows.select(*[F.col(c).alias(f"earlier_{c}") for c in rows.columns], F.explode(
        F.array(band, band + 1)).alias("_band"))
    gap = F.col(order) - F.col(f"earlier_{order}")
    return later.join(earlier, (later[key] == earlier[f"earlier_{key}"]) & (
        later["_band"] == earlier["_band"]) & (gap > 0) & (gap <= width)).select(
            *[later[c] for c in rows.columns], *[earlier[f"earlier_{c}"] for c in rows.columns])
