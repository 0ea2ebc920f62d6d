"""Prefix filtering for exact set-similarity joins."""

from pyspark.sql import DataFrame, functions as F


def prefix_items(sets: DataFrame, name: str, items: str, threshold: float) -> DataFrame:
    """(``name``, ``item``, ``size``): of every set, the rarest items of which two sets with a
    Jaccard similarity of ``threshold`` must share at least one. Items of one set only are left
    out, so a set that differs from all others in enough items has no row at all."""
    rows = sets.select(name, F.explode(items).alias("item"))
    common = rows.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    ordered = rows.join(common, "item", "left").groupBy(name).agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "item"))).alias("r")
    )
    size = F.size("r")
    prefix = size - F.ceil(threshold * size - 1e-9).cast("int") + 1
    heads = ordered.select(name, size.alias("size"), F.explode(F.slice("r", 1, prefix)).alias("x"))
    return heads.where(F.col("x.n") > 1).select(name, F.col("x.item").alias("item"), "size")
