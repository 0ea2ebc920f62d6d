"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is two grouped minima and joins on the node; a round's links are a written table in
the shared folder, so lineage stays short and a lost executor repeats one round at most. Nothing
but a count and a checksum of the links reaches the driver.
"""

from pyspark.sql import DataFrame, functions as F

from flowloom.llm.base import drop_path, stored


def _star(links: DataFrame, large: bool, paths: list[str]) -> DataFrame:
    """Link the neighbours of a node to the least of them and the node: those above the node in
    a large star, the node and those below it in a small star. The minima are written (to a path
    added to ``paths``), so that the join with them can split the links of a hub."""
    if large:
        near = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least, path = stored(near.groupBy("u").agg(F.min("v").alias("_m")), "least")
    paths.append(path)
    met = near.join(least.select("u", F.least("u", "_m").alias("m")), "u")
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("_m").alias("v"))
        )
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links``: u, v of any one integer type. Returns (node, root) for every linked node that
    is not the least of its component, whose least node is ``root``. Self links and repeated
    links change nothing; rows with a null end are ignored; no links give no rows."""
    spark = links.sparkSession
    # Written first, so that what makes the links runs once.
    previous = None
    links, path = stored(links.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "links")
    while True:
        done = [path]
        half, other = stored(_star(links, True, done), "links")
        links, path = stored(_star(half, False, done), "links")
        for finished in (*done, other):
            drop_path(spark, finished)
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == previous or not state[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        previous = state
