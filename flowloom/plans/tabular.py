"""Neighbour aggregation, tabular baseline and flow-as-node graphs."""

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.functions.scoring import flow_vector
from flowloom.operators.audits import standardise
from flowloom.operators.metrics import class_weights
from flowloom.operators.sampling import row_windows


def neighbour_mean(nodes: DataFrame, edges: DataFrame, columns: list[str], hops: int = 1, keys=("window_id",)) -> DataFrame:
    """Mean of the in-neighbours' columns, ``hops`` times. Parallel edges are counted once on
    the map side and enter as weights."""
    keys = list(keys)
    links = edges.groupBy(*keys, "src", "dst").agg(F.count(F.lit(1)).alias("_w"))
    state = nodes.select(*keys, "host", *columns)
    for _ in range(hops):
        sent = links.join(state.withColumnRenamed("host", "src"), [*keys, "src"])
        total = F.sum("_w")
        means = [(F.sum(F.col(c) * F.col("_w")) / total).alias(c) for c in columns]
        got = sent.groupBy(*keys, F.col("dst").alias("host")).agg(*means)
        quiet = nodes.select(*keys, "host").join(got, [*keys, "host"], "left")
        state = quiet.fillna(0.0, subset=columns)
    return state


def fit_forest(rows: DataFrame, features: list[str], trees: int = 200, depth: int = 24, seed: int = 0):
    """Random forest with balanced class weights on flattened edges."""
    n = class_weights(rows)
    total = n.agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    weights = n.crossJoin(F.broadcast(total)).select("y", (F.col("_t") / (F.col("_k") * F.col("n"))).alias("weight"))
    train = VectorAssembler(inputCols=features, outputCol="features").transform(rows.join(F.broadcast(weights), "y"))
    forest = RandomForestClassifier(
        labelCol="y", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=min(depth, 30), seed=seed,
        cacheNodeIds=False, maxMemoryInMB=512,
    )
    return forest.fit(train.select("y", "weight", "features"))


def forest_scores(model, rows: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``probs`` and ``pred``."""
    out = model.transform(VectorAssembler(inputCols=features, outputCol="features").transform(rows))
    return out.withColumns({"probs": vector_to_array("probability"), "pred": F.col("prediction").cast("int")}).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def importances(model, features: list[str], spark) -> DataFrame:
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double")


def previous_edges(batches: DataFrame, once: bool = False) -> DataFrame:
    """(batch, src, dst, kind): each row to the one before it, and to the last row of its
    batch with the same port. A batch has a fixed number of rows. ``once`` skips a port edge
    that repeats the chain edge."""
    chain = Window.partitionBy("batch").orderBy("position")
    port = Window.partitionBy("batch", "dst_port").orderBy("position")
    both = batches.select(
        "batch", F.col("position").alias("dst"), F.lag("position").over(chain).alias("_c"), F.lag("position").over(port).alias("_p")
    )
    kinds = F.explode(F.array(
        F.struct(F.col("_c").alias("src"), F.lit("previous").alias("kind")),
        F.struct(F.when(F.lit(not once) | (F.col("_p") != F.col("_c")), F.col("_p")).alias("src"), F.lit("same_port").alias("kind")),
    ))
    edges = both.select("batch", "dst", kinds.alias("e")).select("batch", "e.src", "dst", "e.kind")
    return edges.where(F.col("src").isNotNull())


def flow_graphs(flows: DataFrame, order: list[Column], size: int = 500, train: DataFrame | None = None):
    """(nodes, edges) of batches of ``size`` flows: seven standardised inputs per flow.
    Batches of one row are dropped."""
    vector = flow_vector()
    ranked = row_windows(flows, order, size)
    last = ranked.agg(F.max("position").alias("_last"))
    full = ranked.crossJoin(F.broadcast(last)).where((F.col("_last") > F.col("batch") * size)).drop("_last")
    nodes = full.select(*flows.columns, "batch", "position", *[e.alias(f"x_{n}") for n, e in vector.items()])
    names = [f"x_{n}" for n in vector]
    reference = train.select(*[e.alias(f"x_{n}") for n, e in vector.items()]) if train is not None else nodes
    return standardise(nodes, names, reference), previous_edges(full)
