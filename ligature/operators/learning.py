"""Link prediction: features, negatives, a classifier, and its evaluation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligature.operators.graph import both_ways
from ligature.session import materialized

#: Draws of a degree-matched pair for each edge.
DRAWS = 8
#: Skip-gram: walks that a task trains on, passes over their pairs, pairs of a step, negatives of a pair, step size.
SHARD, PASSES, BATCH, NEGATIVES, RATE = 20_000, 5, 4096, 5, np.float32(0.1)


def hadamard(a: str = "a", b: str = "b") -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y)


def is_test(u: str = "u", v: str = "v", percent: int = 20, seed: int = 42) -> Column:
    """A hash split of canonical pairs: repeatable, and the same on any partitioning."""
    return F.pmod(F.xxhash64(F.least(u, v), F.greatest(u, v), F.lit(seed)), F.lit(100)) < percent


def random_negatives(edges: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` pairs that are no edge: hashed draws over the numbered nodes, twice as many as asked."""
    nodes = both_ways(edges).groupBy(F.col("u").alias("node")).count()
    total = nodes.count()
    kind = nodes.schema["node"].dataType.simpleString()
    numbered = nodes.select("node").rdd.map(lambda r: r[0]).sortBy(lambda x: x).zipWithIndex().toDF(f"node {kind}, place long")
    place = lambda k: F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(max(total, 1)))
    draws = edges.sparkSession.range(2 * n + 10).select("id", place(0).alias("i"), place(1).alias("j"))
    pairs = draws.join(numbered.select(F.col("node").alias("a"), F.col("place").alias("i")), "i").join(numbered.select(F.col("node").alias("b"), F.col("place").alias("j")), "j")
    pairs = pairs.where("a <> b").groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("id").alias("id"))
    return pairs.join(edges.select("u", "v"), ["u", "v"], "left_anti").orderBy("id").limit(n).select("u", "v")


def two_hop_negatives(edges: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` pairs at distance two, in hash order."""
    links = both_ways(edges)
    pairs = links.alias("a").join(links.alias("b"), F.col("a.v") == F.col("b.u")).where("a.u < b.v").select(F.col("a.u").alias("u"), F.col("b.v").alias("v")).distinct()
    return pairs.join(edges.select("u", "v"), ["u", "v"], "left_anti").orderBy(F.xxhash64("u", "v", F.lit(seed)), "u", "v").limit(n)


def degree_matched_negatives(edges: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` non-edges whose endpoints' degree buckets, floor(log2(d + 1)), repeat those of edges; where
    first draws give edges or repeats, further draws for the same edges fill up."""
    degree = both_ways(edges).groupBy(F.col("u").alias("node")).agg(F.floor(F.log2(F.count("*") + 1)).alias("bucket"))
    from pyspark.sql import Window

    placed = degree.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("node", F.lit(seed)), "node")) - 1).withColumn("size", F.count("*").over(Window.partitionBy("bucket")))
    sizes = degree.groupBy("bucket").agg(F.count("*").alias("size"))
    e = edges.select("u", "v").orderBy(F.xxhash64("u", "v", F.lit(seed)), "u", "v").limit(3 * n)
    for end, name in (("u", "bu"), ("v", "bv")):
        e = e.join(degree.select(F.col("node").alias(end), F.col("bucket").alias(name)), end)
        e = e.join(sizes.select(F.col("bucket").alias(name), F.col("size").alias(f"n{name}")), name)
    e = e.crossJoin(F.broadcast(edges.sparkSession.range(DRAWS).withColumnRenamed("id", "draw")))
    place = lambda k: F.xxhash64("u", "v", (2 * F.col("draw") + seed + k).cast("int"))
    e = e.select("draw", "bu", "bv", F.pmod(place(1), "nbu").alias("pu"), F.pmod(place(2), "nbv").alias("pv"))
    a = placed.select(F.col("node").alias("a"), F.col("bucket").alias("bu"), F.col("place").cast("long").alias("pu"))
    b = placed.select(F.col("node").alias("b"), F.col("bucket").alias("bv"), F.col("place").cast("long").alias("pv"))
    pairs = e.join(a, ["bu", "pu"]).join(b, ["bv", "pv"]).where("a <> b").groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("draw").alias("draw"))
    return pairs.join(edges.select("u", "v"), ["u", "v"], "left_anti").orderBy("draw", "u", "v").limit(n).select("u", "v")


def combined_negatives(edges: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Half two-hop, half degree-matched, no pair twice."""
    near = two_hop_negatives(edges, n // 2, seed)
    return near.union(degree_matched_negatives(edges, n, seed).join(near, ["u", "v"], "left_anti").limit(n - n // 2))


def train(features: DataFrame):
    """Logistic regression over (features array<double>, y), classes weighted to balance; None without rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    share = features.agg(F.avg("y")).first()[0]
    if share is None:
        return None
    share = share or 0.5
    weight = F.when(F.col("y") == 1, 0.5 / share).otherwise(0.5 / max(1 - share, 1e-9))
    return LogisticRegression(labelCol="y", weightCol="w", maxIter=100).fit(features.select(array_to_vector("features").alias("features"), F.col("y").cast("double").alias("y"), weight.alias("w")))


def predict(model, features: DataFrame) -> DataFrame:
    """``features`` with the model's score; null where there was nothing to train it on."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if model is None:
        return features.withColumn("score", F.lit(None).cast("double")).drop("features")
    rows = features.withColumn("features", array_to_vector("features"))
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def roc_auc(scored: DataFrame) -> DataFrame:
    """ROC-AUC of (score, y) from the rank sum, ties at their mean rank; one row
    per group-free input, null where a class has no rows."""
    tied = scored.groupBy("score").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    from pyspark.sql import Window

    below = F.sum("n").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1))
    ranked = tied.withColumn("rank", F.coalesce(below, F.lit(0)) + (F.col("n") + 1) / 2)
    p, n = F.sum("pos"), F.sum("n") - F.sum("pos")
    return ranked.agg(F.try_divide(F.sum(F.col("rank") * F.col("pos")) - p * (p + 1) / 2, p * n).alias("auc"))


def _init(nodes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A small vector of each node from its number alone, so that all tasks begin with the same."""
    z = nodes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1 + seed, 1 + seed + size, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    for shift in (30, 27):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(0x94D049BB133111EB)
    return (((z >> np.uint64(40)).astype(np.float32) / (1 << 24)) - 0.5) / size


def _pairs(owner: np.ndarray, at: np.ndarray, n: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (centre, context) of walks with their weights; nearer contexts weigh more, by the share
    of window sizes drawn from 1 to ``window`` that hold them."""
    keys, weights = np.zeros(0, np.int64), np.zeros(0)
    for d in range(1, window + 1):
        same = owner[d:] == owner[:-d]
        a, b = at[:-d][same], at[d:][same]
        keys, place = np.unique(np.concatenate([keys, a * n + b, b * n + a]), return_inverse=True)
        weights = np.bincount(place, np.concatenate([weights, np.full(2 * len(a), (window - d + 1) / window)]), len(keys))
    return keys // n, keys % n, weights.astype(np.float32)


def _step(vectors: np.ndarray, squares: np.ndarray, at: np.ndarray, slopes: np.ndarray) -> None:
    """One AdaGrad step of the rows ``at``, which may repeat."""
    order = np.argsort(at, kind="stable")
    rows, first = np.unique(at[order], return_index=True)
    total = np.add.reduceat(slopes[order], first, axis=0)
    squares[rows] += (total * total).mean(1)
    vectors[rows] -= RATE * total / np.sqrt(squares[rows])[:, None]


def _skip_gram(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, weights: np.ndarray, rng: np.random.Generator) -> None:
    """Skip-gram with negative samples over weighted pairs, on centre vectors ``x`` and context vectors ``y``."""
    drawn = np.cumsum(np.bincount(b, weights, len(x)) ** 0.75)
    squares = np.full((2, len(x)), 1e-8, np.float32)
    for _ in range(PASSES):
        order = rng.permutation(len(a))
        for at in range(0, len(order), BATCH):
            i = order[at : at + BATCH]
            u, v = a[i], b[i, None]
            others = np.minimum(np.searchsorted(drawn, rng.random((len(i), NEGATIVES)) * drawn[-1], "right"), len(x) - 1)
            c = np.concatenate([v, others], 1)
            xu, yc = x[u], y[c]
            slope = 1 / (1 + np.exp(-np.clip(np.einsum("bd,bkd->bk", xu, yc), -30, 30)))
            slope[:, 1:][others == v] = 0
            slope[:, 0] -= 1
            slope *= weights[i, None]
            _step(x, squares[0], u, np.einsum("bk,bkd->bd", slope, yc))
            _step(y, squares[1], c.ravel(), (slope[:, :, None] * xu[:, None, :]).reshape(-1, x.shape[1]))


def _trained(size: int, window: int, seed: int):
    def train_shard(walks: pa.Table, state: pa.Table) -> pa.Table:
        """New vectors of the nodes of a shard's walks, and how often the walks hold each."""
        paths = walks["path"].combine_chunks()
        said = paths.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(paths)), pc.list_value_length(paths).to_numpy(zero_copy_only=False))
        nodes, at, held = np.unique(said, return_inverse=True, return_counts=True)
        x, y = _init(nodes, size, seed), np.zeros((len(nodes), size), np.float32)
        if state.num_rows:
            known = np.searchsorted(nodes, state["node"].to_numpy())
            for vectors, name in ((x, "x"), (y, "y")):
                vectors[known] = state[name].combine_chunks().flatten().to_numpy().reshape(-1, size)
        a, b, weights = _pairs(owner, at, len(nodes), window)
        if len(a):
            _skip_gram(x, y, a, b, weights, np.random.default_rng([seed, len(paths), int(nodes[0]) & (1 << 63) - 1, bool(state.num_rows)]))
        columns = [pa.array(nodes, pa.int64()), pa.array(held, pa.int64()), *(pa.array(list(v), pa.list_(pa.float32())) for v in (x, y))]
        return pa.Table.from_arrays(columns, names=["node", "held", "x", "y"])

    return train_shard


def node_embeddings(walks: DataFrame, size: int = 32, window: int = 5, rounds: int = 1, seed: int = 42) -> DataFrame:
    """(node, embedding) by skip-gram with negative samples: nodes are the words, walks (path) the sentences.

    Vectors never meet in one place. Walks are dealt into shards of about SHARD walks, by their least
    node as far as those of one node aren't more than a shard, so that small components stay whole. A
    task trains the vectors of one shard's nodes; after each round a node's vectors are the mean over
    its shards, weighted by how often their walks hold it, and the next round begins with them."""
    walks = materialized(walks.select(F.col("path").cast("array<long>").alias("path"), F.array_min("path").alias("least")), "paths")
    spark = walks.sparkSession
    bins = max(1, -(-walks.count() // SHARD))
    parts = walks.groupBy("least").agg(F.count("*").alias("n")).where(F.col("n") > SHARD).select("least", F.ceil(F.col("n") / SHARD).alias("parts"))
    part = F.xxhash64("least", F.pmod(F.xxhash64("path"), F.col("parts")))
    dealt = walks.join(materialized(parts, "parts"), "least", "left").select(F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("least"), F.lit(bins))).otherwise(part).alias("shard"), "path")
    dealt = materialized(dealt, "dealt")
    state = spark.createDataFrame([], "shard long, node long, x array<float>, y array<float>")
    for turn in range(rounds):
        if turn:
            held = dealt.select("shard", F.explode("path").alias("node")).distinct()
            state = materialized(held.join(vectors, "node").select("shard", "node", "x", "y"), "state")
        found = dealt.groupBy("shard").cogroup(state.groupBy("shard")).applyInArrow(_trained(size, window, seed), "node long, held long, x array<float>, y array<float>")
        found = materialized(found, "found")
        mean = lambda name, i: (F.sum(F.col(name)[i].cast("double") * F.col("held")) / F.sum("held")).cast("float")
        vectors = materialized(found.groupBy("node").agg(*(F.array(*(mean(name, i) for i in range(size))).alias(name) for name in ("x", "y"))), "vectors")
    return vectors.select("node", F.col("x").cast("array<double>").alias("embedding"))


def pair_features(pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``pairs`` (u, v, ...) with the product of their embeddings; pairs with an unknown node leave."""
    a, b = (embeddings.select(F.col("node").alias(end), F.col("embedding").alias(name)) for end, name in (("u", "a"), ("v", "b")))
    return pairs.join(a, "u").join(b, "v").withColumn("features", hadamard("a", "b")).drop("a", "b")


def average_precision(scored: DataFrame) -> DataFrame:
    """Average precision of (score, y), equal scores counting together; one row, null
    where no y is 1."""
    from pyspark.sql import Window

    tied = scored.groupBy("score").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    down = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    seen = tied.select("pos", F.sum("pos").over(down).alias("tp"), F.sum("n").over(down).alias("rows"))
    return seen.agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("rows")), F.sum("pos")).alias("ap"))
