"""Clustering: k-means, density clusters, assignment, quality measures and keyword tags."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..schema import SILHOUETTE_SAMPLE
from ..sources.scratch import materialize

#: Centroids that may go out to all tasks, and their numbers that may stand in a plan as literals.
MAX_CENTROIDS = 4096
LITERAL_NUMBERS = 4096
#: Terms of a few bytes each that may go out to all tasks, counted first.
MAX_SENT_TERMS = 1_000_000
#: Most vectors of a block of density clustering; a task holds two blocks.
DENSITY_BLOCK = 4096
#: Words that tags leave out.
STOP_WORDS = """a about above after again all also am an and any are as at be because been before being below between both but by can could did do
does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just
me more most my no nor not of off on once only or other our out over own same she should so some such than that the their them then
there these they this those through to too under until up very was we were what when where which while who why will with would you your""".split()


def _measured(centroids: np.ndarray, digits: int):
    """A Pandas UDF: vector to (label, squared distance) of the nearest centroid, the lowest on ties; for centroids too many for a plan."""

    @F.pandas_udf("label int, distance double")
    def run(vectors: pd.Series) -> pd.DataFrame:
        labels, distances = np.zeros(len(vectors), np.int32), np.full(len(vectors), np.nan)
        known = vectors.notna().to_numpy()
        rows = np.array(vectors[known].tolist(), float).reshape(-1, centroids.shape[1])
        step = max(1, LITERAL_NUMBERS * 256 // max(1, centroids.size))
        found = [np.round(((rows[a : a + step, None, :] - centroids[None]) ** 2).sum(2), digits) for a in range(0, len(rows), step)]
        if found:
            labels[known] = np.concatenate([d.argmin(1) for d in found])
            distances[known] = np.concatenate([d.min(1) for d in found])
        return pd.DataFrame({"label": labels, "distance": distances})

    return run


def _nearest(v: Column, centroids: Sequence[Sequence[float]], digits: int) -> Column:
    """struct<label, distance> of the nearest centroid: an expression over literals while they are few, else a matrix that goes out with the function."""
    if len(centroids) > MAX_CENTROIDS:
        raise ValueError(f"{len(centroids)} centroids; {MAX_CENTROIDS} at most")
    table = np.asarray(centroids, float)
    if table.size > LITERAL_NUMBERS:
        return _measured(table, digits)(v.cast("array<double>"))
    options = F.array(*(F.struct(F.round(V.squared_l2(v, V.literal(c)), digits).alias("distance"), F.lit(i).alias("label")) for i, c in enumerate(table.tolist())))
    return F.array_min(options)


def nearest_label(v: Column, centroids: Sequence[Sequence[float]]) -> Column:
    """Number of the nearest centroid, the lowest on ties."""
    return _nearest(v, centroids, 12)["label"]


def assign(docs: DataFrame, centroids: DataFrame, digits: int = 6) -> DataFrame:
    """(id, label, distance): the nearest of ``centroids`` (label, centroid), a checked number of rows, by squared distance; the lowest label on ties."""
    few = centroids.limit(MAX_CENTROIDS + 1).collect()
    if len(few) > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids")
    few.sort(key=lambda r: r["label"])
    rows = docs.where(F.col("embedding").isNotNull())
    if not few:
        return rows.selectExpr("id", "cast(null as long) as label", "cast(null as double) as distance")
    names = F.array(*(F.lit(r["label"]).cast("long") for r in few))
    return rows.select("id", _nearest(F.col("embedding"), [r["centroid"] for r in few], digits).alias("b")).select("id", F.element_at(names, F.col("b.label") + 1).alias("label"), "b.distance")


def mean_vectors(docs: DataFrame, label: str = "label") -> DataFrame:
    """(label, centroid): componentwise means, by partial sums per component."""
    parts = docs.select(label, F.posexplode(V.doubles(F.col("embedding"))).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(F.col(label).alias("label")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def lloyd_step(docs: DataFrame, centroids: DataFrame) -> DataFrame:
    """New centroids after one round of k-means."""
    return mean_vectors(docs.join(assign(docs, centroids).select("id", "label").withColumnRenamed("label", "__l"), "id"), "__l")


def kmeans(docs: DataFrame, k: int, seed: int = 0, max_iter: int = 20, normalize: bool = False):
    """(assignments (id, label), centroids, inertia) by MLlib; k is at most the number of rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = docs.where(F.col("embedding").isNotNull())
    n = rows.count()
    if not n:
        return rows.selectExpr("id", "0 as label").limit(0), [], 0.0
    v = V.l2_normalize(F.col("embedding")) if normalize else V.doubles(F.col("embedding"))
    model = KMeans(k=max(1, min(k, n)), seed=seed, maxIter=max_iter, featuresCol="__x", predictionCol="label").fit(rows.select("id", array_to_vector(v).alias("__x"))) if min(k, n) > 1 else None
    if model is None:
        center = mean_vectors(rows.withColumn("label", F.lit(0)).withColumn("embedding", v)).collect()[0]["centroid"]
        return rows.select("id", F.lit(0).alias("label")), [center], float(rows.agg(F.sum(V.squared_l2(v, V.literal(center)))).collect()[0][0])
    labelled = model.transform(rows.select("id", array_to_vector(v).alias("__x"))).select("id", "label")
    return labelled, [c.tolist() for c in model.clusterCenters()], float(model.summary.trainingCost)


def minibatch_kmeans(docs: DataFrame, k: int, batch: int = 1024, rounds: int = 10, seed: int = 0) -> tuple[DataFrame, list[list[float]]]:
    """Centroids from small batches drawn by hash, each moving its centroid by a decreasing step; then one assignment of all rows."""
    rows = docs.where(F.col("embedding").isNotNull())
    drawn = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(batch * rounds).select(V.doubles(F.col("embedding"))).collect()
    points = np.array([r[0] for r in drawn], float)
    if not len(points):
        return rows.selectExpr("id", "0 as label").limit(0), []
    centers, seen = points[: min(k, len(points))].copy(), np.ones(min(k, len(points)))
    for a in range(0, len(points), batch):
        part = points[a : a + batch]
        label = ((part[:, None, :] - centers[None]) ** 2).sum(2).argmin(1) if len(centers) * part.size < 50_000_000 else np.array([((centers - p) ** 2).sum(1).argmin() for p in part])
        for c in np.unique(label):
            own = part[label == c]
            seen[c] += len(own)
            centers[c] += (own.mean(0) - centers[c]) * len(own) / seen[c]
    return rows.select("id", nearest_label(F.col("embedding"), centers).alias("label")), centers.tolist()


def nearest_distances(points: np.ndarray, others: np.ndarray, k: int) -> np.ndarray:
    """Distances of each point to its k nearest others (fewer if there are fewer): products find the candidates, differences measure them."""
    k = min(k, len(others))
    wide = min(k + 8, len(others))
    squares, out = (others**2).sum(1), []
    for a in range(0, len(points), 512):
        own = points[a : a + 512]
        rough = squares[None] - 2 * own @ others.T
        near = np.argpartition(rough, wide - 1, axis=1)[:, :wide]
        gap = others[near] - own[:, None]
        out.append(np.sort(np.sqrt(np.einsum("ijk,ijk->ij", gap, gap)), axis=1)[:, :k])
    return np.concatenate(out) if out else np.zeros((0, k))


def spanning_tree(points: np.ndarray, core: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight, a, b) with a < b: the minimum spanning tree by mutual reachability of all points, or of the links between the two sides.
    Equal weights go by (a, b), so the tree is unique and the trees of parts hold that of the whole."""
    n = len(points)
    every = np.arange(n)
    across = [every, every] if side is None else [np.flatnonzero(side != 0), np.flatnonzero(side != 1)]
    parts = [(v, points[v], core[v]) for v in across]
    best, key, inside = np.full(n, np.inf), np.full(n, n * n), np.zeros(n, bool)
    weight, first, second, at = np.zeros(n - 1), np.zeros(n - 1, int), np.zeros(n - 1, int), 0
    for step in range(n - 1):
        inside[at] = True
        v, x, c = parts[0 if side is None else side[at]]
        gap = x - points[at]
        reach = np.maximum(np.maximum(np.sqrt(np.einsum("ij,ij->i", gap, gap)), c), core[at])
        keys = np.minimum(v, at) * n + np.maximum(v, at)
        old = best[v]
        closer = ((reach < old) | ((reach == old) & (keys < key[v]))) & ~inside[v]
        best[v[closer]], key[v[closer]] = reach[closer], keys[closer]
        best[at] = np.inf
        outside = np.where(inside, np.inf, best)
        ties = np.flatnonzero(outside == outside.min())
        ties = ties[~inside[ties]]
        at = int(ties[key[ties].argmin()])
        weight[step], first[step], second[step] = best[at], key[at] // n, key[at] % n
    return weight, first, second


def density_labels(points: np.ndarray, min_cluster_size: int = 5) -> np.ndarray:
    """Hierarchical density clusters: core distances, mutual reachability, minimum spanning tree, condensed tree, excess of mass. -1 is noise."""
    n = len(points)
    if n < 2 or n < min_cluster_size:
        return np.full(n, -1)
    core = nearest_distances(points, points, min_cluster_size)[:, -1]
    return tree_labels(n, sorted(zip(*(x.tolist() for x in spanning_tree(points, core)))), min_cluster_size)


def tree_labels(n: int, edges: Iterable[tuple[float, int, int]], min_cluster_size: int) -> np.ndarray:
    """Labels of n points from sorted edges that hold their minimum spanning tree."""
    # single linkage: node numbers from n up
    root, size, sons = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), {}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    node = n
    for w, a, b in edges:
        a, b = top(a), top(b)
        if a == b:
            continue
        sons[node] = (a, b, w)
        root[a] = root[b] = node
        size[node] = size[a] + size[b]
        node += 1
    # condense: a split into two large parts makes two clusters, small parts fall out
    births, mass, kids, members = {0: 0.0}, {0: 0.0}, {0: []}, {0: []}
    stack = [(2 * n - 2, 0)]

    def points_of(x: int) -> list[int]:
        out, todo = [], [x]
        while todo:
            y = todo.pop()
            if y < n:
                out.append(y)
            else:
                todo += sons[y][:2]
        return out

    while stack:
        node, cluster = stack.pop()
        if node < n:
            members[cluster].append(node)
            continue
        a, b, w = sons[node]
        level = 1 / w if w > 0 else 1e12
        large = [s for s in (a, b) if size[s] >= min_cluster_size]
        if len(large) == 2:
            mass[cluster] += (level - births[cluster]) * size[node]
            for s in large:
                new = len(births)
                births[new], mass[new], kids[new], members[new] = level, 0.0, [], []
                kids[cluster].append(new)
                stack.append((s, new))
        else:
            for s in (a, b):
                if large and s == large[0]:
                    stack.append((s, cluster))
                else:
                    out = points_of(s)
                    members[cluster] += out
                    mass[cluster] += (level - births[cluster]) * len(out)
    chosen: set[int] = set()
    total = dict(mass)
    for c in sorted(births, reverse=True):
        below = sum(total[k] for k in kids[c])
        if c and (not kids[c] or mass[c] >= below):
            todo = list(kids[c])
            while todo:
                x = todo.pop()
                chosen.discard(x)
                todo += kids[x]
            chosen.add(c)
        else:
            total[c] = below
    labels = np.full(n, -1)
    for number, c in enumerate(sorted(chosen)):
        todo = [c]
        while todo:
            x = todo.pop()
            labels[members[x]] = number
            todo += kids[x]
    return labels


def hdbscan(docs: DataFrame, min_cluster_size: int = 5, block_rows: int = DENSITY_BLOCK) -> DataFrame:
    """(id, label) of every row with a vector, exactly. Quadratic by nature in time: each block of rows meets each other. Memory and disk are linear
    in the rows; one task merges the links and cuts the tree. Vectors with components that are null or not finite are noise."""
    from .density import density

    single = docs.schema["embedding"].dataType.simpleString() == "array<float>"
    v = F.col("embedding") if single else V.doubles(F.col("embedding"))
    return density(docs.where(F.col("embedding").isNotNull()).select(F.col("id").cast("long").alias("id"), v.alias("v")), min_cluster_size, block_rows)


def inertia(docs: DataFrame, centroids: DataFrame) -> DataFrame:
    return assign(docs, centroids, 12).agg(F.sum("distance").alias("inertia"))


def silhouette(docs: DataFrame, sample_rows: int = SILHOUETTE_SAMPLE, seed: int = 0) -> DataFrame:
    """Mean Euclidean silhouette of (id, embedding, label), labels from 0 up; null with fewer than two labels. The sample is bounded, so its
    matrix is collected; every task holds it against its own share of the sample."""
    rows = docs.where((F.col("label") >= 0) & F.col("embedding").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), V.doubles(F.col("embedding")).alias("v"))
    rows = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows)
    found = rows.collect()
    points, labels = np.array([r["v"] for r in found], float), np.array([r["label"] for r in found], int)
    names, code = np.unique(labels, return_inverse=True)
    counts = np.bincount(code, minlength=len(names))
    spark = docs.sparkSession
    if len(names) < 2 or (counts == 1).all():
        return spark.createDataFrame([(None,)], "silhouette double")

    def score(parts):
        for part in parts:
            own = np.stack(part["v"].map(np.asarray).to_list())
            mine = np.searchsorted(names, part["label"].to_numpy())
            d = np.sqrt(np.maximum(0, (own**2).sum(1)[:, None] + (points**2).sum(1)[None] - 2 * own @ points.T))
            sums = np.stack([d[:, code == c].sum(1) for c in range(len(names))], 1)
            at = np.arange(len(own))
            a = sums[at, mine] / np.maximum(counts[mine] - 1, 1)
            means = sums / counts
            means[at, mine] = np.inf
            b = means.min(1)
            yield pd.DataFrame({"s": np.where(counts[mine] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)})

    return spark.createDataFrame(found, rows.schema).mapInPandas(score, "s double").agg(F.avg("s").alias("silhouette"))


def tags(docs: DataFrame, n_keywords: int = 5, max_features: int = 100, max_df: float = 0.95, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(label, tags): per label the n best one- and two-word terms by summed TF-IDF over its rows (text, label).

    Terms are words of two characters or more outside the stop list and pairs of neighbours among them; terms in over max_df of a label's rows
    are left out, the max_features most frequent stay; idf is smoothed, rows are normalised. Label -1 is 'outliers'; a label without terms is
    'cluster_<label>'. Ties: score, then term, descending.
    """
    rows = docs.select(F.col("label").cast("long").alias("label"), F.monotonically_increasing_id().alias("__row") if "id" not in docs.columns else F.col("id").alias("__row"), F.lower("text").alias("t"))
    words = F.filter(F.regexp_extract_all("t", F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(list(stop_words)))
    rows = rows.withColumn("w", words)
    n = rows.groupBy("label").agg(F.count("*").alias("n"))
    rows = rows.where("label >= 0")
    # no term that stays is rarer than the max_features-th word of those in few enough rows, and no pair is more frequent than its words: only
    # counts of words, then of frequent words and pairs of them, are shuffled
    each = F.concat(F.transform("w", lambda t: F.struct(t.alias("term"), F.lit(1).alias("total"), F.lit(0).alias("df"))), F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("total"), F.lit(1).alias("df"))))
    single = materialize(rows.select("label", F.explode(each).alias("e")).groupBy("label", "e.term").agg(F.sum("e.total").alias("total"), F.sum("e.df").alias("df")), "words")
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("total")))
    least = single.join(n, "label").where(F.col("df") <= F.col("n") * max_df).withColumn("__r", place).where(F.col("__r") == max_features).select("label", F.col("total").alias("least"))
    common = materialize(single.join(least, "label", "left").where(F.col("total") >= F.coalesce("least", F.lit(0))).select("label", "term"), "common")
    # each word with the next; of a frequent one remain itself and its pair, if the next is frequent too
    found = rows.select("label", "__row", F.explode(F.transform("w", lambda x, i: F.struct(x.alias("a"), F.get("w", i + 1).alias("b")))).alias("e")).select("label", "__row", "e.*")
    if common.count() <= MAX_SENT_TERMS:
        found = found.join(F.broadcast(common.withColumnRenamed("term", "a")), ["label", "a"])
        found = found.join(F.broadcast(common.select("label", F.col("term").alias("b"), F.lit(True).alias("__pair"))), ["label", "b"], "left")
    else:
        found = found.withColumn("__pair", F.col("b").isNotNull())
    terms = F.when(F.col("__pair"), F.array("a", F.concat_ws(" ", "a", "b"))).otherwise(F.array("a"))
    tf = materialize(found.select("label", "__row", F.explode(terms).alias("term")).groupBy("label", "__row", "term").agg(F.count("*").alias("tf")), "tf")
    df = tf.groupBy("label", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).join(n, "label").where(F.col("df") <= F.col("n") * max_df)
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("total"), "term"))
    vocabulary = df.withColumn("__r", rank).where(F.col("__r") <= max_features).select("label", "term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = tf.where("__row is not null").join(F.broadcast(vocabulary) if max_features <= 1000 else vocabulary, ["label", "term"]).withColumn("x", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("label", "__row")))
    scores = weighted.withColumn("norm", norm).groupBy("label", "term").agg(F.round(F.sum(F.col("x") / F.col("norm")), 6).alias("score"))
    best = scores.withColumn("__r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), F.desc("term")))).where(F.col("__r") <= n_keywords)
    joined = best.groupBy("label").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__r", "term"))), lambda s: s["term"]), ", ").alias("tags"))
    named = F.when(F.col("label") < 0, F.lit("outliers")).otherwise(F.coalesce("tags", F.concat(F.lit("cluster_"), F.col("label").cast("string"))))
    return n.join(joined, "label", "left").select("label", named.alias("tags"))


def custom_tags(docs: DataFrame, callback: Callable[[list[str]], str]) -> DataFrame:
    """(label, tags) from a callback over each label's texts."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"label": [group["label"].iloc[0]], "tags": [str(callback(group["text"].tolist()))]})

    return docs.select(F.col("label").cast("long").alias("label"), "text").groupBy("label").applyInPandas(run, "label long, tags string")


def summary(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("label").agg(F.count("*").alias("n"))
