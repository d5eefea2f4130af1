"""Clustering, its quality measures and dimension reduction."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismill.functions.keys import MODULUS, scatter
from prismill.operators.blocks import each_block_pair, matrix, squared_distances
from prismill.session import cut_lineage, stored_round

# --- k-means ----------------------------------------------------------------------


def _distance2(columns: list[str], center: list[float]) -> Column:
    terms = [(F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, center)]
    out = terms[0]
    for term in terms[1:]:
        out = out + term
    return out


def assign(df: DataFrame, columns: list[str], centers: list[list[float]]) -> DataFrame:
    """Add the nearest center (lowest number on a tie) and the squared distance to it: one projection."""
    options = F.array(*[F.struct(_distance2(columns, c).alias("d"), F.lit(i).alias("c")) for i, c in enumerate(centers)])
    return df.withColumn("_near", F.array_min(options)).withColumns(
        {"cluster": F.col("_near.c"), "distance2": F.col("_near.d")}
    ).drop("_near")


def start_centers(df: DataFrame, columns: list[str], k: int, how: str, row_id: str, seed: int = 0, rounds: int = 5) -> list[list[float]]:
    """Start rows: a random sample, or spread out in proportion to squared distance.

    Spread-out starts take ``rounds`` passes whatever k is (Bahmani et al. 2012): each draws 2 k rows in proportion to their squared distance
    to all rows drawn before. The candidates, about ten for each start, are weighted by the rows nearest to them, and
    k of them are drawn one by one.
    """
    if how == "random":
        rows = df.orderBy(scatter(row_id, seed), row_id).limit(k).select(*columns).collect()
        return [[float(v) for v in r] for r in rows]
    if how != "k-means++":
        raise ValueError(f"unknown start {how}")
    drawn: list[list[float]] = []
    for i in range(rounds + 1):
        luck = (scatter(row_id, seed * 31 + i) + F.lit(1)) / F.lit(float(MODULUS) + 1)
        weight = F.array_min(F.array(*[_distance2(columns, c) for c in drawn])) if drawn else F.lit(1.0)
        # the largest values of log(u) / w fall on rows with probability in proportion to w
        spread = df.select(*columns, row_id, weight.alias("_w"), luck.alias("_u")).where("_w > 0")
        rows = spread.orderBy((F.log("_u") / F.col("_w")).desc(), row_id).limit(2 * k if drawn else 1).collect()
        drawn += [[float(r[c]) for c in columns] for r in rows]
    near = {r["cluster"]: r["n"] for r in assign(df, columns, drawn).groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    points, mass = np.array(drawn), np.array([near.get(i, 0) for i in range(len(drawn))], float)
    chance, chosen = np.random.default_rng(seed), []
    away = np.ones(len(points))
    for _ in range(k):
        share = mass * away
        if share.sum() <= 0:  # fewer different rows than starts
            chosen.append(chosen[0])
            continue
        chosen.append(int(chance.choice(len(points), p=share / share.sum())))
        away = ((points[:, None] - points[None, chosen]) ** 2).sum(axis=2).min(axis=1)
    return points[chosen].tolist()


def kmeans_rounds(
    df: DataFrame, columns: list[str], k: int, row_id: str, init: str = "k-means++", seed: int = 0,
    max_iter: int = 30, tol: float = 1e-6, start: list[list[float]] | None = None,
) -> DataFrame:
    """Lloyd rounds as a table: per round and cluster its rows, its center before and after, and the round's inertia and shift.

    The state between rounds is k centers; a round is one aggregate over the input, so there is no lineage to cut. The
    aggregate also finds each cluster's farthest row, so an empty cluster gets its new center (the row farthest
    from any) without another pass. Rounds end once the centers move by less than ``tol`` together.
    """
    at = np.array(start or start_centers(df, columns, k, init, row_id, seed), dtype=float)
    farthest = F.max(F.struct("distance2", -F.col(row_id), F.array(*[F.col(c).cast("double") for c in columns]).alias("p")))
    rows = []
    for number in range(1, max_iter + 1):
        seen = assign(df, columns, at.tolist()).groupBy("cluster").agg(
            F.count("*").alias("n"), F.sum("distance2").alias("spread"), F.array(*[F.avg(c) for c in columns]).alias("mean"), farthest.alias("far")
        ).collect()
        to = np.tile(np.array(max(r["far"] for r in seen)["p"]), (len(at), 1))
        n = np.zeros(len(at), dtype=int)
        for r in seen:
            to[r["cluster"]], n[r["cluster"]] = r["mean"], r["n"]
        shift = float(np.sqrt(((to - at) ** 2).sum(axis=1)).sum())
        inertia = float(sum(r["spread"] for r in seen))
        rows += [(number, c, int(n[c]), *a, *b, inertia, shift) for c, (a, b) in enumerate(zip(at.tolist(), to.tolist()))]
        at = to
        if shift < tol:
            break
    fields = "iteration int, cluster int, n bigint, " + ", ".join(f"{p}_{c} double" for p in ("from", "to") for c in columns)
    return df.sparkSession.createDataFrame(rows, fields + ", inertia double, shift double")


def vectors(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    if len(columns) == 1 and df.schema[columns[0]].dataType.typeName() == "array":
        return df.withColumn(out, array_to_vector(F.col(columns[0]).cast("array<double>")))
    return df.withColumn(out, array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])))


def elbow_curve(df: DataFrame, columns: list[str], k_max: int = 10, seed: int = 0) -> DataFrame:
    """Within-cluster sum of squares for k = 1..k_max."""
    from pyspark.ml.clustering import KMeans

    rows = vectors(df, columns).select("features").persist()
    costs = []
    for k in range(1, k_max + 1):
        if k == 1:
            from pyspark.ml.stat import Summarizer

            total = rows.agg(Summarizer.metrics("variance", "count").summary(F.col("features")).alias("s")).select("s.*").first()
            costs.append((1, float(sum(total["variance"]) * (total["count"] - 1))))
            continue
        model = KMeans(k=k, seed=seed, maxIter=40, tol=1e-6).fit(rows)
        costs.append((k, float(model.summary.trainingCost)))
    rows.unpersist()
    return df.sparkSession.createDataFrame(costs, "k int, inertia double")


def elbow_point(curve: DataFrame) -> DataFrame:
    """The k farthest from the line between the two ends of the curve."""
    ends = curve.agg(
        F.struct(F.min("k").alias("k0"), F.max("k").alias("k1"), F.min_by("inertia", "k").alias("y0"), F.max_by("inertia", "k").alias("y1"))
    ).scalar()
    dx, dy = F.col("_e.k1") - F.col("_e.k0"), F.col("_e.y1") - F.col("_e.y0")
    cross = F.abs(dx * (F.col("inertia") - F.col("_e.y0")) - dy * (F.col("k") - F.col("_e.k0"))) / F.sqrt(dx * dx + dy * dy)
    away = curve.withColumn("_e", ends).withColumn("away", cross)
    return away.agg(F.max(F.struct("away", (-F.col("k")).alias("k"))).alias("b")).select((-F.col("b.k")).alias("k"), F.col("b.away").alias("away"))


# --- quality ----------------------------------------------------------------------


def silhouette_points(df: DataFrame, row_id: str, vector: str, cluster: str) -> DataFrame:
    """Exact Euclidean silhouette of every point.

    Distances are summed per point and cluster inside bounded blocks; what is shuffled is one row per
    point, cluster and block. See ``silhouette_squared`` for the linear-time variant.
    """
    rows = df.select(F.col(row_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(cluster).cast("bigint").alias("c"))

    def sums(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        d = np.sqrt(squared_distances(matrix(x["v"]), matrix(y["v"])))
        # a point is at distance zero from itself, whatever rounding says
        d[x["id"].to_numpy()[:, None] == y["id"].to_numpy()[None, :]] = 0.0
        labels, place = np.unique(y["c"].to_numpy(), return_inverse=True)
        total = np.stack([d[:, place == i].sum(axis=1) for i in range(len(labels))], axis=1)
        return pd.DataFrame(
            {"id": np.repeat(x["id"].to_numpy(), len(labels)), "own": np.repeat(x["c"].to_numpy(), len(labels)),
             "c": np.tile(labels, len(x)), "total": total.ravel()}
        )

    def added(found: pd.DataFrame) -> pd.DataFrame:
        return found.groupby(["id", "own", "c"], as_index=False, dropna=False)["total"].sum()

    partial = each_block_pair(rows, rows, "id", "id", sums, "id bigint, own bigint, c bigint, total double", merge=added)
    sizes = rows.groupBy("c").agg(F.count("*").alias("n"))
    means = partial.groupBy("id", "own", "c").agg(F.sum("total").alias("total")).join(sizes, "c")
    own = F.col("c") == F.col("own")
    per = means.groupBy("id", F.col("own").alias("cluster")).agg(
        F.max(F.when(own, F.col("n"))).alias("_n"),
        F.max(F.when(own, F.try_divide("total", F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
    )
    value = F.when((F.col("_n") > 1) & F.col("b").isNotNull(), F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return per.select(F.col("id").alias(row_id), "cluster", F.coalesce(value, F.lit(0.0)).alias("silhouette"))


def silhouette_summary(points: DataFrame) -> DataFrame:
    return points.agg(F.avg("silhouette").alias("silhouette"), F.count_if(F.col("silhouette") < 0).alias("negative"))


def silhouette_squared(df: DataFrame, vector: str, cluster: str) -> float:
    """Mean silhouette with squared distances: one pass with cluster sums, for any number of rows."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    rows = vectors(df, [vector]).select("features", F.col(cluster).cast("double").alias("prediction"))
    return float(ClusteringEvaluator().evaluate(rows))


def adjusted_rand(df: DataFrame, truth: str, found: str) -> DataFrame:
    """Chance-corrected agreement of two groupings, from their contingency counts."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(found).alias("f")).agg(F.count("*").cast("double").alias("n"))

    def pairs(counts: DataFrame) -> Column:
        return counts.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).scalar()

    rows = cells.groupBy("t").agg(F.sum("n").alias("n"))
    columns = cells.groupBy("f").agg(F.sum("n").alias("n"))
    facts = cells.agg(F.sum("n").alias("n")).withColumns(
        {"both": pairs(cells), "rows": pairs(rows), "columns": pairs(columns), "all": F.col("n") * (F.col("n") - 1) / 2}
    )
    expected = F.col("rows") * F.col("columns") / F.col("all")
    best = (F.col("rows") + F.col("columns")) / 2
    score = F.when(best == expected, 1.0).otherwise((F.col("both") - expected) / (best - expected))
    return facts.select(F.coalesce(score, F.lit(1.0)).alias("adjusted_rand"))


def cluster_counts(df: DataFrame, cluster: str) -> DataFrame:
    """Clusters found (noise is -1) and noise rows."""
    return df.agg(
        F.count_distinct(F.when(F.col(cluster) != -1, F.col(cluster))).alias("clusters"),
        F.count_if(F.col(cluster) == -1).alias("noise"),
    )


# --- density ----------------------------------------------------------------------

# Cells a point within eps may lie in, for cells whose diagonal is eps.
_AROUND = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) != (0, 0) and abs(i) + abs(j) < 4]
_PARTS = 4  # sub-cells per cell side when two cells are tested for a link


def _neighbours(df: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each row once per neighbouring cell, in columns ``nx, ny``."""
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])
    return df.withColumn("_o", F.explode(shifts)).withColumns(
        {"nx": F.col("cx") + F.col("_o.i"), "ny": F.col("cy") + F.col("_o.j")}
    ).drop("_o")


def _near(eps: float, a: str = "", b: str = "o_") -> Column:
    dx, dy = F.col(f"{a}x") - F.col(f"{b}x"), F.col(f"{a}y") - F.col(f"{b}y")
    return dx * dx + dy * dy <= F.lit(eps * eps)


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node id of each component: neighbours' labels, then labels of labels, until nothing changes.

    ``nodes`` has ``node, label``; ``edges`` has ``a, b`` in both directions. What any node hears its label's node hears too, and
    following the label's own label halves the remaining path, so rounds grow with the logarithm of a path, not with its length.
    """
    labels = stored_round(nodes.select("node", "label"))
    for _ in range(max_rounds):
        heard = edges.join(labels, edges["a"] == labels["node"]).groupBy("b").agg(F.min("label").alias("heard"))
        lower = labels.join(heard, labels["node"] == heard["b"], "left").select(
            "node", F.col("label").alias("before"), F.least("label", F.coalesce("heard", "label")).alias("label")
        )
        told = lower.groupBy(F.col("before").alias("_of")).agg(F.min("label").alias("_told"))
        lower = lower.join(told, lower["node"] == told["_of"], "left").select("node", "before", F.least("label", F.coalesce("_told", "label")).alias("label"))
        jump = lower.select(F.col("node").alias("_k"), F.col("label").alias("_l"))
        after = stored_round(
            lower.join(jump, lower["label"] == jump["_k"], "left").select(
                "node", "before", F.least("label", F.coalesce("_l", "label")).alias("label")
            )
        )
        changed = after.where("label <> before").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def dbscan(df: DataFrame, row_id: str, x: str, y: str, eps: float, min_samples: int) -> DataFrame:
    """Density clusters of points in the plane: id, core flag and cluster (its lowest core id; noise -1).

    Cells have diagonal eps, so a cell with ``min_samples`` points is all core without looking at pairs,
    and equal points are counted once. Only points of sparse cells (fewer than
    ``min_samples`` each) are compared with the points of the 20 cells around them.
    """
    side = eps / math.sqrt(2)
    cell = lambda c: F.floor(F.col(c) / F.lit(side))
    sites = df.select(F.col(row_id).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).groupBy("x", "y").agg(
        F.count("*").alias("n"), F.min("id").alias("site")
    ).withColumns({"cx": cell("x"), "cy": cell("y")})
    sites = cut_lineage(sites)
    cells = sites.groupBy("cx", "cy").agg(F.sum("n").alias("cell_n"))
    placed = sites.join(cells, ["cx", "cy"])
    sparse = placed.where(F.col("cell_n") < min_samples)
    other = sites.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("x").alias("o_x"), F.col("y").alias("o_y"), F.col("n").alias("o_n"))
    outside = _neighbours(sparse, _AROUND).join(other, ["nx", "ny"]).where(_near(eps)).groupBy("site").agg(F.sum("o_n").alias("outside"))
    rated = placed.join(outside, "site", "left")
    core_flag = F.col("cell_n") + F.coalesce("outside", F.lit(0)) >= min_samples
    rated = cut_lineage(rated.select("site", "x", "y", "n", "cx", "cy", core_flag.alias("core")))
    core = rated.where("core")
    members = core.groupBy("cx", "cy").agg(F.min("site").alias("node"))

    # cells whose core points link: first by one representative per sub-cell, then by the rest
    part = lambda c, base: F.least(F.lit(_PARTS - 1), F.greatest(F.lit(0), F.floor((F.col(c) / F.lit(side) - F.col(base)) * _PARTS)))
    fine = core.withColumns({"px": part("x", "cx"), "py": part("y", "cy")})
    boxes = fine.groupBy("cx", "cy", "px", "py").agg(
        F.min_by("x", "site").alias("x"), F.min_by("y", "site").alias("y"), F.count("*").alias("m"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
    )
    forward = [(i, j) for i, j in _AROUND if (i, j) > (0, 0)]
    theirs = boxes.select(*[F.col(c).alias({"cx": "nx", "cy": "ny"}.get(c, f"o_{c}")) for c in boxes.columns])
    pairs = _neighbours(boxes, forward).join(theirs, ["nx", "ny"])
    gap = lambda a: F.greatest(F.lit(0.0), F.col(f"{a}0") - F.col(f"o_{a}1"), F.col(f"o_{a}0") - F.col(f"{a}1"))
    possible = gap("x") * gap("x") + gap("y") * gap("y") <= F.lit(eps * eps)
    pairs = cut_lineage(pairs.withColumn("linked", _near(eps)).where(possible))
    key = ["cx", "cy", "nx", "ny"]
    sure = pairs.where("linked").select(*key).distinct()
    open_pairs = pairs.where((F.col("m") > 1) | (F.col("o_m") > 1)).join(sure, key, "left_anti")
    near_box = lambda p: (
        (F.greatest(F.lit(0.0), F.col(f"{p}x0") - F.col("sx"), F.col("sx") - F.col(f"{p}x1")) ** 2
         + F.greatest(F.lit(0.0), F.col(f"{p}y0") - F.col("sy"), F.col("sy") - F.col(f"{p}y1")) ** 2) <= F.lit(eps * eps)
    )
    points = fine.select("cx", "cy", "px", "py", F.col("x").alias("sx"), F.col("y").alias("sy"))
    ours = open_pairs.join(points, ["cx", "cy", "px", "py"]).where(near_box("o_"))
    ours = ours.select(*key, "px", "py", "o_px", "o_py", F.col("sx").alias("x"), F.col("sy").alias("y"))
    mates = points.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("px").alias("o_px"), F.col("py").alias("o_py"), "sx", "sy")
    mates = open_pairs.select(*key, "px", "py", "o_px", "o_py", "x0", "x1", "y0", "y1").join(mates, ["nx", "ny", "o_px", "o_py"]).where(near_box(""))
    mates = mates.select(*key, "px", "py", "o_px", "o_py", F.col("sx").alias("o_x"), F.col("sy").alias("o_y"))
    rest = ours.join(mates, [*key, "px", "py", "o_px", "o_py"]).where(_near(eps)).select(*key).distinct()
    links = sure.union(rest)
    a, b = members.select("cx", "cy", F.col("node").alias("a")), members.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("node").alias("b"))
    edges = links.join(a, ["cx", "cy"]).join(b, ["nx", "ny"]).select("a", "b")
    edges = cut_lineage(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    # a cell's node is its lowest core site, so the lowest node of a component is its lowest core point
    found = connected_components(members.select("node", F.col("node").alias("label")), edges)
    cell_cluster = members.join(found, "node").select("cx", "cy", F.col("label").alias("cluster"))

    core_labels = core.join(cell_cluster, ["cx", "cy"]).select("site", "x", "y", "cx", "cy", "cluster")
    fringe = rated.where("NOT core")
    near_core = core_labels.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("x").alias("o_x"), F.col("y").alias("o_y"), "cluster")
    border = _neighbours(fringe, [(0, 0), *_AROUND]).join(near_core, ["nx", "ny"]).where(_near(eps)).groupBy("site").agg(F.min("cluster").alias("cluster"))
    everyone = core_labels.select("x", "y", F.lit(True).alias("core"), "cluster").unionByName(
        fringe.join(border, "site", "left").select("x", "y", F.lit(False).alias("core"), F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    )
    points = df.select(F.col(row_id), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return points.join(everyone, ["x", "y"]).select(row_id, "core", "cluster")


# --- MLlib models -----------------------------------------------------------------


def hierarchical(df: DataFrame, columns: list[str], k: int, seed: int = 0) -> DataFrame:
    """Top-down hierarchy cut at k clusters."""
    from pyspark.ml.clustering import BisectingKMeans

    rows = vectors(df, columns)
    model = BisectingKMeans(k=k, seed=seed, minDivisibleClusterSize=2).fit(rows)
    return model.transform(rows).withColumnRenamed("prediction", "cluster").drop("features")


def gaussian_mixture(df: DataFrame, columns: list[str], k: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Hard labels and the component means of a full-covariance mixture."""
    from pyspark.ml.clustering import GaussianMixture

    rows = vectors(df, columns)
    model = GaussianMixture(k=k, seed=seed).fit(rows)
    means = [(i, float(w), [float(v) for v in g.mean]) for i, (w, g) in enumerate(zip(model.weights, model.gaussians))]
    labels = model.transform(rows).withColumnRenamed("prediction", "cluster").drop("features", "probability")
    return labels, df.sparkSession.createDataFrame(means, "cluster int, weight double, mean array<double>")


def standard_vectors(df: DataFrame, columns: list[str], out: str = "scaled") -> DataFrame:
    """Vectors with mean 0 and population deviation 1 per coordinate; constant coordinates keep deviation 1."""
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors(df, columns)
    n = rows.count()
    model = StandardScaler(inputCol="features", outputCol="_s", withMean=True, withStd=True).fit(rows)
    grow = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    scaled = model.transform(rows)
    return scaled.withColumn(out, array_to_vector(F.transform(vector_to_array("_s"), lambda v: v * F.lit(grow)))).drop("features", "_s")


def principal_components(df: DataFrame, columns: list[str], k: int = 20) -> tuple[DataFrame, DataFrame]:
    """Coordinates on the first components of the standardised data, and the variance shares."""
    from pyspark.ml.feature import PCA

    rows = standard_vectors(df, columns)
    width = len(rows.select("scaled").first()["scaled"])
    model = PCA(k=min(k, width), inputCol="scaled", outputCol="components").fit(rows)
    shares = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance)]
    return model.transform(rows).drop("scaled"), df.sparkSession.createDataFrame(shares, "component int, share double")


def dimensions_for(shares: DataFrame, goal: float = 0.95) -> DataFrame:
    """The first component at which the cumulative share reaches the goal."""
    so_far = F.sum("share").over(Window.partitionBy(F.lit(0)).orderBy("component").rowsBetween(Window.unboundedPreceding, 0))
    return shares.withColumn("cumulative", so_far).where(F.col("cumulative") >= goal).agg(F.min("component").alias("dimensions"))
