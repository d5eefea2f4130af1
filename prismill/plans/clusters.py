"""Clustering, neighbour and reduction queries on parts and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismill.operators import clustering as K
from prismill.operators import neighbours as N
from prismill.plans.registry import query, table


def plane(spark, folder):
    """Parts as points in the plane."""
    return table(spark, folder, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("x"), ((F.col("p_partkey") * 7919) % 1000 / 20.0).alias("y"), "p_type"
    )


PLANE = "pl AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, (p_partkey * 7919) % 1000 / 20.0::DOUBLE AS y FROM part)"
_START = [[10.0, 10.0], [10.0, 40.0], [40.0, 25.0]]


def _lloyd_sql(steps: int) -> str:
    parts = [PLANE, "c0 AS (SELECT * FROM (VALUES (0, 10.0::DOUBLE, 10.0::DOUBLE), (1, 10.0, 40.0), (2, 40.0, 25.0)) t(c, x, y))"]
    for i in range(steps):
        parts.append(
            f"""a{i} AS (SELECT p_partkey, any_value(pl.x) AS x, any_value(pl.y) AS y, arg_min(c, (pl.x - c{i}.x) ** 2 + (pl.y - c{i}.y) ** 2) AS c,
            min((pl.x - c{i}.x) ** 2 + (pl.y - c{i}.y) ** 2) AS d FROM pl, c{i} GROUP BY p_partkey),
            c{i + 1} AS (SELECT c, avg(x) AS x, avg(y) AS y, count(*) AS n, sum(d) AS d FROM a{i} GROUP BY c)"""
        )
    rows = " UNION ALL ".join(
        f"""SELECT {i + 1} AS iteration, b.c AS cluster, b.n, round(a.x, 6) AS from_x, round(a.y, 6) AS from_y, round(b.x, 6) AS to_x, round(b.y, 6) AS to_y,
        round((SELECT sum(d) FROM c{i + 1}), 4) AS inertia, round((SELECT sum(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)) FROM c{i} p JOIN c{i + 1} q ON p.c = q.c), 6) AS shift
        FROM c{i} a JOIN c{i + 1} b ON a.c = b.c"""
        for i in range(steps)
    )
    return f"WITH {', '.join(parts)} {rows}"


@query("kmeans_history", "K01", _lloyd_sql(4))
def kmeans_history(spark, folder):
    points = plane(spark, folder)
    out = K.kmeans_rounds(points, ["x", "y"], 3, "p_partkey", max_iter=4, start=_START)
    return out.select("iteration", "cluster", "n", *[F.round(c, 4 if c == "inertia" else 6).alias(c) for c in out.columns[3:]])


@query("kmeans_plus_plus", "K01")
def kmeans_plus_plus(spark, folder):
    points = plane(spark, folder)
    return K.kmeans_rounds(points, ["x", "y"], 4, "p_partkey", seed=1)


@query(
    "elbow_of_one_cluster",
    "K02",
    f"WITH {PLANE} SELECT 1 AS k, round((var_pop(x) + var_pop(y)) * count(*), 3) AS inertia FROM pl",
)
def elbow_of_one_cluster(spark, folder):
    """Where the curve starts: all points around their mean."""
    return K.elbow_curve(plane(spark, folder), ["x", "y"], 1).select("k", F.round("inertia", 3).alias("inertia"))


@query("elbow_curve", "K02")
def elbow_curve(spark, folder):
    return K.elbow_curve(plane(spark, folder), ["x", "y"])


@query(
    "elbow_point",
    "K03",
    """
    WITH g AS (SELECT k, p_partkey % k AS g, var_pop(p_retailprice) * count(*) AS s FROM part, (SELECT unnest(range(1, 11)) AS k) GROUP BY 1, 2),
    q AS (SELECT CAST(k AS INT) AS k, sum(s) / (k * k) AS inertia FROM g GROUP BY k),
    e AS (SELECT min(k) AS k0, max(k) AS k1, arg_min(inertia, k) AS y0, arg_max(inertia, k) AS y1 FROM q),
    d AS (SELECT k, abs((k1 - k0) * (inertia - y0) - (y1 - y0) * (k - k0)) / sqrt((k1 - k0) ** 2 + (y1 - y0) ** 2) AS away FROM q, e)
    SELECT k, round(away, 5) AS away FROM d ORDER BY d.away DESC, k LIMIT 1
    """,
)
def elbow_point(spark, folder):
    """The curve here is the spread left within remainder groups of the part key, shrunk by k squared."""
    rows = table(spark, folder, "part").select("p_partkey", "p_retailprice", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("k"))
    groups = rows.groupBy("k", (F.col("p_partkey") % F.col("k")).alias("g")).agg((F.var_pop("p_retailprice") * F.count("*")).alias("s"))
    curve = groups.groupBy("k").agg((F.sum("s") / (F.col("k") * F.col("k"))).alias("inertia"))
    return K.elbow_point(curve).withColumn("away", F.round("away", 5))


def vectors(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


_SIL = """
    p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[64]) AS v FROM embeddings),
    n AS (SELECT label, count(*) AS n FROM p GROUP BY 1),
    s AS (SELECT a.vec_id, a.label AS own, b.label AS c, sum(array_distance(a.v, b.v)) AS t FROM p a, p b GROUP BY 1, 2, 3),
    r AS (SELECT vec_id, own, max(CASE WHEN c = own THEN n.n END) AS n, max(CASE WHEN c = own THEN t / nullif(n.n - 1, 0) END) AS a,
      min(CASE WHEN c <> own THEN t / n.n END) AS b FROM s JOIN n ON n.label = s.c GROUP BY 1, 2),
    si AS (SELECT vec_id, own AS cluster, CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END AS silhouette FROM r)
"""


@query("silhouette_points", "K04", f"WITH {_SIL} SELECT vec_id, CAST(cluster AS BIGINT) AS cluster, round(silhouette, 6) AS silhouette FROM si")
def silhouette_points(spark, folder):
    out = K.silhouette_points(vectors(spark, folder), "vec_id", "v", "label")
    return out.withColumn("silhouette", F.round("silhouette", 6))


@query("silhouette_mean", "K04", f"WITH {_SIL} SELECT round(avg(silhouette), 8) AS silhouette, count(*) FILTER (WHERE silhouette < 0) AS negative FROM si")
def silhouette_mean(spark, folder):
    out = K.silhouette_summary(K.silhouette_points(vectors(spark, folder), "vec_id", "v", "label"))
    return out.withColumn("silhouette", F.round("silhouette", 8))


@query(
    "adjusted_rand",
    "K05",
    """
    WITH c AS (SELECT o_orderpriority AS t, o_orderstatus || CASE WHEN o_totalprice > 250000 THEN 'x' ELSE 'y' END AS f, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2),
    r AS (SELECT sum(n) AS n FROM c GROUP BY t), k AS (SELECT sum(n) AS n FROM c GROUP BY f),
    v AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS b, (SELECT sum(n * (n - 1) / 2) FROM r) AS r, (SELECT sum(n * (n - 1) / 2) FROM k) AS k,
      (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS a)
    SELECT round((b - r * k / a) / ((r + k) / 2 - r * k / a), 9) AS adjusted_rand FROM v
    """,
)
def adjusted_rand(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("t"), F.concat("o_orderstatus", F.when(F.col("o_totalprice") > 250000, "x").otherwise("y")).alias("f")
    )
    return K.adjusted_rand(rows, "t", "f").withColumn("adjusted_rand", F.round("adjusted_rand", 9))


_DBSCAN = f"""
    WITH RECURSIVE {PLANE},
    nb AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM pl a JOIN pl b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1.23 * 1.23::DOUBLE),
    core AS (SELECT a AS id FROM nb GROUP BY a HAVING count(*) >= 5),
    ed AS (SELECT a, b FROM nb WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    cc(id, root) AS (SELECT id, id FROM core UNION SELECT ed.b, cc.root FROM cc JOIN ed ON ed.a = cc.id),
    lb AS (SELECT id, min(root) AS cluster FROM cc GROUP BY id),
    bo AS (SELECT nb.a AS id, min(cluster) AS cluster FROM nb JOIN lb ON lb.id = nb.b WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY 1),
    al AS (SELECT p_partkey, lb.id IS NOT NULL AS core, coalesce(lb.cluster, bo.cluster, -1) AS cluster FROM pl LEFT JOIN lb ON lb.id = p_partkey LEFT JOIN bo ON bo.id = p_partkey)
"""


@query("density_clusters", "K06", f"{_DBSCAN} SELECT * FROM al")
def density_clusters(spark, folder):
    return K.dbscan(plane(spark, folder), "p_partkey", "x", "y", 1.23, 5)


@query(
    "density_cluster_counts",
    "K09",
    f"{_DBSCAN} SELECT count(DISTINCT cluster) FILTER (WHERE cluster <> -1) AS clusters, count(*) FILTER (WHERE cluster = -1) AS noise FROM al",
)
def density_cluster_counts(spark, folder):
    return K.cluster_counts(K.dbscan(plane(spark, folder), "p_partkey", "x", "y", 1.23, 5), "cluster")


@query("hierarchical_clusters", "K07")
def hierarchical_clusters(spark, folder):
    out = K.hierarchical(plane(spark, folder), ["x", "y"], 4)
    return out.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))


@query("gaussian_mixture", "K08")
def gaussian_mixture(spark, folder):
    labels, means = K.gaussian_mixture(plane(spark, folder), ["x", "y"], 3)
    return labels.groupBy("cluster").agg(F.count("*").alias("n")).join(means, "cluster")


@query("principal_components", "K10")
def principal_components(spark, folder):
    return K.principal_components(vectors(spark, folder), ["v"], 20)[1]


@query(
    "two_principal_components",
    "K10",
    f"WITH {PLANE}, r AS (SELECT abs(corr(x, y)) AS r FROM pl) SELECT unnest([1, 2]) AS component, unnest([round((1 + r) / 2, 8), round((1 - r) / 2, 8)]) AS share FROM r",
)
def two_principal_components(spark, folder):
    """Of two standardised columns the components follow from their correlation."""
    shares = K.principal_components(plane(spark, folder), ["x", "y"], 2)[1]
    return shares.select("component", F.round("share", 8).alias("share"))


@query("dimensions_needed", "K11")
def dimensions_needed(spark, folder):
    return K.dimensions_for(K.principal_components(vectors(spark, folder), ["v"], 64)[1], 0.95)


@query(
    "dimensions_needed_by_variance",
    "K11",
    """
    WITH v AS (SELECT CAST(i AS INT) AS component, var_pop(CAST(embedding[i] AS DOUBLE)) AS s FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY i),
    c AS (SELECT component, sum(s) OVER (ORDER BY component) / sum(s) OVER () AS c FROM v)
    SELECT min(component) AS dimensions FROM c WHERE c >= 0.5
    """,
)
def dimensions_needed_by_variance(spark, folder):
    """The same cut on plain coordinate variances."""
    rows = vectors(spark, folder).select(F.posexplode("v").alias("i", "x"))
    spread = rows.groupBy((F.col("i") + 1).alias("component")).agg(F.var_pop("x").alias("s"))
    shares = spread.withColumn("share", F.col("s") / spread.agg(F.sum("s")).scalar())
    return K.dimensions_for(shares.select("component", "share"), 0.5)


for _weights in ("uniform", "distance"):

    @query(
        f"nearest_neighbours_{_weights}",
        "M02",
        f"""
        WITH p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[64]) AS v FROM embeddings),
        d AS (SELECT q.vec_id, t.vec_id AS tid, CAST(t.label AS VARCHAR) AS label, array_distance(q.v, t.v) AS d FROM p q, p t WHERE q.vec_id % 5 = 0 AND t.vec_id % 5 <> 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, tid) AS r FROM d),
        w AS (SELECT vec_id, label, sum({'1.0' if _weights == 'uniform' else '1 / d'}) AS w FROM r WHERE r <= 7 GROUP BY 1, 2)
        SELECT vec_id, arg_min(label, (-round(w, 12), label)) AS predicted FROM w GROUP BY 1
        """,
    )
    def _nearest(spark, folder, weights=_weights):
        rows = vectors(spark, folder)
        return N.knn_classify(rows.where("vec_id % 5 <> 0"), rows.where("vec_id % 5 = 0"), "vec_id", "v", "label", 7, weights)


@query(
    "naive_bayes",
    "M09",
    """
    WITH f AS (SELECT o_orderkey, o_orderstatus AS c, o_custkey * 1.0::DOUBLE AS a, o_totalprice / 1000 AS b, month(o_orderdate) * 1.0::DOUBLE AS d FROM orders),
    w AS (SELECT greatest(var_pop(a), var_pop(b), var_pop(d)) * 1e-9 AS eps FROM f),
    s AS (SELECT c, ln(count(*) / (SELECT count(*) FROM f)) AS pr, avg(a) AS ma, var_pop(a) + any_value(eps) AS va, avg(b) AS mb, var_pop(b) + any_value(eps) AS vb,
      avg(d) AS md, var_pop(d) + any_value(eps) AS vd FROM f, w GROUP BY c),
    l AS (SELECT o_orderkey, s.c, pr - 0.5 * ln(2 * pi() * va) - (a - ma) ** 2 / (2 * va) - 0.5 * ln(2 * pi() * vb) - (b - mb) ** 2 / (2 * vb)
      - 0.5 * ln(2 * pi() * vd) - (d - md) ** 2 / (2 * vd) AS score FROM f, s)
    SELECT o_orderkey, arg_max(c, score) AS predicted FROM l GROUP BY 1
    """,
)
def naive_bayes(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", F.col("o_custkey").cast("double").alias("a"), (F.col("o_totalprice") / 1000).alias("b"),
        F.month("o_orderdate").cast("double").alias("d"),
    )
    model = N.fit_naive_bayes(rows, ["a", "b", "d"], "o_orderstatus")
    return N.naive_bayes_classify(rows, ["a", "b", "d"], model).select("o_orderkey", "predicted")
