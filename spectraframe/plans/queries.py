"""The catalogue of queries over the test tables, each with its DuckDB SQL where SQL can express it.

Embeddings are read as 8 by 8 rasters; their label stands for a sample's parent or cluster; four in a row are one cell's channels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CHANNELS
from ..functions import registry
from ..operators import clustering, components, evaluate, generate, imaging, maskops, pixels
from ..sources import images as sources
from ..sources.rasters import pack

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.rasters(table(spark, sf_dir, "embeddings"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), "px")


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    """Doubles rounded, and no negative zero."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def masked(spark: SparkSession, sf_dir: str, p: float = 0.6) -> DataFrame:
    """Rasters with the mask of their pixels above a percentile."""
    return images(spark, sf_dir).withColumn("m", F.element_at(F.transform(F.array(pixels.array_percentile(F.col("px"), p)), lambda t: F.transform("px", lambda v: v > t)), 1))


def packed(batches: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    """Rows (image_id, image) of 8 by 8 rasters."""
    for pdf in batches:
        yield pd.DataFrame({"image_id": pdf["vec_id"], "image": [pack(np.array(x).reshape(8, 8)) for x in pdf[column]]})


PX = "p AS (SELECT vec_id, label, CAST((k - 1) // 8 AS INT) AS r, CAST((k - 1) % 8 AS INT) AS c, CAST(k - 1 AS INT) AS pos, v FROM (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings))"
MASK = PX + ", t AS (SELECT vec_id, quantile_cont(v, 0.6) AS t FROM p GROUP BY vec_id), m AS (SELECT p.*, v > t AS m FROM p JOIN t USING (vec_id))"

# evaluation --------------------------------------------------------------------------------------------------------

SAMPLES_SQL = f"""
WITH {PX},
d AS (SELECT a.vec_id, b.vec_id AS k, round(sum((a.v - b.v) * (a.v - b.v)), 9) AS d FROM p a JOIN p b ON a.pos = b.pos AND b.vec_id < 3 GROUP BY ALL),
near AS (SELECT vec_id, k AS cluster FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1),
s AS (SELECT e.vec_id, e.label AS parent_id, CASE WHEN e.vec_id % 2 = 0 THEN 'alg1' ELSE 'alg2' END AS algorithm, e.vec_id = min(e.vec_id) OVER (PARTITION BY e.label) AS is_original, cluster FROM embeddings e JOIN near USING (vec_id)),
g AS (SELECT s.*, CAST(coalesce(s.cluster = o.cluster, FALSE) AS INT) AS matched FROM s LEFT JOIN s o ON o.is_original AND o.parent_id = s.parent_id WHERE NOT s.is_original)
"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images(spark, sf_dir)
    centroids = [r["px"] for r in rows.where("vec_id < 3").orderBy("vec_id").select("px").collect()]  # three rows
    first = rows.groupBy("label").agg(F.min("vec_id").alias("first"))
    near = evaluate.nearest_centroid(rows, centroids).join(F.broadcast(first), "label")  # a row a label
    registry.register(spark)
    rows = near.select(F.concat("label", F.when(F.col("vec_id") == F.col("first"), "_Original").otherwise(F.concat(F.lit("_alg_"), "vec_id"))).alias("sample_id"), F.col("label").alias("parent_id"), F.when(F.col("vec_id") % 2 == 0, "alg1").otherwise("alg2").alias("algorithm"), "cluster", "px")
    return rows.withColumn("is_original", F.expr("is_original(sample_id)"))  # by name


@query(SAMPLES_SQL + "SELECT CASE WHEN grouping(parent_id) = 0 THEN CAST(parent_id AS VARCHAR) ELSE '*' END AS parent_id, CASE WHEN grouping(algorithm) = 0 THEN algorithm ELSE '*' END AS algorithm, count(*) AS total, CAST(sum(matched) AS BIGINT) AS matched, round(sum(matched) / count(*), 5) AS rate FROM g GROUP BY GROUPING SETS ((), (parent_id), (algorithm))")
def parent_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.parent_match(samples(spark, sf_dir)))


def _match_part(spark: SparkSession, sf_dir: str, condition: str, *columns: str) -> DataFrame:
    return rounded(evaluate.parent_match(samples(spark, sf_dir)).where(condition).select(*columns, "total", "matched", "rate"))


@query(SAMPLES_SQL + "SELECT count(*) AS total, CAST(sum(matched) AS BIGINT) AS matched, round(sum(matched) / count(*), 5) AS rate FROM g")
def parent_match_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match_part(spark, sf_dir, "parent_id = '*' AND algorithm = '*'")


@query(SAMPLES_SQL + "SELECT CAST(parent_id AS VARCHAR) AS parent_id, count(*) AS total, CAST(sum(matched) AS BIGINT) AS matched, round(sum(matched) / count(*), 5) AS rate FROM g GROUP BY parent_id")
def parent_match_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match_part(spark, sf_dir, "parent_id <> '*'", "parent_id")


@query(SAMPLES_SQL + "SELECT algorithm, count(*) AS total, CAST(sum(matched) AS BIGINT) AS matched, round(sum(matched) / count(*), 5) AS rate FROM g GROUP BY algorithm")
def parent_match_by_algorithm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match_part(spark, sf_dir, "algorithm <> '*'", "algorithm")


PAIRS = "v AS (SELECT vec_id AS id, label AS cluster, CAST(embedding AS DOUBLE[]) AS px FROM embeddings), d AS (SELECT a.id, a.cluster, b.id AS jd, b.cluster AS other, list_distance(a.px, b.px) AS d FROM v a JOIN v b ON a.id <> b.id)"


@query(f"WITH {PAIRS} SELECT v.cluster, count(DISTINCT v.id) AS n_samples, round(coalesce(avg(d), 0), 5) AS mean_distance FROM v LEFT JOIN d ON d.id = v.id AND d.other = v.cluster GROUP BY v.cluster")
def intra_cluster_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.intra_cluster(vectors(spark, sf_dir)))


@query(f"WITH {PAIRS} SELECT v.cluster, count(DISTINCT v.id) AS n_samples, round(coalesce(avg(d), 0), 5) AS mean_distance, round(coalesce(stddev_pop(d), 0), 5) AS std_distance, round(coalesce(max(d), 0), 5) AS max_distance FROM v LEFT JOIN d ON d.id = v.id AND d.other = v.cluster AND d.id < d.jd GROUP BY v.cluster")
def intra_cluster_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.intra_cluster_pairs(vectors(spark, sf_dir)))


@query(f"WITH {PAIRS} SELECT count(*) AS n_pairs, round(avg(d), 5) AS mean_distance FROM d WHERE other = cluster")
def intra_cluster_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = evaluate.block_pairs(vectors(spark, sf_dir), within=True)
    return rounded(sums.agg(F.sum("n").alias("n_pairs"), (F.sum("total") / F.sum("n")).alias("mean_distance")))


@query(f"WITH {PAIRS}, m AS (SELECT id, avg(d) AS d FROM d WHERE other = cluster GROUP BY id) SELECT CASE WHEN id % 2 = 0 THEN 'alg1' ELSE 'alg2' END AS algorithm, round(avg(d), 5) AS mean_intra_distance, count(*) AS n_samples FROM m GROUP BY 1")
def algorithm_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.compare_algorithms(vectors(spark, sf_dir).withColumn("algorithm", F.when(F.col("id") % 2 == 0, "alg1").otherwise("alg2"))))


@query(f"WITH {PAIRS}, c AS (SELECT id, cluster, other, avg(d) AS m FROM d GROUP BY ALL), s AS (SELECT id, max(m) FILTER (WHERE other = cluster) AS a, min(m) FILTER (WHERE other <> cluster) AS b FROM c GROUP BY id) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 5) AS silhouette, count(*) AS n_points FROM s")
def silhouette_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.silhouette(vectors(spark, sf_dir)))


@query("WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS px FROM embeddings) SELECT a.id AS i, b.id AS j, round(list_distance(a.px, b.px), 5) AS distance FROM v a JOIN v b ON a.id < b.id ORDER BY list_distance(a.px, b.px), i, j LIMIT 20")
def distance_matrix_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report of the matrix of all distances."""
    return rounded(evaluate.nearest_pairs(vectors(spark, sf_dir), 20))


LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 4) + 0.0 AS {c}" for c in LINE) + " FROM lineitem")
def standardize_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.standardized(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LINE), list(LINE)), 4)


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 5) + 0.0 AS corr FROM lineitem" for a in LINE for b in LINE))
def correlation_matrix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.correlation_long(table(spark, sf_dir, "lineitem").select(*LINE), list(LINE)))


ODD = "CASE WHEN event_id % 97 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 89 = 0 THEN 'Infinity'::DOUBLE ELSE value END"


def odd_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    value = F.when(e % 97 == 0, float("nan")).when(e % 89 == 0, float("inf")).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", value.alias("value"), F.lit(1.0).alias("one"), (e % 7).cast("double").alias("week"))


@query(f"WITH e AS (SELECT event_id, {ODD} AS value, 1.0 AS one, CAST(event_id % 7 AS DOUBLE) AS week FROM events) "
       + " UNION ALL ".join(f"SELECT '{c}' AS column, count(DISTINCT CASE WHEN NOT isnan({c}) THEN {c} END) AS n_distinct, coalesce(bool_or(isnan({c})), FALSE) AS has_nan, coalesce(bool_or(isinf({c})), FALSE) AS has_inf, count(DISTINCT CASE WHEN NOT isnan({c}) THEN {c} END) <= 1 AS is_constant FROM e" for c in ("value", "one", "week")))
def constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.column_checks(odd_events(spark, sf_dir), ["value", "one", "week"])


@query(f"WITH e AS (SELECT event_id, {ODD} AS value FROM events) SELECT event_id, round(CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 0 ELSE value END, 5) + 0.0 AS value FROM e")
def nan_inf_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.filled(odd_events(spark, sf_dir).select("event_id", "value"), ["value"]))


@query("SELECT l_orderkey, l_linenumber, greatest(0.02, least(0.06, l_discount)) AS l_discount FROM lineitem")
def clip_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.greatest(F.lit(0.02), F.least(F.lit(0.06), "l_discount")).alias("l_discount"))


# pixels ------------------------------------------------------------------------------------------------------------


def _flat(rows: DataFrame, array: str = "px") -> DataFrame:
    return rows.select("vec_id", F.posexplode(array).alias("pos", "v"))


STRETCH = "CASE WHEN hi > lo THEN greatest(0.0, least(1.0, (v - lo) / (hi - lo))) ELSE 0.0 END"
BOUNDS = "b AS (SELECT vec_id, CASE WHEN quantile_cont(v, 0.98) > quantile_cont(v, 0.02) THEN quantile_cont(v, 0.02) ELSE min(v) END AS lo, CASE WHEN quantile_cont(v, 0.98) > quantile_cont(v, 0.02) THEN quantile_cont(v, 0.98) ELSE max(v) END AS hi FROM p GROUP BY vec_id)"


@query(f"WITH {PX}, {BOUNDS} SELECT vec_id, pos, round({STRETCH}, 5) + 0.0 AS v FROM p JOIN b USING (vec_id)")
def norm_percentile_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_flat(images(spark, sf_dir).select("vec_id", pixels.percentile_stretch(F.col("px")).alias("px"))))


@query(f"WITH {PX} SELECT vec_id, pos, round(CASE WHEN m > 1 THEN least(1.0, v / m) ELSE v END, 5) + 0.0 AS v FROM p JOIN (SELECT vec_id, max(v) AS m FROM p GROUP BY vec_id) USING (vec_id)")
def normalize_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_flat(images(spark, sf_dir).select("vec_id", pixels.normalize_to_float(F.col("px"), F.lit(False)).alias("px"))))


CELLS = f"{PX}, {BOUNDS}, q AS (SELECT vec_id // 4 AS cell_id, vec_id % 4 AS ch, r, c, CAST(floor({STRETCH} * 255) AS INT) AS v FROM p JOIN b USING (vec_id)), rgb AS (SELECT cell_id, r, c, max(v) FILTER (WHERE ch = 2) AS red, max(v) FILTER (WHERE ch = 1) AS green, max(v) FILTER (WHERE ch = 3) AS blue FROM q GROUP BY ALL HAVING count(*) = 4)"


@query(f"WITH {CELLS} SELECT cell_id, r, c, red, green, blue FROM rgb")
def rgb_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.rgb_composite(pixels.channels(images(spark, sf_dir)))


@query(f"WITH {CELLS} SELECT cell_id, round(avg(0.299 * red + 0.587 * green + 0.114 * blue), 9) AS luminance FROM rgb GROUP BY cell_id")
def luminance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = pixels.rgb_composite(pixels.channels(images(spark, sf_dir)))
    return rounded(rgb.groupBy("cell_id").agg(F.avg(pixels.luminance(F.col("red"), F.col("green"), F.col("blue"))).alias("luminance")), 9)


@query(f"WITH {MASK}, b AS (SELECT vec_id, median(v) FILTER (WHERE NOT m) AS b FROM m GROUP BY vec_id), x AS (SELECT m.*, greatest(0.0, v - b) AS x FROM m JOIN b USING (vec_id)), t9 AS (SELECT vec_id, quantile_cont(x, 0.99) FILTER (WHERE m) AS t FROM x GROUP BY vec_id) SELECT vec_id, round(avg(CASE WHEN t9.t > 0 THEN least(1.0, x / t9.t) ELSE least(1.0, x) END) FILTER (WHERE m), 5) AS mean_intensity FROM x JOIN t9 USING (vec_id) GROUP BY vec_id")
def background_normalize_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = masked(spark, sf_dir).withColumn("n", pixels.background_normalized(F.col("px"), F.col("m")))
    flat = rows.select("vec_id", F.explode(F.arrays_zip("n", "m")).alias("x"))
    return rounded(flat.groupBy("vec_id").agg(F.avg(F.when(F.col("x.m"), F.col("x.n"))).alias("mean_intensity")))


OTSU = f"""WITH {PX}, l AS (SELECT vec_id, min(v) AS lo, max(v) AS hi FROM p GROUP BY vec_id),
h AS (SELECT vec_id, lo, hi, CASE WHEN hi > lo THEN least(15, CAST(floor((v - lo) / ((hi - lo) / 16)) AS INT)) ELSE 0 END AS b, count(*) AS n FROM p JOIN l USING (vec_id) GROUP BY ALL),
m AS (SELECT *, lo + (b + 0.5) * ((hi - lo) / 16) AS mid FROM h),
w AS (SELECT *, sum(n) OVER c AS n1, sum(n * mid) OVER c AS s1, sum(n) OVER a AS nn, sum(n * mid) OVER a AS ss FROM m WINDOW c AS (PARTITION BY vec_id ORDER BY b), a AS (PARTITION BY vec_id)),
x AS (SELECT *, round(coalesce(n1 * (nn - n1) * (s1 / n1 - (ss - s1) / nullif(nn - n1, 0)) * (s1 / n1 - (ss - s1) / nullif(nn - n1, 0)), 0), 9) AS between_ FROM w)
SELECT vec_id, round(CASE WHEN hi > lo THEN mid ELSE lo END, 5) + 0.0 AS threshold FROM x QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY between_ DESC, b) = 1"""


@query(OTSU)
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pixels.otsu(images(spark, sf_dir)))


STEPS = "o AS (SELECT dr, dc FROM (VALUES (-1), (0), (1)) x(dr), (VALUES (-1), (0), (1)) y(dc))"
NEAR = "b.vec_id = a.vec_id AND b.r = greatest(0, least(7, a.r + dr)) AND b.c = greatest(0, least(7, a.c + dc))"  # one step, reflected at the edge
SOBEL = f"{PX}, {STEPS}, g AS (SELECT a.vec_id, a.r, a.c, sum(dr * CASE WHEN dc = 0 THEN 2 ELSE 1 END * b.v) / 8 AS gx, sum(dc * CASE WHEN dr = 0 THEN 2 ELSE 1 END * b.v) / 8 AS gy FROM p a CROSS JOIN o JOIN p b ON {NEAR} GROUP BY ALL)"


def grads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.gradients(pixels.pixel_table(images(spark, sf_dir).select("vec_id", "px")))


@query(f"WITH {SOBEL} SELECT vec_id, r, c, round(gx, 5) + 0.0 AS gx, round(gy, 5) + 0.0 AS gy FROM g")
def sobel_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grads(spark, sf_dir).select("vec_id", "r", "c", "gx", "gy"))


@query(f"WITH {SOBEL}, e AS (SELECT vec_id, round(sqrt((gx * gx + gy * gy) / 2), 9) AS e FROM g), t AS (SELECT vec_id, quantile_cont(e, 0.9) AS t FROM e GROUP BY vec_id) SELECT vec_id, round(avg(CASE WHEN e > t THEN 1.0 ELSE 0.0 END), 5) AS edge_density FROM e JOIN t USING (vec_id) GROUP BY vec_id")
def edge_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pixels.edge_density(grads(spark, sf_dir)))


ANGLES = SOBEL + ", a AS (SELECT vec_id, CASE WHEN sqrt(gx * gx + gy * gy) > 0.1 THEN atan2(gy, gx) END AS t FROM g)"


@query(f"WITH {ANGLES} SELECT vec_id, round(coalesce(sqrt(avg(cos(2 * t)) ** 2 + avg(sin(2 * t)) ** 2), 0), 5) + 0.0 AS order_parameter FROM a GROUP BY vec_id")
def orientation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pixels.orientation(grads(spark, sf_dir)).select("vec_id", "order_parameter"))


@query(f"WITH {ANGLES} SELECT vec_id, round(coalesce(sqrt(avg(cos(t)) ** 2 + avg(sin(t)) ** 2), 0), 5) + 0.0 AS alignment_index, round(coalesce(atan2(avg(sin(t)), avg(cos(t))), 0), 5) + 0.0 AS orientation_mean, round(coalesce(stddev_pop(t), 0), 5) + 0.0 AS orientation_std FROM a GROUP BY vec_id")
def alignment_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pixels.orientation(grads(spark, sf_dir)).drop("order_parameter"))


GLCM = f"""WITH {PX}, l AS (SELECT vec_id, min(v) AS lo, max(v) AS hi FROM p GROUP BY vec_id),
q AS (SELECT vec_id, r, c, CASE WHEN hi > lo THEN least(7, CAST(floor((v - lo) / (hi - lo) * 8) AS INT)) ELSE 0 END AS g FROM p JOIN l USING (vec_id)),
o AS (SELECT * FROM (VALUES (0, 0, 1), (1, -1, 1), (2, -1, 0), (3, -1, -1)) t(angle, dr, dc)),
n AS (SELECT x.vec_id, angle, x.g AS a, y.g AS b FROM q x JOIN o ON TRUE JOIN q y ON y.vec_id = x.vec_id AND y.r = x.r + dr AND y.c = x.c + dc),
s AS (SELECT * FROM n UNION ALL SELECT vec_id, angle, b, a FROM n),
k AS (SELECT vec_id, angle, a, b, count(*) AS n FROM s GROUP BY ALL),
f AS (SELECT vec_id, angle, a, b, n / sum(n) OVER (PARTITION BY vec_id, angle) AS p FROM k),
z AS (SELECT vec_id, angle, sum(p * (a - b) * (a - b)) AS contrast, sum(p / (1 + (a - b) * (a - b))) AS homogeneity, sqrt(sum(p * p)) AS energy, sum(p * a) AS ma, sum(p * a * a) AS qa, sum(p * a * b) AS ab, sum(-p * ln(p + 1e-10)) AS entropy FROM f GROUP BY ALL)
SELECT vec_id, round(avg(contrast), 5) AS glcm_contrast, round(avg(homogeneity), 5) AS glcm_homogeneity, round(avg(energy), 5) AS glcm_energy, round(avg(CASE WHEN qa - ma * ma < 1e-15 THEN 1.0 ELSE (ab - ma * ma) / (qa - ma * ma) END), 5) + 0.0 AS glcm_correlation, round(sum(entropy), 5) AS glcm_entropy FROM z GROUP BY vec_id"""


@query(GLCM)
def glcm_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pixels.glcm(images(spark, sf_dir)))


@query(f"WITH {PX}, a AS (SELECT vec_id, avg(v) AS mu, var_pop(v) AS s2 FROM p GROUP BY vec_id) SELECT vec_id, round(1 / (1 + s2), 5) AS glcm_smoothness, round(CASE WHEN s2 > 0 THEN avg((v - mu) ** 3) / s2 ** 1.5 ELSE 0 END, 5) + 0.0 AS glcm_skewness FROM p JOIN a USING (vec_id) GROUP BY vec_id, s2")
def intensity_skew_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pixels.smoothness_skewness(pixels.pixel_table(images(spark, sf_dir).select("vec_id", "px"))))


@query(f"WITH {MASK}, s AS (SELECT vec_id, quantile_cont(v, 0.9) FILTER (WHERE m) AS s FROM m GROUP BY vec_id) SELECT vec_id, count(*) FILTER (WHERE m AND v > s) AS bright_spot_area FROM m JOIN s USING (vec_id) GROUP BY vec_id")
def bright_spot_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = masked(spark, sf_dir).withColumn("within", F.filter("px", lambda v, k: F.get("m", k)))
    level = pixels.array_percentile(F.col("within"), 0.9)
    return rows.select("vec_id", F.element_at(F.transform(F.array(level), lambda t: F.size(F.filter("within", lambda v: v > t)).cast("long")), 1).alias("bright_spot_area"))


@query(f"WITH {PX}, q AS (SELECT vec_id, quantile_cont(v, [0.02, 0.05, 0.25, 0.5, 0.9, 0.99]) AS q FROM p GROUP BY vec_id) SELECT vec_id, round(q[1], 5) + 0.0 AS p2, round(q[2], 5) + 0.0 AS p5, round(q[3], 5) + 0.0 AS p25, round(q[4], 5) + 0.0 AS p50, round(q[5], 5) + 0.0 AS p90, round(q[6], 5) + 0.0 AS p99 FROM q")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(images(spark, sf_dir).select("vec_id", *[pixels.array_percentile(F.col("px"), p / 100).alias(f"p{p}") for p in (2, 5, 25, 50, 90, 99)]))


# masks and components -----------------------------------------------------------------------------------------------

CC = f"""WITH RECURSIVE {MASK}, o AS (SELECT vec_id, pos, r, c FROM m WHERE m),
x AS (SELECT vec_id, pos, r, c, pos AS root FROM o UNION SELECT o.vec_id, o.pos, o.r, o.c, x.root FROM x JOIN o ON o.vec_id = x.vec_id AND abs(o.r - x.r) <= 1 AND abs(o.c - x.c) <= 1),
k AS (SELECT vec_id, pos, r, c, min(root) AS root FROM x GROUP BY ALL),
t2 AS (SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY root) AS INT) AS label, count(*) AS area, min(r) AS r0, min(c) AS c0, max(r) + 1 AS r1, max(c) + 1 AS c1, round(avg(r), 5) AS cy, round(avg(c), 5) AS cx FROM k GROUP BY vec_id, root)
"""
PROPS = ("vec_id", "label", "area", "r0", "c0", "r1", "c1", "cy", "cx")


@query(CC + "SELECT * FROM t2")
def component_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(components.component_table(masked(spark, sf_dir)).select(*PROPS))


@query(CC + "SELECT * FROM t2 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY area DESC, label) = 1")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(components.largest(components.component_table(masked(spark, sf_dir)).select(*PROPS)))


@query(CC + "SELECT vec_id, count(*) AS n_components, CAST(sum(area) AS BIGINT) AS area FROM t2 WHERE area >= 3 GROUP BY vec_id")
def remove_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = components.of_area(components.component_table(masked(spark, sf_dir)), 3)
    return kept.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n_components"), F.sum("area").alias("area"))


@query(CC + "SELECT vec_id, CAST(sum(area) AS BIGINT) AS area, round(sum(cy * area) / sum(area), 3) AS cy, round(sum(cx * area) / sum(area), 3) AS cx, min(r0) AS r0, min(c0) AS c0, max(r1) AS r1, max(c1) AS c1 FROM t2 GROUP BY vec_id")
def union_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(components.union_props(components.component_table(masked(spark, sf_dir))), 3)


CROSS = "abs(a.r - b.r) + abs(a.c - b.c) <= 1"
DILATE = f"WITH {MASK}, x AS (SELECT a.vec_id, a.pos, a.r, a.c, bool_or(b.m) AS m FROM m a JOIN m b ON a.vec_id = b.vec_id AND {CROSS} GROUP BY ALL)"
ERODE = f"WITH {MASK}, x AS (SELECT a.vec_id, a.pos, a.r, a.c, bool_and(b.m) AS m FROM m a JOIN m b ON a.vec_id = b.vec_id AND {CROSS} GROUP BY ALL)"
AREA = " SELECT vec_id, count(*) FILTER (WHERE m) AS area, CAST(sum(CASE WHEN m THEN pos ELSE 0 END) AS BIGINT) AS places FROM "


def _morphology(spark: SparkSession, sf_dir: str, *steps: Callable[[Column], Column]) -> DataFrame:
    rows = masked(spark, sf_dir)
    for step in steps:
        rows = rows.withColumn("m", step(F.col("m")))
    places = F.aggregate(F.transform("m", lambda m, k: F.when(m, k).otherwise(0).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("vec_id", pixels.area(F.col("m")).alias("area"), places.alias("places"))


@query(DILATE + AREA + "x GROUP BY vec_id")
def morphology_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _morphology(spark, sf_dir, pixels.dilate)


@query(ERODE + AREA + "x GROUP BY vec_id")
def morphology_erode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _morphology(spark, sf_dir, pixels.erode)


@query(ERODE + f", y AS (SELECT a.vec_id, a.pos, bool_or(b.m) AS m FROM x a JOIN x b ON a.vec_id = b.vec_id AND {CROSS} GROUP BY ALL)" + AREA + "y GROUP BY vec_id")
def morphology_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _morphology(spark, sf_dir, pixels.erode, pixels.dilate)


@query(DILATE + f", y AS (SELECT a.vec_id, a.pos, bool_and(b.m) AS m FROM x a JOIN x b ON a.vec_id = b.vec_id AND {CROSS} GROUP BY ALL)" + AREA + "y GROUP BY vec_id")
def morphology_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _morphology(spark, sf_dir, pixels.dilate, pixels.erode)


CYTO = f"WITH {PX}, t AS (SELECT vec_id, quantile_cont(v, 0.3) AS t1, quantile_cont(v, 0.7) AS t2 FROM p GROUP BY vec_id), m AS (SELECT p.*, v > t1 AS cell, v > t2 AS nuc FROM p JOIN t USING (vec_id)), x AS (SELECT a.vec_id, a.pos, a.cell, a.nuc, bool_and(b.nuc) AS e FROM m a JOIN m b ON a.vec_id = b.vec_id AND {CROSS} GROUP BY ALL)"


def _two_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def above(p: float) -> Column:
        return F.element_at(F.transform(F.array(pixels.array_percentile(F.col("px"), p)), lambda t: F.transform("px", lambda v: v > t)), 1)

    return images(spark, sf_dir).withColumns({"cell": above(0.3), "nuc": above(0.7)})


@query(CYTO + " SELECT vec_id, count(*) FILTER (WHERE cell AND NOT e) AS cytoplasm_area FROM x GROUP BY vec_id")
def cytoplasm_mask_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _two_masks(spark, sf_dir).withColumn("e", pixels.erode(F.col("nuc")))
    return rows.select("vec_id", pixels.area(F.zip_with("cell", "e", lambda a, b: a & ~b)).alias("cytoplasm_area"))


@query(CYTO + ", a AS (SELECT vec_id, count(*) FILTER (WHERE cell) AS c, count(*) FILTER (WHERE nuc AND cell) AS n FROM x GROUP BY vec_id) SELECT vec_id, c AS cell_area, n AS nuclear_area, round(CASE WHEN c - n <= 1e-6 THEN 0 ELSE n / (c - n) END, 5) AS nc_ratio FROM a")
def nc_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _two_masks(spark, sf_dir).select("vec_id", pixels.area(F.col("cell")).alias("cell_area"), pixels.area(F.zip_with("cell", "nuc", lambda a, b: a & b)).alias("nuclear_area"))
    registry.register(spark)
    return rounded(rows.withColumn("nc_ratio", F.expr("nc_ratio(cell_area, nuclear_area)")))


@query(f"WITH {MASK} SELECT vec_id, coalesce(min(c) FILTER (WHERE m), 0) AS x0, coalesce(min(r) FILTER (WHERE m), 0) AS y0, coalesce(max(c) FILTER (WHERE m), 0) AS x1, coalesce(max(r) FILTER (WHERE m), 0) AS y1 FROM m GROUP BY vec_id")
def mask_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked(spark, sf_dir).select("vec_id", pixels.mask_box(F.col("m")).alias("b")).select("vec_id", "b.*")


@query(f"WITH {PX} SELECT vec_id, round(count(*) FILTER (WHERE v > 0.1) / nullif(count(*) FILTER (WHERE v > -0.1), 0), 5) AS stability FROM p GROUP BY vec_id")
def stability_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(images(spark, sf_dir).select("vec_id", pixels.stability_score(F.col("px"), F.lit(0.0), 0.1).alias("stability")))


RLE = f"""WITH {MASK}, o AS (SELECT vec_id, c * 8 + r AS q, m FROM m UNION ALL SELECT DISTINCT vec_id, -1, FALSE FROM m),
f AS (SELECT vec_id, q, m, CASE WHEN m <> lag(m, 1, FALSE) OVER (PARTITION BY vec_id ORDER BY q) THEN 1 ELSE 0 END AS f FROM o),
g AS (SELECT vec_id, q, sum(f) OVER (PARTITION BY vec_id ORDER BY q) AS g FROM f),
u AS (SELECT vec_id, g, count(*) - CASE WHEN g = 0 THEN 1 ELSE 0 END AS n FROM g GROUP BY vec_id, g)
"""


@query(RLE + "SELECT vec_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY g) AS counts FROM u GROUP BY vec_id")
def rle_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked(spark, sf_dir).select("vec_id", F.array_join(pixels.rle(F.col("m")), ",").alias("counts"))


@query(RLE + "SELECT vec_id, CAST(coalesce(sum(n) FILTER (WHERE g % 2 = 1), 0) AS BIGINT) AS area FROM u GROUP BY vec_id")
def rle_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked(spark, sf_dir).select("vec_id", pixels.rle_area(pixels.rle(F.col("m"))).alias("area"))


@query("SELECT CAST(i AS INT) AS k, (i % 16 + 0.5) / 16 AS x, (i // 16 + 0.5) / 16 AS y FROM range(256) t(i)")
def point_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maskops.point_grid(spark, 16)


@query("""WITH l AS (SELECT CAST(layer AS INT) AS layer, CAST(2 ** layer AS INT) AS n FROM range(3) t(layer)),
o AS (SELECT layer, n, CASE WHEN layer = 0 THEN 0 ELSE floor(0.34 * 240 * 2 / n) END AS ov FROM l),
b AS (SELECT *, ceil((ov * (n - 1) + 320) / n) AS bw, ceil((ov * (n - 1) + 240) / n) AS bh FROM o)
SELECT layer, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST((bw - ov) * i AS INT) AS x0, CAST((bh - ov) * j AS INT) AS y0, CAST(least((bw - ov) * i + bw, 320) AS INT) AS x1, CAST(least((bh - ov) * j + bh, 240) AS INT) AS y1
FROM b, range(4) t(i), range(4) s(j) WHERE i < n AND j < n""")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maskops.crop_boxes(spark, 240, 320, 2, 0.34)


# quality control, manifests, sampling -----------------------------------------------------------------------------------


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as if they were images: length stands for area."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")


REASONS = "concat_ws('; ', CASE WHEN n_chars < {lo} THEN 'too small' WHEN n_chars > {hi} THEN 'too large' END, CASE WHEN quality = 0 THEN 'low quality' END, CASE WHEN toxic = 1 THEN 'toxic' END)"


def _reasons(lo: int, hi: int) -> Column:
    return F.array_compact(F.array(F.when(F.col("n_chars") < lo, "too small").when(F.col("n_chars") > hi, "too large"), F.when(F.col("quality") == 0, "low quality"), F.when(F.col("toxic") == 1, "toxic")))


@query(f"SELECT doc_id, {REASONS.format(lo=500, hi=5000)} = '' AS passes, {REASONS.format(lo=500, hi=5000)} AS reasons FROM documents JOIN labels USING (doc_id)")
def score_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(spark, sf_dir).select("doc_id", (F.size(_reasons(500, 5000)) == 0).alias("passes"), F.array_join(_reasons(500, 5000), "; ").alias("reasons"))


@query(f"WITH s AS (SELECT doc_id, n_chars, {REASONS.format(lo=500, hi=5000)} AS a, {REASONS.format(lo=100, hi=20000)} AS b FROM documents JOIN labels USING (doc_id)), n AS (SELECT count(*) FILTER (WHERE a = '') >= 1000000 AS strict FROM s) SELECT doc_id, CASE WHEN strict THEN a = '' ELSE b = '' END AS passes, n_chars, CASE WHEN strict THEN CASE WHEN a = '' THEN 'PASS' ELSE a END WHEN b = '' THEN 'PASS (relaxed)' ELSE b END AS reasons FROM s, n")
def qc_relax_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _reasons(500, 5000), _reasons(100, 20000)
    return imaging.relax_once(graded(spark, sf_dir).select("doc_id", "n_chars", (F.size(a) == 0).alias("strict_passes"), (F.size(b) == 0).alias("relaxed_passes"), a.alias("strict_reasons"), b.alias("relaxed_reasons")), 1000000)


@query("SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1) AS kept, count(*) FILTER (WHERE quality <> 1) AS rejected FROM documents JOIN labels USING (doc_id)")
def qc_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.totals(graded(spark, sf_dir).select((F.col("quality") == 1).alias("passes")))


@query("SELECT d.doc_id, d.source FROM documents d JOIN (SELECT 'color_' || doc_id || '.png' AS filename FROM labels WHERE quality = 1) q ON CAST(regexp_extract(q.filename, '^color_(.*)\\.png$', 1) AS BIGINT) = d.doc_id")
def qc_manifest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest rows whose composite passed."""
    qc = table(spark, sf_dir, "labels").select(F.concat(F.lit("color_"), "doc_id", F.lit(".png")).alias("filename"), (F.col("quality") == 1).alias("passes"))
    passed = qc.where("passes").select(F.regexp_extract("filename", r"^color_(.*)\.png$", 1).cast("long").alias("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(passed, "doc_id", "left_semi")


MANIFEST = "WITH o AS (SELECT n_name AS parent_id FROM nation), s AS (SELECT parent_id || '_original' AS sample_id, parent_id, 'original' AS algorithm, 'originals' AS part FROM o UNION ALL SELECT parent_id || '_' || a || '_' || lpad(CAST(k AS VARCHAR), 3, '0'), parent_id, a, a FROM o, (VALUES ('alg1'), ('alg2')) t(a), range(1, 11) r(k)) SELECT sample_id, parent_id, algorithm, "


@query(MANIFEST + ", ".join(f"'out/' || part || '/' || sample_id || '_{c}.png' AS path_{c}" for c in ("phase", "actin", "mt", "nuc")) + " FROM s")
def dry_run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.manifest(table(spark, sf_dir, "nation").select(F.col("n_name").alias("cell_id")), 10, "out")


@query(MANIFEST.replace("SELECT sample_id, parent_id, algorithm, ", "SELECT algorithm, count(*) AS n FROM s GROUP BY algorithm"))
def count_by_algorithm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21, F10."""
    rows = generate.manifest(table(spark, sf_dir, "nation").select(F.col("n_name").alias("cell_id")), 10, "out")
    return rows.groupBy("algorithm").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, source FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id LIMIT 21")
def deterministic_sample_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: a sampling operator."""
    return generate.sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 21, 42)


@query("WITH b AS (SELECT CAST(t AS INT) AS t, 0.0001 + t * ((0.02 - 0.0001) / 999) AS beta FROM range(1000) r(t)) SELECT t, round(beta, 8) AS beta, round(1 - beta, 8) AS alpha, round(exp(sum(ln(1 - beta)) OVER (ORDER BY t)), 8) AS alpha_bar FROM b")
def beta_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(generate.beta_schedule(spark), 8)


@query(f"WITH {PX}, a AS (SELECT exp(sum(ln(1 - (0.0001 + t * ((0.02 - 0.0001) / 999))))) AS ab FROM range(101) r(t)) SELECT vec_id, pos, round(sqrt(ab) * v + sqrt(1 - ab) * (pos / 64.0 - 0.5), 5) + 0.0 AS v FROM p, a")
def forward_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N2 at step 100, with a fixed field in the place of noise."""
    step = generate.beta_schedule(spark).where("t = 100").select("alpha_bar")
    rows = _flat(images(spark, sf_dir)).join(F.broadcast(step))  # one row
    return rounded(rows.select("vec_id", "pos", generate.forward_noise(F.col("v"), F.col("alpha_bar"), F.col("pos") / 64.0 - 0.5).alias("v")))


SIZES = "f AS (SELECT p_brand AS cell_id, CASE p_partkey % 4 WHEN 0 THEN 'actin' WHEN 1 THEN 'mt' WHEN 2 THEN 'nuc' ELSE 'phase' END AS channel, CAST(min(p_size) % 3 AS INT) AS h, CAST(max(p_size) % 2 AS INT) AS w FROM part GROUP BY ALL)"


@query(f"WITH {SIZES}, n AS (SELECT cell_id, h, w, count(*) AS n, min(CASE channel WHEN 'actin' THEN 1 WHEN 'mt' THEN 2 WHEN 'nuc' THEN 3 ELSE 4 END) AS f FROM f GROUP BY ALL) SELECT cell_id, h, w FROM n QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY n DESC, f) = 1")
def mode_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3, W3 over parts: brands are cells, sizes shapes."""
    k = F.col("p_partkey") % 4
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("cell_id"), F.when(k == 0, "actin").when(k == 1, "mt").when(k == 2, "nuc").otherwise("phase").alias("channel")).agg((F.min("p_size") % 3).cast("int").alias("h"), (F.max("p_size") % 2).cast("int").alias("w"))
    return sources.mode_size(rows)


@query("SELECT l_orderkey AS cell_id, count(DISTINCT l_linenumber) = 4 AND bool_and(l_quantity BETWEEN 5 AND 45 AND l_linenumber * 5 BETWEEN 5 AND 45) AND count(DISTINCT (l_quantity, l_linenumber * 5)) = 1 AS ok FROM lineitem GROUP BY l_orderkey UNION ALL SELECT -1 - p_partkey, p_size BETWEEN 5 AND 45 FROM part")
def verify_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines as channels of an order, and parts as cells of four channels of one shape."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell_id"), F.col("l_linenumber").cast("string").alias("channel"), F.col("l_quantity").alias("h"), (F.col("l_linenumber") * 5.0).alias("w"))
    parts = table(spark, sf_dir, "part").select((-1 - F.col("p_partkey")).alias("cell_id"), F.explode(F.array(*map(F.lit, ("phase", "actin", "mt", "nuc")))).alias("channel"), F.col("p_size").cast("double").alias("h"), F.lit(45.0).alias("w"))
    return sources.verify_cells(lines.unionByName(parts), 4, 5, 45)


# models: rows only ------------------------------------------------------------------------------------------------------


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 on the 64 values of each vector; a vector stays in its row."""
    rows = images(spark, sf_dir).where(F.size("px") > 0)
    stats = _flat(rows).groupBy("pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    stats = stats.agg(F.sort_array(F.collect_list(F.struct("pos", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s")))).alias("stats"))
    z = F.transform("px", lambda v, k: (v - F.get("stats", k)["m"]) / F.get("stats", k)["s"])
    return rows.join(F.broadcast(stats)).select(F.col("vec_id").alias("id"), z.alias("px"))  # one row of 64


@query()
def kmeans_inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, inertia = clustering.kmeans(scaled(spark, sf_dir))
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).withColumn("inertia", F.lit(round(inertia, 3)))


@query()
def pca_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, share = clustering.pca(scaled(spark, sf_dir))
    return out.select("id", *[F.round(F.get("pc", k), 5).alias(f"pc{k + 1}") for k in (0, 1)], *[F.lit(round(s, 6)).alias(f"share{k + 1}") for k, s in enumerate(share)])


# more of the inventory ---------------------------------------------------------------------------------------------------

GRID = (64, 64)


def cell_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rasters in a row as a cell of four 64 by 64 channels."""
    return imaging.enlarged(pixels.channels(images(spark, sf_dir)), "cell_id", GRID)


def cell_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_images(spark, sf_dir).select("*", F.lit("cell").alias("parent_id"), F.lit("original").alias("algorithm"))


@query()
def cell_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17 with M4, M5, M9."""
    return rounded(imaging.features(cell_samples(spark, sf_dir)).drop("error"))


@query()
def validated_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5."""
    return rounded(imaging.validated(imaging.features(cell_samples(spark, sf_dir)).where("error IS NULL").drop("error")))


@query()
def color_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1 to Q4 on composites."""
    rows = imaging.composites(cell_images(spark, sf_dir)).select(F.concat(F.lit("color_"), "sample_id", F.lit(".png")).alias("filename"), "image")
    return rounded(imaging.quality(rows))


def _variants(spark: SparkSession, sf_dir: str, algorithm: str) -> DataFrame:
    from ..config import Config

    cells = imaging.enlarged(pixels.channels(images(spark, sf_dir), whole=False), "cell_id", GRID).withColumnRenamed("sample_id", "cell_id")
    made = generate.variants(cells, algorithm, Config(size=GRID, displacement=5))
    return made.select("sample_id", "parent_id", "algorithm", F.crc32(F.concat(*[F.coalesce(f"{c}.data", F.lit(b"")) for c in CHANNELS])).alias("crc"), "error")


@query()
def variants_classical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 to G7."""
    return _variants(spark, sf_dir, "alg1")


@query()
def variants_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8 to G10."""
    return _variants(spark, sf_dir, "alg2")


@query()
def automatic_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X9 with the intensity predictor, eight by eight points."""
    rows = cell_images(spark, sf_dir).select(F.col("sample_id").alias("image_id"), F.col("actin").alias("image"))
    found = maskops.automatic_masks(rows, points_per_side=8, stability_least=0.5, iou_least=0.85)
    return found.select("image_id", "area", F.round("predicted_iou", 5).alias("predicted_iou"), F.round("stability_score", 5).alias("stability_score"), F.array_join("bbox", ",").alias("bbox"))


@query("SELECT CAST(t AS INT) AS t, round(sin(t), 6) + 0.0 AS s0, round(sin(t * exp(-ln(10000.0))), 6) + 0.0 AS s1, round(cos(t), 6) + 0.0 AS c0, round(cos(t * exp(-ln(10000.0))), 6) + 0.0 AS c1 FROM range(100) r(t)")
def timestep_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(100).select(F.col("id").cast("int").alias("t"), generate.timestep_embedding(F.col("id").cast("double"), 4).alias("e"))
    return rounded(rows.select("t", *[F.get("e", k).alias(n) for k, n in enumerate(("s0", "s1", "c0", "c1"))]), 6)


@query(CC + ", q AS (SELECT vec_id, quantile_cont(v, 0.85) AS q FROM p GROUP BY vec_id), w AS (SELECT k.vec_id, k.root, count(*) FILTER (WHERE m.v > q.q) AS overlap FROM k JOIN m ON m.vec_id = k.vec_id AND m.pos = k.pos JOIN q ON q.vec_id = k.vec_id GROUP BY ALL), z AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY root) AS INT) AS label FROM w) SELECT vec_id, label, overlap FROM z QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY overlap DESC, label) = 1")
def overlap_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    rough = F.element_at(F.transform(F.array(pixels.array_percentile(F.col("px"), 0.85)), lambda t: F.transform("px", lambda v: v > t)), 1)
    return components.overlapping(masked(spark, sf_dir).withColumn("rough", rough), "rough")


@query(f"WITH RECURSIVE {MASK}, x AS (SELECT vec_id, pos, r, c FROM m WHERE NOT m AND (r IN (0, 7) OR c IN (0, 7)) UNION SELECT b.vec_id, b.pos, b.r, b.c FROM x a JOIN m b ON a.vec_id = b.vec_id AND NOT b.m AND {CROSS}) SELECT vec_id, 64 - count(x.pos) AS area FROM m LEFT JOIN x USING (vec_id, pos) GROUP BY vec_id")
def fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.filled(masked(spark, sf_dir)).select("vec_id", pixels.area(F.col("m")).alias("area"))


@query(f"WITH {PX}, {STEPS} SELECT a.vec_id, a.r, a.c, round(median(b.v), 5) + 0.0 AS v FROM p a CROSS JOIN o JOIN p b ON {NEAR} WHERE abs(dr) + abs(dc) <= 1 GROUP BY ALL")
def median_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pixels.median_cross(pixels.pixel_table(images(spark, sf_dir).select("vec_id", "px"))))


@query(f"WITH {MASK}, b AS (SELECT vec_id, count(*) FILTER (WHERE m AND r = 0) > 3.2 AS top, count(*) FILTER (WHERE m AND r = 7) > 3.2 AS bottom FROM m GROUP BY vec_id) SELECT vec_id, count(*) FILTER (WHERE m AND NOT (top AND r = 0) AND NOT (bottom AND r = 7)) AS area FROM m JOIN b USING (vec_id) GROUP BY vec_id")
def band_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked(spark, sf_dir).select("vec_id", pixels.area(pixels.bands_cleared(F.col("m"))).alias("area"))


@query(f"WITH {PX} SELECT vec_id, r, c, round(v, 5) + 0.0 AS v FROM p WHERE r BETWEEN 2 AND 5 AND c BETWEEN 1 AND 6")
def crop_uncrop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pixels.cropped(pixels.pixel_table(images(spark, sf_dir).select("vec_id", "px")), 2, 1, 6, 7)
    return rounded(pixels.uncropped(rows, 2, 1))


BOXES = f"{MASK}, b AS (SELECT vec_id, coalesce(min(c) FILTER (WHERE m), 0) AS x0, coalesce(min(r) FILTER (WHERE m), 0) AS y0, coalesce(max(c) FILTER (WHERE m), 0) AS x1, coalesce(max(r) FILTER (WHERE m), 0) AS y1 FROM m GROUP BY vec_id)"


@query(f"WITH {BOXES} SELECT vec_id, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h FROM b")
def boxes_xywh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked(spark, sf_dir).select("vec_id", pixels.box_xywh(pixels.mask_box(F.col("m"))).alias("b")).select("vec_id", "b.*")


@query(f"WITH {BOXES} SELECT vec_id, (abs(x0 + 8 - 8) <= 0 AND NOT abs(x0 + 8 - 0) <= 0) OR (abs(y0 - 0) <= 0 AND NOT abs(y0 - 0) <= 0) OR (abs(x1 + 8 - 15) <= 0 AND NOT abs(x1 + 8 - 31) <= 0) OR (abs(y1 - 7) <= 0 AND NOT abs(y1 - 7) <= 0) AS cut_off FROM b")
def crop_edge_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each raster as the second crop of an image of 32 by 8."""
    return masked(spark, sf_dir).select("vec_id", maskops.near_crop_edge(pixels.mask_box(F.col("m")), [8, 0, 15, 7], [0, 0, 31, 7], 0).alias("cut_off"))


@query(f"WITH {BOXES} SELECT a.vec_id AS i, c.vec_id AS j, round(coalesce(greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) / nullif((a.x1 - a.x0) * (a.y1 - a.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) - greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)), 0), 0), 5) AS iou FROM b a JOIN b c ON c.vec_id = a.vec_id + 1")
def box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU of the boxes of neighbouring rasters."""
    rows = masked(spark, sf_dir).select("vec_id", pixels.mask_box(F.col("m")).alias("b"))
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("j"), F.col("b").alias("o"))
    return rounded(rows.join(other, "vec_id").select(F.col("vec_id").alias("i"), "j", maskops.iou(F.col("b"), F.col("o")).alias("iou")))


@query("SELECT n_regionkey AS region, (SELECT list_sort(list(n_name)) FROM nation n WHERE n.n_regionkey = 1) = list_sort(list(DISTINCT n_name)) AS same FROM nation GROUP BY 1")
def expected_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each region's nations as found cells, those of region 1 expected."""
    nations = table(spark, sf_dir, "nation")
    wanted = [r[0] for r in nations.where("n_regionkey = 1").select("n_name").collect()]  # a few names
    found = nations.select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("cell_id"))
    return found.groupBy("region").agg(sources.expected_cells(found, wanted).alias("same"))


@query("WITH s AS (SELECT DISTINCT source, lang FROM documents) SELECT source, arg_min(lang, md5(source || '/' || lang || ':7')) AS channel FROM s GROUP BY source")
def random_pick_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: each source's pick among its languages."""
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("present"))
    return rows.select("source", generate.pick_channel(F.col("source"), F.col("present"), 7).alias("channel"))


@query("SELECT * FROM (SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, CAST(NULL AS DOUBLE) AS size FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier UNION ALL SELECT p_partkey, p_name, NULL, CAST(p_size AS DOUBLE) FROM part)")
def concatenated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of different columns as one."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("size"))
    return maskops.concatenated(maskops.concatenated(c, s), p)


from . import kernel_queries  # noqa: E402, F401 - registers its queries here
