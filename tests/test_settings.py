"""Registered queries run their operators with the operators' own settings."""

from pyspark.sql import functions as F
from spectraframe.config import Config
from spectraframe.operators import clustering
from spectraframe.plans import queries


def test_variants_are_as_many_as_configured(spark):
    out = queries.QUERIES["variants_structural"](spark, "/root/testdata/sf0.001")
    assert {r.n for r in out.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {Config().n_per_cell}


def test_kmeans_takes_the_best_of_all_starts(spark, monkeypatch):
    starts, fit = [], clustering.kmeans

    def seen(vectors, k=3, n_init=10, seed=42):
        starts.append(n_init)
        return fit(vectors, k, n_init, seed)

    monkeypatch.setattr(clustering, "kmeans", seen)
    queries.QUERIES["kmeans_inertia"](spark, "/root/testdata/sf0.001")
    assert starts == [Config().n_init]


def test_kmeans_reads_the_rows_once_for_all_starts(spark, monkeypatch):
    """The inertia is not above that of Spark ML's best of as many starts, and scans don't grow with the starts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    z = queries.scaled(spark, "/root/testdata/sf0.001").persist()
    scans, scan = [], clustering._scan
    monkeypatch.setattr(clustering, "_scan", lambda *a: scans.append(1) or scan(*a))
    _, centres, inertia = clustering.kmeans(z, 3, 10, 42)
    many = len(scans)
    clustering.kmeans(z, 3, 2, 42)
    assert many <= 2 * (len(scans) - many) + 20
    fits = [KMeans(k=3, seed=s, featuresCol="v").fit(z.withColumn("v", array_to_vector("px"))).summary.trainingCost for s in range(5)]
    assert inertia <= min(fits) * 1.01
    assert len(centres) == 3
