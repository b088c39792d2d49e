"""Words, lookups, folders and joins that the operators share."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from spectraframe.llm import common
from spectraframe.llm.suffix_tree import _Lookup, _place

from . import brute
from .conftest import unlike


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \t\n\x0b\x1c\x85\xa0é😀", max_size=12)), max_size=8))
def test_words(texts):
    h, n = common.word_hashes(*common.buffers(pa.array(texts, pa.string())))
    want = [brute.words((t or "").translate(brute.LOWER)) for t in texts]
    assert n.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))


def test_long_words_that_a_polynomial_confuses():
    a, b = (brute.words(unlike(k))[0] for k in range(2))
    h, _ = common.word_hashes(*common.buffers(pa.array([f"{a} {b} {b.upper()}", a[:31], a[:32], a[:33]])))
    assert h[1] == h[2]
    assert len(set(h.tolist())) == 5


def test_words_of_texts_longer_than_a_segment():
    texts = ["ab " * 900_000 + "x" * 1_500_000 + " end", "ab x", "", "end" * 600_000]
    h, n = common.word_hashes(*common.buffers(pa.array(texts)))
    assert n.tolist() == [900_002, 2, 0, 1]
    assert len(set(h[:900_000].tolist())) == 1
    assert h[0] == h[900_002]
    sliced, m = common.word_hashes(*common.buffers(pa.array(texts).slice(1, 1)))
    assert (m.tolist(), sliced.tolist()) == ([2], h[900_002:900_004].tolist())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), unique=True, max_size=60), st.lists(st.integers(-(2**63), 2**63 - 1), max_size=30))
def test_lookup(known, others):
    known = np.array(sorted(known), np.int64)
    keys = np.concatenate([known[::-1], np.array(others, np.int64), np.array([-1, 0], np.int64)])
    assert _Lookup(known)(keys).tolist() == _place(known, keys).tolist()


def folder(conf, core, named, master="local[8]"):
    sc = SimpleNamespace(applicationId="app-1", master=master, getConf=lambda: core, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: named is None, get=lambda: named))))
    return common.shared_folder(SimpleNamespace(sparkContext=sc, conf=conf))


def test_the_folder_is_the_one_the_cluster_names():
    none = {}
    assert folder({"spark.checkpoint.dir": "hdfs://a/b/"}, none, None).startswith("hdfs://a/b/llm-")
    assert folder(none, {"spark.checkpoint.dir": "file:///c"}, None).startswith("file:///c/llm-")
    assert folder(none, none, "file:/d/e").startswith("file:/d/e/llm-")
    own = folder(none, none, None)
    assert own.rpartition("/")[0] == folder(none, none, None).rpartition("/")[0]
    assert own != folder(none, none, None)
    for master in ("local-cluster[3,2,1024]", "spark://h:7077", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            folder(none, none, None, master)


def test_written_tables_can_be_discarded(spark):
    t = common.written(spark.range(5).toDF("k"))
    assert t.count() == 5
    common.discard(spark, t)
    with pytest.raises(Exception, match="(?i)not exist|FileNotFound|PATH_NOT_FOUND|FILE_NOT"):
        spark.read.schema("k long").parquet(common._paths.get(t, "/nowhere")).count()


def test_temporary_tables_go_together(spark):
    with common.temporary(spark) as keep:
        gone, stays = common.written(spark.range(3).toDF("k")), keep(common.written(spark.range(4).toDF("k")))
        path = common._paths[gone]
    assert stays.count() == 4
    with pytest.raises(Exception, match="(?i)not exist|FileNotFound|PATH_NOT_FOUND|FILE_NOT"):
        spark.read.parquet(path).count()


@pytest.mark.parametrize("hot", [False, True])
def test_sized_join_of_odd_keys(spark, hot):
    """Two columns, nulls (which meet nothing), and keys that only one side has."""
    rows = [(1, "a")] * (3000 if hot else 2) + [(1, None), (None, "a")] * 5 + [(k, "b") for k in range(3000)]
    left = spark.createDataFrame(rows, "x int, y string")
    right = left.where("x < 100").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    got = common.join_sized(left, right, ["x", "y"], "n", len(rows))
    assert got.count() == sum(1 for x, y in rows if x is not None and y is not None and x < 100)


def test_sized_join(spark):
    left = spark.range(5000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = common.join_sized(left, right, ["k"], "n", 5000)
    assert out.count() == 5000
    assert out.where("k = 1 AND n <> 3000").count() == 0
    assert sorted(out.columns) == ["id", "k", "n"]
