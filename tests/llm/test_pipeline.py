"""The pipeline's stages on odd rows, and each stage's decisions against the plain versions."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from spectraframe.llm.common import written
from spectraframe.llm.packing import best_two_fit, token_ids
from spectraframe.llm.quality import FUNCTION_WORDS

from . import brute


@pytest.fixture(scope="module")
def mixed(spark, odd, sf_dir):
    """The odd rows among the test table's, whose own doc_ids begin at 10,000."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 10_000)
    return docs.unionByName(odd, allowMissingColumns=True).select(odd.columns)


def test_stages(spark, mixed):
    docs = mixed
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, ""))
        if name != "packing":
            assert out.columns == docs.columns
        if name == "quality":
            rows = docs.collect()
            good, _ = brute.qualities([(r.text, r.lang) for r in rows], FUNCTION_WORDS)
            sure = [(r, p >= 0.5) for r, p in zip(rows, good, strict=True) if abs(p - 0.5) > 1e-6]
            want = Counter(r for r, p in sure if p and not brute.quality(r.text)[-1])
            assert Counter(r for r in out.collect() if r in {x for x, _ in sure}) == want
        if name == "line_dedup":
            want = brute.lines([(r.doc_id, r.text) for r in docs.collect()])
            assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted((i or 0, x) for i, _, _, x in want)
        if name == "near_dedup":
            want = brute.near([(r.doc_id, r.text) for r in docs.collect()], 5)
            assert {r.doc_id for r in out.collect()} == {i for i, _, c in want if i == c}
        if name == "mixing":
            rows = docs.collect()
            copies, _ = brute.mixed([(r.doc_id, r.source, len(brute.words(r.text))) for r in rows])
            assert Counter(out.collect()) == sum((Counter({r: copies[r.doc_id, r.source]}) for r in rows), Counter())
        if name == "packing":
            want, lengths = Counter(), Counter()
            for r in docs.collect():
                ids = np.append(token_ids(r.text), 0).astype("<u4")
                ends = list(range(len(ids) % 2048 or 2048, len(ids) + 1, 2048))
                for k, e in enumerate(ends):
                    s = ends[k - 1] if k else 0
                    want[r.doc_id, k, s, e - s, ids[s:e].tobytes()] += 1
                    lengths[e - s] += 1
            rows = out.collect()
            assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in rows) == want
            places = {}
            for r in rows:
                places.setdefault(r.sequence_id, []).append((r.offset, r.length))
            assert len(places) == sum(n for _, n in best_two_fit(lengths, 2048))
            for own in places.values():
                own.sort()
                assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
                assert sum(n for _, n in own) <= 2048
        docs = out


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 500
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_sequences_can_be_assembled(spark, odd):
    """From what packing returns alone: each document's ids, from its pieces' places in their sequences."""
    docs = odd.where("doc_id IN (4, 8, 90, 91)")
    rows = corpus_pipeline.packed(spark, docs, "").collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, {})[r.offset] = bytes(r.ids)
    whole = {k: b"".join(own[o] for o in sorted(own)) for k, own in sequences.items()}
    for r in docs.collect():
        own = sorted((x for x in rows if x.doc_id == r.doc_id), key=lambda x: x.piece)
        ids = b"".join(whole[x.sequence_id][4 * x.offset : 4 * (x.offset + x.length)] for x in own)
        assert ids == np.append(token_ids(r.text), 0).astype("<u4").tobytes()


def test_empty(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""))
    assert docs.count() == 0
