"""Prompts: an image is embedded once, whatever is asked; batches are of one length."""

import numpy as np
from pyspark.sql import functions as F
from spectraframe.functions import masks
from spectraframe.operators import prompts
from spectraframe.plans.prompt_queries import WEIGHTS
from spectraframe.schemas import RASTER
from spectraframe.sources.rasters import pack, unpack


def test_one_encoder_call_an_image(spark):
    calls, asked_of = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def encoder(x):
        calls.add(1)
        assert x.shape == (1, 3, 32, 32)
        return x[0]

    def decoder(embedding, tokens):
        asked_of.add(1)
        assert embedding.shape == (3, 32, 32)
        assert len(tokens) <= 40
        return np.repeat(embedding[0][None, None], 4, 1).repeat(len(tokens), 0) - np.arange(4)[None, :, None, None], np.tile(np.arange(4.0), (len(tokens), 1))

    rng = np.random.default_rng(1)
    arrays = {f"i{k}": rng.random((20 + k, 32)) for k in range(3)}
    images = spark.createDataFrame([(k, pack(a)) for k, a in arrays.items()], f"image_id string, image {RASTER.simpleString()}")
    embeddings = prompts.embedded(images, encoder, 32, (0.0,) * 3, (1.0,) * 3)
    point = F.array(F.struct(F.lit(3.0).alias("x"), F.lit(4.0).alias("y"), F.lit(1).alias("label")))
    box = F.struct(*[F.lit(float(k)).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])
    many = spark.range(150).select(F.concat(F.lit("i"), F.col("id") % 3).alias("image_id"), F.col("id").alias("prompt_id"), point.alias("points"), F.when(F.col("id") % 5 == 0, box).alias("box"))
    for multimask, ks in ((True, {1, 2, 3}), (False, {0})):
        tokens = prompts.encoded(prompts.scaled(many, embeddings, 32), 32, 32, WEIGHTS)
        out = prompts.predicted(embeddings, tokens, decoder, 32, multimask, batch=10).collect()
        assert {(r.prompt_id, r.k) for r in out} == {(p, k) for p in range(150) for k in ks}
        for r in out[:20]:
            a = arrays[r.image_id]
            np.testing.assert_array_equal(unpack(r.mask.asDict()), masks.restore_logits((np.pad(a, ((0, 32 - len(a)), (0, 0))).astype(np.float32) - r.k)[None], 32, a.shape, a.shape)[0] > 0)
    assert calls.value == 3
    assert asked_of.value >= 2 * 150 / 10


def test_scaled_prompts(spark):
    rows = spark.createDataFrame([("a", 1, [(10.0, 20.0, 1)], (1.0, 2.0, 3.0, 4.0)), ("a", 2, None, None)], "image_id string, prompt_id long, points array<struct<x:double,y:double,label:int>>, box struct<x0:double,y0:double,x1:double,y1:double>")
    sizes = spark.createDataFrame([("a", 50, 100)], "image_id string, height int, width int")
    got = {r.prompt_id: r for r in prompts.scaled(rows, sizes, 1000).collect()}
    assert tuple(got[1].points[0]) == (100.0, 200.0, 1)
    assert tuple(got[1].box) == (10.0, 20.0, 30.0, 40.0)
    assert got[2].points is None
    assert got[2].box is None
