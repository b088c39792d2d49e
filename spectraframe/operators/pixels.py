"""Pixel-relational operators: a raster is a row of values, or one row a pixel (image, r, c, v).

Operators that need one image's values alone (percentiles, stretches, run lengths) work on the array in its row and shuffle
nothing. Those that aggregate pixels use a pixel table: partial aggregation happens where the image is read, so what
is shuffled is a row an image (or an image and grey level), not its pixels. Stencils use windows over an image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SIDE = 8  # of the rasters in the embeddings table


def array_percentile(values: Column, p: float) -> Column:
    """The p-th quantile of an array, with linear interpolation."""

    def at(s: Column) -> Column:
        place = (F.size(s) - 1) * F.lit(float(p))
        low = F.floor(place).cast("int")
        a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
        return a + (b - a) * (place - low)

    return F.element_at(F.transform(F.array(F.array_sort(values)), at), 1)


def rasters(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, px): embeddings as rasters of doubles."""
    return embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("px"))


def pixel_table(images: DataFrame, side: int = SIDE, px: str = "px") -> DataFrame:
    """One row a pixel, with r and c; other columns are repeated."""
    keep = [c for c in images.columns if c != px]
    return images.select(*keep, F.posexplode(px).alias("pos", "v")).select(*keep, F.floor(F.col("pos") / side).cast("int").alias("r"), (F.col("pos") % side).cast("int").alias("c"), "v")


def normalize_to_float(px: Column, is_byte: Column) -> Column:
    """Bytes by 255; else by the image's largest value if over 1, clipped; else as they are."""
    top = F.array_max(px)
    return F.when(is_byte, F.transform(px, lambda v: v / 255)).when(top > 1, F.transform(px, lambda v: F.least(F.lit(1.0), v / top))).otherwise(px)


def percentile_stretch(px: Column) -> Column:
    """p2 to p98 stretched to [0, 1]; min to max where those are equal; zeros for a flat image."""
    lo, hi, least, most = array_percentile(px, 0.02), array_percentile(px, 0.98), F.array_min(px), F.array_max(px)
    bounds = F.struct(F.when(hi > lo, lo).otherwise(least).alias("lo"), F.when(hi > lo, hi).otherwise(most).alias("hi"))

    def stretched(b: Column) -> Column:
        return F.transform(px, lambda v: F.when(b["hi"] > b["lo"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - b["lo"]) / (b["hi"] - b["lo"])))).otherwise(0.0))

    return F.element_at(F.transform(F.array(bounds), stretched), 1)


def to_byte(v: Column) -> Column:
    """A value in [0, 1] as 8 bits, truncated."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255).cast("int")


def luminance(r: Column, g: Column, b: Column) -> Column:
    """P10."""
    return 0.299 * r + 0.587 * g + 0.114 * b


def channels(images: DataFrame, names: tuple[str, ...] = ("phase", "actin", "mt", "nuc"), whole: bool = True) -> DataFrame:
    """Four consecutive rasters as one cell: (cell_id, one column a channel). The pivot is a conditional aggregate. Cells without all
    channels are left out, or, if not `whole`, have nulls."""
    k = F.col("vec_id") % len(names)
    picked = [F.max(F.when(k == i, F.col("px"))).alias(name) for i, name in enumerate(names)]
    cells = images.groupBy(F.floor(F.col("vec_id") / len(names)).cast("long").alias("cell_id")).agg(*picked)
    return cells.dropna() if whole else cells


def rgb_composite(cells: DataFrame) -> DataFrame:
    """(cell_id, r, c, red, green, blue) from tubules, actin and nuclei, each stretched, as bytes."""
    rgb = cells.select("cell_id", *[percentile_stretch(F.col(name)).alias(name) for name in ("mt", "actin", "nuc")])
    flat = rgb.select("cell_id", F.posexplode(F.arrays_zip("mt", "actin", "nuc")).alias("pos", "p"))
    return flat.select("cell_id", F.floor(F.col("pos") / SIDE).cast("int").alias("r"), (F.col("pos") % SIDE).cast("int").alias("c"), to_byte(F.col("p.mt")).alias("red"), to_byte(F.col("p.actin")).alias("green"), to_byte(F.col("p.nuc")).alias("blue"))


def mask(px: Column, threshold: Column) -> Column:
    """strictly above."""
    return F.transform(px, lambda v: v > threshold)


def background_normalized(px: Column, inside: Column) -> Column:
    """Minus the median outside the mask, floored at 0, by the 99th percentile inside if that is over 0, clipped.
    Without any background the image stays as it is."""
    pairs = F.arrays_zip(px.alias("v"), inside.alias("m"))
    outside = F.transform(F.filter(pairs, lambda p: ~p["m"]), lambda p: p["v"])
    within = F.transform(F.filter(pairs, lambda p: p["m"]), lambda p: p["v"])
    level = F.coalesce(array_percentile(outside, 0.5), F.lit(0.0))

    def scaled(b: Column) -> Column:
        top = F.greatest(F.lit(0.0), array_percentile(within, 0.99) - b)

        def by(t: Column) -> Column:
            return F.transform(px, lambda v: F.when(t > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), v - b) / t)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v - b))))

        return F.element_at(F.transform(F.array(F.coalesce(top, F.lit(0.0))), by), 1)

    return F.when(F.size(outside) == 0, px).otherwise(F.element_at(F.transform(F.array(level), scaled), 1))


def otsu(images: DataFrame, bins: int = 16) -> DataFrame:
    """(vec_id, threshold) by the largest variance between classes, over `bins` equal bins of an image's range; the
    threshold is the centre of the first best bin. A flat image has its own value."""
    low, high = F.array_min("px"), F.array_max("px")
    rows = images.select("vec_id", low.alias("lo"), high.alias("hi"), F.explode("px").alias("v"))
    width = (F.col("hi") - F.col("lo")) / bins
    counted = rows.select("vec_id", "lo", "hi", F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width))).otherwise(0).cast("int").alias("b"))
    counted = counted.groupBy("vec_id", "lo", "hi", "b").agg(F.count(F.lit(1)).alias("n"))
    hist = counted.withColumn("mid", F.col("lo") + (F.col("b") + 0.5) * width)
    w = Window.partitionBy("vec_id").orderBy("b")
    whole = Window.partitionBy("vec_id")
    hist = hist.select("vec_id", "lo", "hi", "b", "mid", F.sum("n").over(w).alias("n1"), F.sum(F.col("n") * F.col("mid")).over(w).alias("s1"), F.sum("n").over(whole).alias("n"), F.sum(F.col("n") * F.col("mid")).over(whole).alias("s"))
    n2, m1, m2 = F.col("n") - F.col("n1"), F.col("s1") / F.col("n1"), (F.col("s") - F.col("s1")) / F.nullif(F.col("n") - F.col("n1"), F.lit(0))
    hist = hist.withColumn("between", F.round(F.coalesce(F.col("n1") * n2 * (m1 - m2) * (m1 - m2), F.lit(0.0)), 9))
    best = hist.groupBy("vec_id").agg(F.max_by("mid", F.struct("between", -F.col("b"))).alias("mid"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return best.select("vec_id", F.when(F.col("hi") > F.col("lo"), F.col("mid")).otherwise(F.col("lo")).alias("threshold"))


def _beside(c: str, w: WindowSpec) -> tuple[Column, Column]:
    """The values before and after; at the image's edge the pixel's own, as reflection gives for one step."""
    return F.coalesce(F.lag(c).over(w), F.col(c)), F.coalesce(F.lead(c).over(w), F.col(c))


def gradients(pixels: DataFrame) -> DataFrame:
    """(.., gx, gy) of all pixels, with reflected edges. gx responds to change along the rows' axis (down), gy along the
    columns'. Rows are smoothed and differenced with one sort, columns with another: no self-joins."""
    across, down = Window.partitionBy("vec_id", "r").orderBy("c"), Window.partitionBy("vec_id", "c").orderBy("r")
    left, right = _beside("v", across)
    rows = pixels.withColumns({"smooth": (left + 2 * F.col("v") + right) / 4, "slope": (right - left) / 2})
    (smooth_up, smooth_down), (slope_up, slope_down) = _beside("smooth", down), _beside("slope", down)
    return rows.withColumns({"gx": (smooth_down - smooth_up) / 2, "gy": (slope_up + 2 * F.col("slope") + slope_down) / 4}).drop("smooth", "slope")


def orientation(gradient: DataFrame, least: float = 0.1) -> DataFrame:
    """Nematic order |mean exp(2i theta)|, alignment |mean exp(i theta)|, mean angle and linear deviation over pixels
    of more than `least` magnitude; zeros for images without such."""
    theta = F.atan2("gy", "gx")
    some = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) > least
    t = F.when(some, theta)
    a = gradient.groupBy("vec_id").agg(F.avg(F.cos(2 * t)).alias("c2"), F.avg(F.sin(2 * t)).alias("s2"), F.avg(F.cos(t)).alias("c1"), F.avg(F.sin(t)).alias("s1"), F.stddev_pop(t).alias("sd"))
    zero = F.lit(0.0)
    return a.select("vec_id", F.coalesce(F.sqrt(F.col("c2") ** 2 + F.col("s2") ** 2), zero).alias("order_parameter"), F.coalesce(F.sqrt(F.col("c1") ** 2 + F.col("s1") ** 2), zero).alias("alignment_index"), F.coalesce(F.atan2("s1", "c1"), zero).alias("orientation_mean"), F.coalesce("sd", zero).alias("orientation_std"))


def edge_density(gradient: DataFrame) -> DataFrame:
    """The share of magnitudes above their own 90th percentile."""
    m = F.sqrt((F.col("gx") ** 2 + F.col("gy") ** 2) / 2)
    all_ = gradient.groupBy("vec_id").agg(F.collect_list(F.round(m, 9)).alias("m"))  # at most an image's pixels
    level = array_percentile(F.col("m"), 0.9)
    return all_.select("vec_id", F.element_at(F.transform(F.array(level), lambda t: F.size(F.filter("m", lambda x: x > t)) / F.size("m")), 1).alias("edge_density"))


def glcm(images: DataFrame, levels: int = 8, side: int = SIDE) -> DataFrame:
    """Texture of symmetric, normed co-occurrence at distance 1 in four directions: contrast, homogeneity, energy and
    correlation averaged over directions, entropy summed over them. Neighbours are read from the image's own array."""
    low, high = F.array_min("px"), F.array_max("px")
    level = F.transform("px", lambda v: F.when(high > low, F.least(F.lit(levels - 1), F.floor((v - low) / (high - low) * levels))).otherwise(0).cast("int"))
    rows = images.select("vec_id", level.alias("g"))
    pairs = rows.select("vec_id", F.col("g").alias("all"), F.posexplode("g").alias("pos", "a"))
    r, c = F.floor(F.col("pos") / side).cast("int"), (F.col("pos") % side).cast("int")
    steps = [(0, 0, 1), (1, -1, 1), (2, -1, 0), (3, -1, -1)]
    near = F.array(*[F.struct(F.lit(k).alias("angle"), F.when((r + dr).between(0, side - 1) & (c + dc).between(0, side - 1), F.get("all", (F.col("pos") + dr * side + dc).cast("int"))).alias("b")) for k, dr, dc in steps])
    pairs = pairs.select("vec_id", "a", F.explode(near).alias("n")).where("n.b IS NOT NULL").select("vec_id", "n.angle", "a", F.col("n.b").alias("b"))
    both = pairs.select("vec_id", "angle", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("vec_id", "angle", "p.a", "p.b")
    counts = both.groupBy("vec_id", "angle", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("vec_id", "angle")))
    d = F.col("a") - F.col("b")
    one = p.groupBy("vec_id", "angle").agg(F.sum(F.col("p") * d * d).alias("contrast"), F.sum(F.col("p") / (1 + d * d)).alias("homogeneity"), F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("energy"), F.sum(F.col("p") * F.col("a")).alias("ma"), F.sum(F.col("p") * F.col("a") * F.col("a")).alias("qa"), F.sum(F.col("p") * F.col("a") * F.col("b")).alias("ab"), F.sum(-F.col("p") * F.log(F.col("p") + 1e-10)).alias("entropy"))
    var = F.col("qa") - F.col("ma") * F.col("ma")
    one = one.withColumn("correlation", F.when(var < 1e-15, 1.0).otherwise((F.col("ab") - F.col("ma") * F.col("ma")) / F.when(var >= 1e-15, var)))
    return one.groupBy("vec_id").agg(F.avg("contrast").alias("glcm_contrast"), F.avg("homogeneity").alias("glcm_homogeneity"), F.avg("energy").alias("glcm_energy"), F.avg("correlation").alias("glcm_correlation"), F.sum("entropy").alias("glcm_entropy"))


def smoothness_skewness(pixels: DataFrame) -> DataFrame:
    """1 / (1 + variance) and population skewness of an image's pixels (0 where flat)."""
    a = pixels.groupBy("vec_id").agg(F.var_pop("v").alias("var"), F.skewness("v").alias("skew"))
    return a.select("vec_id", (1 / (1 + F.col("var"))).alias("glcm_smoothness"), F.coalesce(F.nanvl("skew", F.lit(0.0)), F.lit(0.0)).alias("glcm_skewness"))


def dilate(px_mask: Column, side: int = SIDE) -> Column:
    """M1 with a disk of radius 1: a pixel or one of its 4 neighbours. Outside counts as off."""
    return F.transform(px_mask, lambda v, k: v | _neighbour(px_mask, k, side, False, any_=True))


def erode(px_mask: Column, side: int = SIDE) -> Column:
    """M1 with a disk of radius 1: a pixel and all its 4 neighbours. Outside counts as on."""
    return F.transform(px_mask, lambda v, k: v & _neighbour(px_mask, k, side, True, any_=False))


def _neighbour(m: Column, k: Column, side: int, outside: bool, any_: bool) -> Column:
    c = k % side
    up, down = F.coalesce(F.get(m, k - side), F.lit(outside)), F.coalesce(F.get(m, k + side), F.lit(outside))
    left = F.when(c > 0, F.get(m, k - 1)).otherwise(outside)
    right = F.when(c < side - 1, F.get(m, k + 1)).otherwise(outside)
    return (up | down | left | right) if any_ else (up & down & left & right)


def area(px_mask: Column) -> Column:
    """A3, in pixels."""
    return F.size(F.filter(px_mask, lambda m: m)).cast("long")


def mask_box(px_mask: Column, side: int = SIDE) -> Column:
    """The inclusive box of a mask as (x0, y0, x1, y1); zeros for an empty one."""
    on = F.filter(F.sequence(F.lit(0), F.size(px_mask) - 1), lambda k: F.get(px_mask, k))
    cols, rows = F.transform(on, lambda k: k % side), F.transform(on, lambda k: F.floor(k / side).cast("int"))
    zero = F.lit(0)
    return F.struct(*[F.coalesce(x, zero).cast("int").alias(n) for n, x in (("x0", F.array_min(cols)), ("y0", F.array_min(rows)), ("x1", F.array_max(cols)), ("y1", F.array_max(rows)))])


def stability_score(px: Column, threshold: Column, offset: float) -> Column:
    """The area above threshold + offset by that above threshold - offset."""
    return F.size(F.filter(px, lambda v: v > threshold + offset)) / F.nullif(F.size(F.filter(px, lambda v: v > threshold - offset)), F.lit(0))


def rle(px_mask: Column, side: int = SIDE) -> Column:
    """Column-major run lengths, the first of zeros."""
    n = F.size(px_mask)
    ordered = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get(px_mask, (k % side) * side + F.floor(k / side).cast("int")))

    def runs(m: Column) -> Column:
        changes = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda k: F.get(m, k) != F.coalesce(F.get(m, k - 1), F.lit(False)))
        ends = F.concat(changes, F.array(F.size(m)))
        return F.transform(ends, lambda e, k: e - F.coalesce(F.get(ends, k - 1), F.lit(0)))

    return F.element_at(F.transform(F.array(ordered), runs), 1)


def rle_area(counts: Column) -> Column:
    """A31."""
    return F.aggregate(F.filter(counts, lambda x, k: k % 2 == 1), F.lit(0).cast("long"), lambda a, x: a + x)


def median_cross(pixels: DataFrame) -> DataFrame:
    """P15 with a disk of radius 1: the median of a pixel and its 4 neighbours; beyond the image's edge, the nearest pixel."""
    across, down = Window.partitionBy("vec_id", "r").orderBy("c"), Window.partitionBy("vec_id", "c").orderBy("r")
    (w, e), (n, s) = _beside("v", across), _beside("v", down)
    rows = pixels.withColumns({"w": w, "e": e}).withColumns({"n": n, "s": s})
    return rows.withColumn("v", F.get(F.array_sort(F.array("v", "w", "e", "n", "s")), 2)).drop("w", "e", "n", "s")


def bands_cleared(px_mask: Column, band: int = 1, most: float = 0.4, side: int = SIDE) -> Column:
    """F16: the top and the bottom rows cleared where the mask covers more than `most` of them."""
    size = band * side

    def covered(part: Column) -> Column:
        return F.size(F.filter(part, lambda m: m)) > most * size

    top, bottom = covered(F.slice(px_mask, 1, size)), covered(F.slice(px_mask, F.size(px_mask) - size + 1, size))
    return F.transform(px_mask, lambda m, k: m & ~(top & (k < size)) & ~(bottom & (k >= F.size(px_mask) - size)))


def cropped(pixels: DataFrame, r0: int, c0: int, r1: int, c1: int) -> DataFrame:
    """The pixels of a box, in its own coordinates."""
    return pixels.where(F.col("r").between(r0, r1 - 1) & F.col("c").between(c0, c1 - 1)).withColumns({"r": F.col("r") - r0, "c": F.col("c") - c0})


def uncropped(pixels: DataFrame, r0: int, c0: int) -> DataFrame:
    """Back in the image's coordinates."""
    return pixels.withColumns({"r": F.col("r") + r0, "c": F.col("c") + c0})


def box_xywh(box: Column) -> Column:
    """P19."""
    return F.struct(box["x0"].alias("x"), box["y0"].alias("y"), (box["x1"] - box["x0"]).alias("w"), (box["y1"] - box["y0"]).alias("h"))
