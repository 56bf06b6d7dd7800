"""Large images in overlapping tiles: each tile is processed on its own, then tiles are blended at their seams.

Pixels are rows, and go to each tile that covers them. A processor is a function of tiles to tiles, and a
chain is a left fold of processors. What covers a pixel in the end is a few values, folded in the order
of tiles: the first write stamps, so does one from well inside a tile, and others mix by their distance
to the tile's edge.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Processor = Callable[[DataFrame], DataFrame]
#: Pixels of an image up to which it is one tile; the side of a tile, and the overlap.
WHOLE, TILE, OVERLAP = 3840 * 2160, 512, 32


def starts(n: Column, tile: int, overlap: int) -> Column:
    """Where tiles begin along a side of n pixels; the last one is moved inward."""
    step = max(tile - overlap, 1)
    last = F.greatest(n - tile, F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.ceil(last / step).cast("int")), lambda k: F.least(k * step, last).cast("int"))


def grid(images: DataFrame, whole: int = WHOLE, tile: int = TILE, overlap: int = OVERLAP) -> DataFrame:
    """images (id, w, h) with their tiles: n (row by row), x0, y0, tw, th."""
    tile, overlap = max(16, tile), max(0, min(overlap, tile // 2))
    alone = F.col("w").cast("long") * F.col("h") <= max(1, whole)
    side = lambda n: F.when(alone, F.array(F.lit(0))).otherwise(starts(F.col(n), tile, overlap))
    size = lambda n: F.when(alone, F.col(n)).otherwise(F.least(F.col(n), F.lit(tile)))
    rows = images.select("*", side("w").alias("_xs"), F.posexplode(side("h")).alias("_j", "y0"))
    rows = rows.select("*", F.posexplode("_xs").alias("_i", "x0"))
    return rows.select(*images.columns, (F.col("_j") * F.size("_xs") + F.col("_i")).alias("n"), "x0", "y0", size("w").alias("tw"), size("h").alias("th"))


def tiled(pixels: DataFrame, whole: int = WHOLE, tile: int = TILE, overlap: int = OVERLAP) -> DataFrame:
    """pixels (id, y, x, v, w, h) in every tile that covers them: id, n, row, col, v, x0, y0, tw, th. No join: the grid follows from w and h."""
    tile, overlap = max(16, tile), max(0, min(overlap, tile // 2))
    alone = F.col("w").cast("long") * F.col("h") <= max(1, whole)

    def covering(at: str, n: str) -> Column:
        every = F.transform(starts(F.col(n), tile, overlap), lambda s, k: F.struct(k.alias("k"), s.alias("s")))
        return F.when(alone, F.array(F.struct(F.lit(0).alias("k"), F.lit(0).alias("s")))).otherwise(F.filter(every, lambda t: (t["s"] <= F.col(at)) & (F.col(at) < t["s"] + tile)))

    across = F.when(alone, 1).otherwise(F.size(starts(F.col("w"), tile, overlap)))
    size = lambda n: F.when(alone, F.col(n)).otherwise(F.least(F.col(n), F.lit(tile)))
    rows = pixels.select("*", across.alias("_across"), covering("x", "w").alias("_xs"), F.explode(covering("y", "h")).alias("_j"))
    rows = rows.select("*", F.explode("_xs").alias("_i"))
    return rows.select(
        "id", (F.col("_j.k") * F.col("_across") + F.col("_i.k")).alias("n"), (F.col("y") - F.col("_j.s")).alias("row"), (F.col("x") - F.col("_i.s")).alias("col"), "v",
        F.col("_i.s").alias("x0"), F.col("_j.s").alias("y0"), size("w").alias("tw"), size("h").alias("th"),
    )


def chained(*processors: Processor) -> Processor:
    """One processor after the other; none leaves tiles as they are."""
    return lambda tiles: reduce(lambda t, f: t.transform(f), processors, tiles)


def pointwise(f: Callable[[Column], Column]) -> Processor:
    return lambda tiles: tiles.withColumn("v", f(F.col("v")))


def smoothed(tiles: DataFrame) -> DataFrame:
    """The mean of three neighbours of a row, rounded; a tile's edge stands for what is beyond it."""
    own = Window.partitionBy("id", "n", "row").orderBy("col")
    near = [F.coalesce(f("v").over(own), F.col("v")) for f in (F.lag, F.lead)]
    return tiles.withColumn("v", F.round((near[0] + F.col("v") + near[1]) / 3.0))


def feathered(tiles: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """id, y, x, v of tiles (see tiled()): an ordered fold of the tiles that cover each pixel, in whole numbers from 0 to 255."""
    ramp = float(max(overlap, 1))
    edge = lambda at, n: F.least(F.col(at) / ramp, (F.col(n) - 1 - F.col(at)) / ramp, F.lit(1.0))
    weight = edge("col", "tw") * edge("row", "th")
    write = F.struct("n", F.col("v").cast("double").alias("v"), weight.alias("w"))
    writes = tiles.groupBy("id", (F.col("y0") + F.col("row")).alias("y"), (F.col("x0") + F.col("col")).alias("x")).agg(F.array_sort(F.collect_list(write)).alias("_of"))
    mixed = lambda s, t: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(s * (1 - t["w"]) + t["v"] * t["w"])))
    out = F.aggregate("_of", F.lit(None).cast("double"), lambda s, t: F.when(s.isNull() | (t["w"] >= 0.999), t["v"]).otherwise(mixed(s, t)))
    return writes.select("id", "y", "x", out.alias("v"))


def processed(pixels: DataFrame, processor: Processor, whole: int = WHOLE, tile: int = TILE, overlap: int = OVERLAP) -> DataFrame:
    return feathered(processor(tiled(pixels, whole, tile, overlap)), max(0, min(overlap, max(16, tile) // 2)))
