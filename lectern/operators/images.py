"""Image probes and packets: measures of page images, tiles, strips, contact sheets, repair of repeated images."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered


def otsu(gray: np.ndarray, bins: int = 64) -> float:
    """The threshold that parts dark from light best."""
    counts, edges = np.histogram(gray, bins=bins, range=(0, 256))
    mids, w = (edges[:-1] + edges[1:]) / 2, counts / max(counts.sum(), 1)
    low, mean = np.cumsum(w), np.cumsum(w * mids)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean[-1] * low - mean) ** 2 / (low * (1 - low))
    return float(edges[1:][int(np.nanargmax(np.where(np.isfinite(between), between, -1)))])


def component_sizes(mask: np.ndarray) -> np.ndarray:
    """Sizes of the 4-connected parts of a mask, largest first."""
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape) + 1, 0)
    while True:
        new = label.copy()
        for a, b in (((slice(1, None), slice(None)), (slice(None, -1), slice(None))), ((slice(None), slice(1, None)), (slice(None), slice(None, -1)))):
            both = mask[a] & mask[b]
            top = np.maximum(new[a], new[b])
            new[a] = np.where(both, top, new[a])
            new[b] = np.where(both, np.maximum(top, new[b]), new[b])
        jump = np.where(new > 0, new.ravel()[np.maximum(new - 1, 0)], 0)
        if (jump == label).all():
            break
        label = jump
    return np.sort(np.unique(label[label > 0], return_counts=True)[1])[::-1]


def line_pitch(mask: np.ndarray, least: int = 4) -> tuple[int, float]:
    """Distance of text lines in pixels and the strength of that period; half of it where that is nearly as strong."""
    profile = mask.sum(1).astype(float)
    n = len(profile)
    profile -= np.polyval(np.polyfit(np.arange(n), profile, 1), np.arange(n))
    power = (profile**2).sum()
    if power == 0 or n < 4 * least:
        return 0, 0.0
    auto = np.correlate(profile, profile, "full")[n - 1 :] / power
    lags = np.arange(least, n // 2)
    peaks = [k for k in lags if auto[k] >= auto[k - 1] and auto[k] >= auto[k + 1]]
    if not peaks:
        return 0, 0.0
    best = max(peaks, key=lambda k: auto[k])
    half = [k for k in peaks if abs(k - best / 2) <= 1 and auto[k] >= 0.7 * auto[best]]
    best = half[0] if half else best
    return int(best), float(auto[best])


def measure(rgb: np.ndarray) -> dict[str, float]:
    """Ink share, parts, line pitch and mean saturation of an image."""
    gray = rgb.mean(2)
    mask = gray < otsu(gray)
    sizes = component_sizes(mask)
    pitch, strength = line_pitch(mask)
    high, low = rgb.max(2).astype(float), rgb.min(2)
    return {"ink": float(mask.mean()), "parts": float(len(sizes)), "largest": float(sizes[0]) if len(sizes) else 0.0, "pitch": float(pitch), "strength": strength, "saturation": float(np.where(high > 0, (high - low) / np.maximum(high, 1), 0).mean())}


def decoded(content: bytes) -> np.ndarray:
    """Rows x columns x 3 of an image: binary PGM and PPM, and whatever else Pillow reads where it is installed."""
    if content[:2] in (b"P5", b"P6"):
        head = re.match(rb"P[56]\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", content)
        w, h, deep = (int(x) for x in head.groups())
        if deep > 255:
            raise ValueError("images of 8 bits only")
        planes = 3 if content[:2] == b"P6" else 1
        data = np.frombuffer(content, np.uint8, w * h * planes, head.end()).reshape(h, w, planes)
        return np.repeat(data, 3, 2) if planes == 1 else data
    import io

    from PIL import Image

    return np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))


MEASURES = "ink double, parts double, largest double, pitch double, strength double, saturation double"


def measured(files: DataFrame) -> DataFrame:
    """(path, status, measures) of image files (path, content), as Spark's binaryFile source reads them; what can't be decoded is told, not dropped."""
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def run(it):
        for pdf in it:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    found, status = measure(decoded(bytes(content))), "ok"
                except Exception as e:  # a broken file is a row of its own
                    found, status = {}, f"unreadable: {type(e).__name__}"
                rows.append((path, status, *(found.get(n) for n in names)))
            yield pd.DataFrame(rows, columns=["path", "status", *names])

    return files.select("path", "content").mapInPandas(run, f"path string, status string, {MEASURES}")


def _number(size: Column, tile: Column, overlap: int) -> Column:
    """Of how many stretches of at most ``tile`` that overlap by ``overlap`` a length is made."""
    return F.when(size <= tile, 1).otherwise(F.ceil((size - overlap) / (tile - overlap))).cast("int")


def _cuts(size: Column, tile: Column, overlap: int, n: Column | None = None) -> Column:
    """array<struct(a, b)>: as few equal stretches of at most ``tile`` that overlap by ``overlap``; n: their number, if it is known."""
    n = _number(size, tile, overlap) if n is None else n
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.when(n == 1, 0).otherwise(F.floor(k * (size - tile) / (n - 1))).cast("int").alias("a"), F.when(n == 1, size).otherwise(F.floor(k * (size - tile) / (n - 1)) + tile).cast("int").alias("b")))


def tiles(images: DataFrame, tile: int = 1500, overlap: int = 200, most: int = 40) -> DataFrame:
    """(image, k, left, top, right, bottom): overlapping boxes over images (image, width, height); the tile grows by halves until there are ``most`` at most.

    An image's boxes are numbered in one row of it, by top and left; only sizes go through a shuffle."""
    sizes = [int(tile * 1.5**k) for k in range(13)]
    width, height = F.col("width"), F.col("height")
    fit: Column | None = None
    for t in reversed(sizes):
        few = _number(width, F.lit(t), overlap) * _number(height, F.lit(t), overlap) <= most
        fit = F.when(few, t) if fit is None else F.when(few, t).otherwise(fit)
    one = images.withColumn("tile", fit).withColumns({"nx": _number(width, F.col("tile"), overlap), "ny": _number(height, F.col("tile"), overlap)})
    own = one.where("nx * ny > 0").groupBy("image").agg(F.collect_list(F.struct("width", "height", "tile", "nx", "ny")).alias("all"))
    cuts = F.transform("all", lambda i: F.struct(_cuts(i["height"], i["tile"], overlap, i["ny"]).alias("ys"), _cuts(i["width"], i["tile"], overlap, i["nx"]).alias("xs")))
    box = lambda y, x: F.struct(y["a"].alias("top"), x["a"].alias("left"), y["b"].alias("bottom"), x["b"].alias("right"))
    boxes = F.flatten(F.transform(cuts, lambda c: F.flatten(F.transform(c["ys"], lambda y: F.transform(c["xs"], lambda x: box(y, x))))))
    # one row's boxes are made in order
    rows = own.select("image", F.size("all").alias("n"), boxes.alias("boxes")).select("image", F.posexplode(F.when(F.col("n") > 1, F.array_sort("boxes")).otherwise(F.col("boxes"))).alias("k", "box"))
    return rows.select("image", "k", *(f"box.{c}" for c in ("left", "top", "right", "bottom")))


def strips(images: DataFrame, height: int, overlap: int = 0) -> DataFrame:
    return images.select("image", F.posexplode(_cuts(F.col("height"), F.lit(height), overlap)).alias("k", "y")).select("image", "k", F.col("y.a").alias("top"), F.col("y.b").alias("bottom"))


def sheet(images: DataFrame, columns: int = 4, rows: int = 5) -> DataFrame:
    """(image, page, row, column): places on contact sheets in order of ``ord``."""
    k = numbered(images.select("image", "ord"), "ord", "k")
    return k.select("image", (F.col("k") - 1).alias("k")).select("image", F.floor(F.col("k") / (columns * rows)).alias("page"), F.floor(F.col("k") / columns).cast("int").alias("line"), (F.col("k") % columns).alias("column")).withColumn("row", F.col("line") % rows).drop("line")


def repeated_images(canvases: DataFrame, known: DataFrame) -> DataFrame:
    """Canvases (url, ord, base, width, height) whose image base repeats, with the base they should have.

    Where the numbers at the bases' ends differ from the canvas' place by one constant, the number that fits the place is the
    candidate; it is "corrected" if ``known`` (base, w, h) has it with the canvas' size, else a "FAULT"."""
    number = F.regexp_extract("base", r"(\d+)(?!.*\d)", 1)
    stem = F.regexp_replace("base", r"\d+(?!.*\d)", "#")
    own = canvases.withColumns({"number": number.cast("int"), "stem": stem, "n": F.count("*").over(Window.partitionBy("url", "base"))})
    shift = own.where("n = 1").groupBy("url").agg(F.min(F.col("number") - F.col("ord")).alias("a"), F.max(F.col("number") - F.col("ord")).alias("b"))
    bad = own.where("n > 1").join(shift, "url", "left").withColumn("fixed", F.when(F.col("a") == F.col("b"), F.replace("stem", F.lit("#"), (F.col("ord") + F.col("a")).cast("string"))))
    found = bad.join(known.select(F.col("base").alias("fixed"), "w", "h"), "fixed", "left")
    fits = F.coalesce((F.col("w") == F.col("width")) & (F.col("h") == F.col("height")), F.lit(False))
    return found.select("url", "ord", "base", F.when(fits, F.col("fixed")).alias("fixed"), F.when(fits, "corrected").otherwise("FAULT").alias("note"))
