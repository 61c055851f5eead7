"""Vector and shape functions over arrays, inside the JVM unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tellstone.constants import JOIN_WEIGHTS


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; null for different lengths."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either length is 0."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.when(a.isNotNull() & b.isNotNull(), 0.0))


def unit(a: Column) -> Column:
    """The vector at length 1; one of length 0 stays as it is."""
    length = norm(a)
    return F.transform(a, lambda x: x / F.when(length == 0, 1.0).otherwise(length))


def blend(a: Column, b: Column) -> Column:
    """The unit vector halfway between two unit vectors."""
    return unit(F.zip_with(unit(a), unit(b), lambda x, y: (x + y) / 2))


def join_confidence(fracture: Column, semantic: Column, ngram: Column | None = None, weights: tuple[float, ...] = JOIN_WEIGHTS) -> Column:
    """Weighted sum of the scores of a join; two weights leave the n-gram score out. Null scores count as 0."""
    scores = [fracture, semantic] + ([ngram] if ngram is not None else [])
    return sum((F.lit(w) * F.coalesce(s, F.lit(0.0)) for w, s in zip(weights, scores)), F.lit(0.0))


def iou(x1: Column, y1: Column, w1: Column, h1: Column, x2: Column, y2: Column, w2: Column, h2: Column) -> Column:
    """Intersection over union of two boxes; boxes that only touch have 0."""
    width = F.greatest(F.least(x1 + w1, x2 + w2) - F.greatest(x1, x2), F.lit(0)).cast("double")
    height = F.greatest(F.least(y1 + h1, y2 + h2) - F.greatest(y1, y2), F.lit(0)).cast("double")
    both = width * height
    union = w1.cast("double") * h1 + w2.cast("double") * h2 - both
    return F.when(union > 0, both / union).otherwise(0.0)


def component_type(area: Column, w: Column, h: Column) -> Column:
    """Type of a connected component by its aspect, extent and area."""
    aspect, extent = F.when(h > 0, w / h).otherwise(1.0), F.when(w * h > 0, area / (w * h)).otherwise(0.0)
    return (
        F.when((aspect >= 0.3) & (aspect <= 3.0) & (extent > 0.3), F.when(area < 800, "wedge").otherwise("complex"))
        .when((aspect < 0.3) & (h > 30), "vertical").when((aspect > 3.0) & (w > 30), "horizontal").otherwise("angled")
    )


def component_confidence(area: Column, w: Column, h: Column) -> Column:
    """0.5 and what area and shape add to it, at most 0.95."""
    kind, aspect = component_type(area, w, h), F.when(h > 0, w / h).otherwise(1.0)
    by_area = F.when((area >= 200) & (area <= 2000), 0.2).when((area >= 100) & (area <= 4000), 0.1).otherwise(0.0)
    by_shape = (
        F.when((kind == "wedge") & (aspect >= 0.5) & (aspect <= 2.0), 0.2).when((kind == "vertical") & (aspect < 0.5), 0.2)
        .when((kind == "horizontal") & (aspect > 2.0), 0.2).when((kind == "complex") & (area > 500), 0.1).otherwise(0.0)
    )
    return F.least(F.lit(0.5) + by_area + by_shape, F.lit(0.95))


def stroke_type(angle: Column) -> Column:
    """Type of a stroke by its angle in degrees, from 0 to 180."""
    return F.when(angle > 70, F.when(angle > 160, "horizontal").otherwise("vertical")).when(angle < 20, "horizontal").otherwise("angled")


def _ring(points: Column, step) -> Column:
    """Sum of ``step(p, q)`` over the neighbouring points of a closed contour."""
    n = F.size(points)
    pairs = F.zip_with(points, F.concat(F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1)), step)
    return F.when(n > 0, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def contour_area(points: Column) -> Column:
    """Area of a closed contour by the shoelace formula."""
    return F.abs(_ring(points, lambda p, q: (p["x"] * q["y"] - q["x"] * p["y"]).cast("double"))) / 2


def contour_perimeter(points: Column) -> Column:
    return _ring(points, lambda p, q: F.sqrt(((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])).cast("double")))


def circularity(area: Column, perimeter: Column) -> Column:
    """4 pi area over the squared perimeter; 0 without a perimeter."""
    return F.when(perimeter > 0, 4 * 3.141592653589793 * area / (perimeter * perimeter)).otherwise(0.0)


def corner_angles(points: Column) -> Column:
    """Angle in degrees at each point of a closed contour; 0 where neighbours coincide."""
    n = F.size(points)
    before = F.concat(F.slice(points, n, F.lit(1)), F.slice(points, F.lit(1), n - 1))
    after = F.concat(F.slice(points, F.lit(2), n - 1), F.slice(points, 1, 1))
    corners = F.arrays_zip(before.alias("a"), points.alias("b"), after.alias("c"))

    def angle(k: Column) -> Column:
        ax, ay = k["a"]["x"] - k["b"]["x"], k["a"]["y"] - k["b"]["y"]
        cx, cy = k["c"]["x"] - k["b"]["x"], k["c"]["y"] - k["b"]["y"]
        lengths = F.sqrt((ax * ax + ay * ay).cast("double")) * F.sqrt((cx * cx + cy * cy).cast("double"))
        return F.when(lengths > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * cx + ay * cy) / lengths))))).otherwise(0.0)

    return F.when(n >= 3, F.transform(corners, angle)).otherwise(F.array().cast("array<double>"))


def hash_embedding(words: Column, dim: int = 768) -> Column:
    """Unit vector of hashed words: each word adds 1 to its bucket; the same in every process. Costs dim steps a word."""
    buckets = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    return unit(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double")))
