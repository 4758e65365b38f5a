"""Boxes: four columns ymin, xmin, ymax, xmax in [0, 1], y downwards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the pair classifier.
CONTAINED, SMALLER, OVERLAP_MOST, OFFSET_LEAST = 0.75, 0.85, 0.2, 0.03


@dataclass(frozen=True)
class Box:
    ymin: Column
    xmin: Column
    ymax: Column
    xmax: Column

    @staticmethod
    def of(prefix: str = "", frame=None) -> Box:
        col = (lambda n: frame[prefix + n]) if frame is not None else (lambda n: F.col(prefix + n))
        return Box(*(col(n) for n in ("ymin", "xmin", "ymax", "xmax")))

    @staticmethod
    def at(ymin: float, xmin: float, ymax: float, xmax: float) -> Box:
        return Box(*(F.lit(float(v)) for v in (ymin, xmin, ymax, xmax)))

    @property
    def height(self) -> Column:
        return F.greatest(F.lit(0.0), self.ymax - self.ymin)

    @property
    def width(self) -> Column:
        return F.greatest(F.lit(0.0), self.xmax - self.xmin)

    @property
    def area(self) -> Column:
        return self.height * self.width


def intersection(a: Box, b: Box) -> Column:
    high = F.greatest(F.lit(0.0), F.least(a.ymax, b.ymax) - F.greatest(a.ymin, b.ymin))
    wide = F.greatest(F.lit(0.0), F.least(a.xmax, b.xmax) - F.greatest(a.xmin, b.xmin))
    return high * wide


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    common = intersection(a, b)
    union = a.area + b.area - common
    return F.when(union > 0, common / union).otherwise(0.0)


def edge_gap(a: Box, b: Box) -> Column:
    """The distance between the boxes' edges; 0 where they touch or overlap."""
    dx = F.greatest(b.xmin - a.xmax, a.xmin - b.xmax, F.lit(0.0))
    dy = F.greatest(b.ymin - a.ymax, a.ymin - b.ymax, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def normalized_gap(a: Box, b: Box) -> Column:
    """The gap in units of the shortest side of both boxes (0 counts as 1e-6)."""

    def short(x: Box) -> Column:
        side = F.least(x.height, x.width)
        return F.when(side == 0, 1e-6).otherwise(side)

    return edge_gap(a, b) / F.least(short(a), short(b))


#: Codes of a pair's relation; a negative one has the second box as its subject.
INSIDE, LEFT_OF, ABOVE = 1, 2, 3
RELATIONS = {INSIDE: "inside", LEFT_OF: "left_of", ABOVE: "above"}


def relation_code(area_a: Column, area_b: Column, common: Column, dx: Column, dy: Column) -> Column:
    """The relation of two boxes as a code, from their areas, the area they share and the offsets of their centres (a less b); null where nothing is clear."""
    sideways = F.abs(dx) >= F.abs(dy)
    way = lambda code, forward: F.when(forward, code).otherwise(-code)
    return (
        F.when((area_a <= 0) | (area_b <= 0), None)
        .when((common / area_a >= CONTAINED) & (area_a <= SMALLER * area_b), INSIDE)
        .when((common / area_b >= CONTAINED) & (area_b <= SMALLER * area_a), -INSIDE)
        .when(common / (area_a + area_b - common) > OVERLAP_MOST, None)
        .when(sideways & (F.abs(dx) >= OFFSET_LEAST), way(LEFT_OF, dx < 0))
        .when(~sideways & (F.abs(dy) >= OFFSET_LEAST), way(ABOVE, dy < 0))
    )


def classified(pairs: DataFrame, a: str = "a_", b: str = "b_", name: str = "code") -> DataFrame:
    """Pairs of boxes (a_ymin, ..., b_xmax) with their :func:`relation_code`.

    Areas, overlap and offsets are columns of their own, made once a pair: each
    projection has a row id that isn't deterministic to the optimiser, so it
    neither repeats their expressions in the next nor moves a filter below them.
    """
    x, y = Box.of(a), Box.of(b)
    once = lambda c: F.when(F.monotonically_increasing_id() >= 0, c)
    parts = {"_sa": x.area, "_sb": y.area, "_common": intersection(x, y), "_dx": (x.xmin + x.xmax) / 2 - (y.xmin + y.xmax) / 2, "_dy": (x.ymin + x.ymax) / 2 - (y.ymin + y.ymax) / 2}
    code = relation_code(*(F.col(c) for c in parts))
    return pairs.withColumns({k: once(v) for k, v in parts.items()}).withColumn(name, once(code)).drop(*parts)


def classify_pair(a: Box, b: Box) -> Column:
    """struct(relation, a_is_subject): inside, left_of or above; null where nothing is clear. For single pairs; tables take :func:`classified`."""
    code = relation_code(a.area, b.area, intersection(a, b), (a.xmin + a.xmax) / 2 - (b.xmin + b.xmax) / 2, (a.ymin + a.ymax) / 2 - (b.ymin + b.ymax) / 2)
    return F.when(code.isNotNull(), F.struct(relation_name(code).alias("relation"), (code > 0).alias("a_is_subject")))


def relation_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(RELATIONS[i]) for i in sorted(RELATIONS)]), F.abs(code).cast("int"))


def grid_position(box: Box) -> Column:
    """The name of the 3 x 3 grid cell that holds the box's centre, such as ``top-left`` or ``center``."""
    third = lambda v, names: F.when(v < 1 / 3, names[0]).when(v < 2 / 3, names[1]).otherwise(names[2])
    h = third((box.xmin + box.xmax) / 2, ("left", "center", "right"))
    v = third((box.ymin + box.ymax) / 2, ("top", "middle", "bottom"))
    return F.when((v == "middle") & (h == "center"), "center").when(v == "middle", h).when(h == "center", v).otherwise(F.concat_ws("-", v, h))


def clamp(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def from_pixels(y0: Column, x0: Column, y1: Column, x1: Column, height: Column, width: Column) -> Box:
    """Two corners in pixels, in any order, as a box in [0, 1]."""
    return Box(clamp(F.least(y0, y1) / height), clamp(F.least(x0, x1) / width), clamp(F.greatest(y0, y1) / height), clamp(F.greatest(x0, x1) / width))


def around_polygon(points: Column, height: Column, width: Column) -> Box:
    """The box round an array of struct(x, y) in pixels."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return Box(clamp(F.array_min(ys) / height), clamp(F.array_min(xs) / width), clamp(F.array_max(ys) / height), clamp(F.array_max(xs) / width))


def crop_pixels(box: Box, height: Column, width: Column) -> Column:
    """struct(top, left, bottom, right) in whole pixels, at least one pixel each way."""
    top, left = F.floor(clamp(box.ymin) * height), F.floor(clamp(box.xmin) * width)
    bottom, right = F.ceil(clamp(box.ymax) * height), F.ceil(clamp(box.xmax) * width)
    return F.struct(top.alias("top"), left.alias("left"), F.greatest(top + 1, bottom).alias("bottom"), F.greatest(left + 1, right).alias("right"))
