"""Box arithmetic. A box is [x1, y1, x2, y2] in whole pixels; conversions cut towards zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def poly_to_bbox(poly: Column) -> Column:
    """The box around a polygon of [x, y] points; four zeros for none."""

    def ends(k: int) -> list[Column]:
        values = F.transform(poly, lambda p: F.element_at(p, k).cast("int"))
        return [F.array_min(values), F.array_max(values)]

    (x1, x2), (y1, y2) = ends(1), ends(2)
    return F.when(poly.isNull() | (F.size(poly) == 0), F.array(*[F.lit(0)] * 4)).otherwise(F.array(x1, y1, x2, y2))


def rescale(coordinate: Column, scale: Column) -> Column:
    """Undoes a page's scale; multiplied by the reciprocal, which decides what cutting does at the edge."""
    return F.when(scale == 1.0, coordinate).otherwise((coordinate * (F.lit(1.0) / scale)).cast("int"))


def capped(width: Column, height: Column, scale: Column, limit: Column) -> dict[str, Column]:
    """Size and effective scale of a page whose longer side is capped at limit."""
    longest = F.greatest(width, height)
    over = limit.isNotNull() & (limit > 0) & (longest > limit)
    down = limit / longest
    return {
        "new_width": F.when(over, F.greatest(F.lit(1), (width * down).cast("int"))).otherwise(width),
        "new_height": F.when(over, F.greatest(F.lit(1), (height * down).cast("int"))).otherwise(height),
        "effective_scale": F.when(over, scale * down).otherwise(scale),
    }


def order_quad(points: Column) -> Column:
    """Corners of a quadrilateral from top left clockwise: least x+y, least y-x, greatest x+y, greatest y-x; the first of equals."""
    tagged = F.transform(points, lambda p, i: F.struct((p[0] + p[1]).alias("s"), (p[1] - p[0]).alias("d"), i.alias("i")))

    def pick(key: str, sign: int) -> Column:
        best = F.array_min(F.transform(tagged, lambda t: F.struct((sign * t[key]).alias("k"), t["i"].alias("i"))))
        return F.element_at(points, best["i"] + 1)

    return F.array(pick("s", 1), pick("d", 1), pick("s", -1), pick("d", -1))
