"""A hexagonal grid as Column expressions.

Longitude and latitude are laid on a plane and cut into hexagons of a size per resolution; a cell is its resolution and
its two axial coordinates, written hx<res>_<q>_<r>. Ids are this grid's own and no other's; what holds for them is that a
point has one cell per resolution, that a ring of k contains its centre and 3k(k+1)+1 cells, and that a boundary has six
corners."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Resolutions of a ladder, and the largest there is.
LADDER, FINEST = (5, 7, 9), 15


def edge_degrees(res: int) -> float:
    """Edge of a hexagon in degrees: each resolution's cells have about a seventh of the area of the one before."""
    if not 0 <= res <= FINEST:
        raise ValueError(f"resolution {res} is not between 0 and {FINEST}")
    return 10.0 / math.sqrt(7.0) ** res


def axial(lat: Column, lng: Column, res: int) -> tuple[Column, Column]:
    """Axial coordinates of the cell that holds a point, by cube rounding; null for a point off the earth."""
    size = edge_degrees(res)
    ok = lat.between(-90, 90) & lng.between(-180, 180)
    q = F.when(ok, (math.sqrt(3.0) / 3 * lng - lat / 3.0) / size)
    r = F.when(ok, (2.0 / 3 * lat) / size)
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(-q - r + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs + q + r)
    return F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq), F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)


def cell_id(q: Column, r: Column, res: int) -> Column:
    return F.when(q.isNotNull() & r.isNotNull(), F.concat(F.lit(f"hx{res}_"), q.cast("bigint").cast("string"), F.lit("_"), r.cast("bigint").cast("string")))


def cell_for(lat: Column, lng: Column, res: int) -> Column:
    return cell_id(*axial(lat, lng, res), res)


def ladder(lat: Column, lng: Column) -> Column:
    """array<struct(res, cell)> over LADDER; empty for a null point or one off the earth."""
    rungs = F.array(*[F.struct(F.lit(r).alias("res"), cell_for(lat, lng, r).alias("cell")) for r in LADDER])
    return F.filter(rungs, lambda x: x["cell"].isNotNull())


def _part(cell: Column, i: int) -> Column:
    found = F.regexp_extract(cell, r"^hx(\d{1,2})_(-?\d+)_(-?\d+)$", i)
    return F.when(found != "", found).cast("bigint")


def k_ring(cell: Column, k: int) -> Column:
    """The cells within k steps of a cell, itself included; null for a text that is no cell."""
    steps = [(dq, dr) for dq in range(-k, k + 1) for dr in range(max(-k, -dq - k), min(k, -dq + k) + 1)]
    res, q, r = (_part(cell, i) for i in (1, 2, 3))
    near = F.array(*[F.concat(F.lit("hx"), res.cast("string"), F.lit("_"), (q + dq).cast("string"), F.lit("_"), (r + dr).cast("string")) for dq, dr in steps])
    return F.when((res <= FINEST) & q.isNotNull(), near)


def boundary(cell: Column) -> Column:
    """array<struct(lat, lng)>: the six corners of a cell in order; null for a text that is no cell."""
    res, q, r = (_part(cell, i) for i in (1, 2, 3))
    size = F.lit(10.0) / F.pow(F.lit(math.sqrt(7.0)), res)
    lng, lat = size * (math.sqrt(3.0) * q + math.sqrt(3.0) / 2 * r), size * 1.5 * r
    corners = [math.radians(60 * i - 30) for i in range(6)]
    return F.when((res <= FINEST) & q.isNotNull(), F.array(*[F.struct((lat + size * math.sin(a)).alias("lat"), (lng + size * math.cos(a)).alias("lng")) for a in corners]))
