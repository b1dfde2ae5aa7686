"""Plane geometry on executors: polylines as legs, length inside a widened polygon, and outlines of widened lines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from wayfare.functions.scalars import EPS
from wayfare.plans.shared import cut

#: Steps of the outline's grid to a radius, and grid cells along the side of a tile.
STEPS, TILE = 12, 64


def legs(lines: DataFrame, points: str = "geom") -> DataFrame:
    """One row (x0, y0, x1, y1) for each straight leg of polylines given as ``points`` array<struct<x, y>>; others fall out.

    A line of one point is a leg of no length; points without a number are left out.
    """
    real = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    pair = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_p") - 1, F.lit(1))), lambda i: F.struct(F.get("_p", i - 1).alias("a"), F.coalesce(F.get("_p", i), F.get("_p", i - 1)).alias("b")))
    placed = lines.withColumn("_p", real).where(F.size("_p") > 0).withColumn("_leg", F.explode(pair))
    return placed.withColumns({"x0": F.col("_leg.a.x"), "y0": F.col("_leg.a.y"), "x1": F.col("_leg.b.x"), "y1": F.col("_leg.b.y")}).drop("_p", "_leg")


def length_of(points: str = "geom"):
    """The length of a polyline column; 0 for fewer than two points."""
    square = lambda i, c: F.pow(F.get(F.col(points), i)[c] - F.get(F.col(points), i - 1)[c], F.lit(2.0))
    many = F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda i: F.sqrt(square(i, "x") + square(i, "y")))
    return F.when(F.size(points) > 1, F.aggregate(many, F.lit(0.0), lambda s, v: s + v)).otherwise(0.0)


def centroids(lines: DataFrame, keys: list[str], points: str = "geom") -> DataFrame:
    """(keys, x, y): the length-weighted middle of the legs of each key's polylines; of lines without length, of their points."""
    length = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    each = legs(lines, points).withColumns({"_n": length, "_x": (F.col("x0") + F.col("x1")) / 2, "_y": (F.col("y0") + F.col("y1")) / 2})
    mean = lambda c: F.coalesce(F.sum(F.col(c) * F.col("_n")) / F.nullif(F.sum("_n"), F.lit(0.0)), F.avg(c))
    return each.groupBy(*keys).agg(mean("_x").alias("x"), mean("_y").alias("y"))


def _spans(x0: np.ndarray, y0: np.ndarray, dx: np.ndarray, dy: np.ndarray, a: np.ndarray, b: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The part [low, high] of each leg within ``radius`` of the segment a-b, for parameters 0 to 1; empty where low > high."""
    low, high = np.full(len(x0), np.inf), np.full(len(x0), -np.inf)

    def add(some, l, h):  # noqa: E741
        l, h = np.maximum(l, 0), np.minimum(h, 1)  # noqa: E741
        some = some & (l <= h)
        np.minimum(low, np.where(some, l, np.inf), out=low)
        np.maximum(high, np.where(some, h, -np.inf), out=high)

    square = dx * dx + dy * dy
    with np.errstate(divide="ignore", invalid="ignore"):
        for end in (a, b):  # the disks at the ends
            ex, ey = x0 - end[0], y0 - end[1]
            half, c = ex * dx + ey * dy, ex * ex + ey * ey - radius * radius
            root = np.sqrt(np.maximum(half * half - square * c, 0))
            add((half * half >= square * c) & (square > 0), (-half - root) / square, (-half + root) / square)
            add((square == 0) & (c <= 0), np.zeros(len(x0)), np.ones(len(x0)))
        n = math.hypot(b[0] - a[0], b[1] - a[1])
        if n > 0:  # the rectangle between them
            ux, uy = (b[0] - a[0]) / n, (b[1] - a[1]) / n
            l, h, some = np.zeros(len(x0)), np.ones(len(x0)), np.ones(len(x0), bool)  # noqa: E741
            for at, step, least, most in (((x0 - a[0]) * ux + (y0 - a[1]) * uy, dx * ux + dy * uy, 0.0, n), ((y0 - a[1]) * ux - (x0 - a[0]) * uy, dy * ux - dx * uy, -radius, radius)):
                flat = np.abs(step) < 1e-300
                some &= ~flat | ((at >= least) & (at <= most))
                p, q = (least - at) / np.where(flat, 1, step), (most - at) / np.where(flat, 1, step)
                l = np.where(flat, l, np.maximum(l, np.minimum(p, q)))  # noqa: E741
                h = np.where(flat, h, np.minimum(h, np.maximum(p, q)))
            add(some, l, h)
    return low, high


def inside_lengths(legs_: np.ndarray, polygon: np.ndarray, tolerance: float = 0.0) -> np.ndarray:
    """How much of each leg (x0, y0, x1, y1) is inside a polygon (points in order, closed or not) widened by ``tolerance``."""
    x0, y0, x1, y1 = legs_.T
    dx, dy = x1 - x0, y1 - y0
    if len(polygon) > 1 and (polygon[0] == polygon[-1]).all():
        polygon = polygon[:-1]
    ends = list(zip(polygon, np.roll(polygon, -1, axis=0), strict=True))
    cuts = [np.zeros(len(x0)), np.ones(len(x0))]
    near = []
    for a, b in ends:
        ex, ey = b - a
        den = dx * ey - dy * ex
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((a[0] - x0) * ey - (a[1] - y0) * ex) / den
            u = ((a[0] - x0) * dy - (a[1] - y0) * dx) / den
        cuts.append(np.where((den != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1), t, 1.0))
        if tolerance > 0:
            low, high = _spans(x0, y0, dx, dy, a, b, tolerance)
            near.append((low, high))
            cuts += [np.where(low <= high, low, 1.0), np.where(low <= high, high, 1.0)]
    at = np.sort(np.stack(cuts), axis=0)
    share = np.zeros(len(x0))
    for l, h in zip(at[:-1], at[1:], strict=True):  # noqa: E741
        if not (h > l).any():
            continue
        mid = (l + h) / 2
        px, py = x0 + mid * dx, y0 + mid * dy
        odd = np.zeros(len(x0), bool)
        for a, b in ends:
            crosses = (a[1] > py) != (b[1] > py)
            with np.errstate(divide="ignore", invalid="ignore"):
                odd ^= crosses & (px < a[0] + (py - a[1]) / (b[1] - a[1]) * (b[0] - a[0]))
        for low, high in near:
            odd |= (mid >= low) & (mid <= high)
        share += np.where(odd, h - l, 0)
    return share * np.hypot(dx, dy)


def inside_ratio(lines: DataFrame, key: str, polygon: list[tuple[float, float]], tolerance: float = 0.0, points: str = "geom") -> DataFrame:
    """(key, inside_ratio): the share of each line's length inside the widened polygon; 0 for lines without length.

    The polygon is the one boundary of a scope, so it goes to every task.
    """
    ring = np.array(polygon, dtype=np.float64)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            own = part[["x0", "y0", "x1", "y1"]].to_numpy(np.float64)
            yield pd.DataFrame({key: part[key], "length": np.hypot(own[:, 2] - own[:, 0], own[:, 3] - own[:, 1]), "inside": inside_lengths(own, ring, tolerance)})

    kind = dict(lines.dtypes)[key]
    each = legs(lines, points).select(key, "x0", "y0", "x1", "y1").mapInPandas(run, f"{key} {kind}, length double, inside double")
    found = each.groupBy(key).agg(F.coalesce(F.sum("inside") / F.nullif(F.sum("length"), F.lit(0.0)), F.lit(0.0)).alias("inside_ratio"))
    return lines.select(key).distinct().join(found, key, "left").select(key, F.coalesce("inside_ratio", F.lit(0.0)).alias("inside_ratio"))


# --- outlines of widened lines -------------------------------------------------------------------------


def pieces(lines: DataFrame, radius: float) -> DataFrame:
    """``lines`` (cluster_id, x0, y0, x1, y1) cut into pieces no longer than a tile."""
    side = radius / STEPS * TILE
    n = F.greatest(F.ceil(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / side), F.lit(1))
    at = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * (i / F.col("_n"))
    cut = lines.where("x0 is not null and y0 is not null and x1 is not null and y1 is not null").withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return cut.select("cluster_id", at("x0", "x1", F.col("_i")).alias("x0"), at("y0", "y1", F.col("_i")).alias("y0"), at("x0", "x1", F.col("_i") + 1).alias("x1"), at("y0", "y1", F.col("_i") + 1).alias("y1"))


def tiles(cut: DataFrame, radius: float) -> DataFrame:
    """Each piece with every tile (tx, ty) that its outline may reach."""
    step = radius / STEPS
    reach, side = radius + 2 * step, step * TILE
    span = lambda a, b: F.explode(F.sequence(F.floor((F.least(a, b) - reach) / side), F.floor((F.greatest(a, b) + reach) / side)))
    return cut.withColumn("tx", span("x0", "x1")).withColumn("ty", span("y0", "y1"))


def tile_outline(lines: np.ndarray, radius: float, tx: int, ty: int) -> tuple[float, float]:
    """(area, perimeter) in one tile of the union of lines widened by ``radius``.

    The distance to the lines is taken at the grid's corners; in each half cell it counts as linear.
    """
    step = radius / STEPS
    x = (tx * TILE + np.arange(TILE + 1)) * step
    y = ((ty * TILE + np.arange(TILE + 1)) * step)[:, None]
    far = np.full((TILE + 1, TILE + 1), (radius + 2 * step) ** 2)
    for a, b, c, d in lines:
        dx, dy = c - a, d - b
        k = np.clip(((x - a) * dx + (y - b) * dy) / max(dx * dx + dy * dy, 1e-300), 0, 1)
        np.minimum(far, (x - a - k * dx) ** 2 + (y - b - k * dy) ** 2, out=far)
    f = radius - np.sqrt(far)
    area = perimeter = 0.0
    half = step * step / 2
    f00, f10, f01, f11 = f[:-1, :-1], f[:-1, 1:], f[1:, :-1], f[1:, 1:]
    place = {"f00": (0, 0), "f10": (1, 0), "f01": (0, 1), "f11": (1, 1)}
    for names in (("f00", "f10", "f11"), ("f00", "f01", "f11")):
        values = [{"f00": f00, "f10": f10, "f01": f01, "f11": f11}[n].reshape(-1) for n in names]
        inside = [v > 0 for v in values]
        count = sum(i.astype(int) for i in inside)
        area += half * int((count == 3).sum())
        for odd in range(3):
            p, (q, s) = values[odd], [values[j] for j in range(3) if j != odd]
            (px, py), (qx, qy), (sx, sy) = (place[names[j]] for j in (odd, *[j for j in range(3) if j != odd]))
            for one in (True, False):  # the odd corner alone inside, or alone outside
                at = (count == (1 if one else 2)) & (inside[odd] == one)
                t, u = p[at] / (p[at] - q[at]), p[at] / (p[at] - s[at])
                corner = half * (t * u).sum()
                area += corner if one else half * int(at.sum()) - corner
                perimeter += step * np.hypot(t * (qx - px) - u * (sx - px), t * (qy - py) - u * (sy - py)).sum()
    return float(area), float(perimeter)


def outline(lines: DataFrame, radius: float) -> DataFrame:
    """(cluster_id, area, perimeter) of the union of each cluster's lines widened by ``radius``. A task has one tile at a time."""
    schema = f"cluster_id {dict(lines.dtypes)['cluster_id']}, area double, perimeter double"

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        area, perimeter = tile_outline(own[["x0", "y0", "x1", "y1"]].to_numpy(np.float64), radius, int(key[1]), int(key[2]))
        return pd.DataFrame({"cluster_id": [key[0]], "area": [area], "perimeter": [perimeter]})

    each = tiles(pieces(lines, radius), radius).groupBy("cluster_id", "tx", "ty").applyInPandas(run, schema)
    return each.groupBy("cluster_id").agg(F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter"))


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(order):
        out = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return half(points)[:-1] + half(reversed(points))[:-1]


def hull_figures(points: list[tuple[float, float]], radius: float) -> tuple[float, float]:
    """(hull_area, elongation) of points widened by ``radius``: the hull with a disk added, and its smallest rectangle's sides."""
    h = hull(points)
    edges = [(h[i], h[(i + 1) % len(h)]) for i in range(len(h))] if len(h) > 1 else []
    around = sum(math.dist(a, b) for a, b in edges)
    flat = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in edges)) / 2
    best = None
    for a, b in edges or [((0.0, 0.0), (1.0, 0.0))]:
        n = math.dist(a, b) or 1.0
        ux, uy = (b[0] - a[0]) / n, (b[1] - a[1]) / n
        along, across = [x * ux + y * uy for x, y in h], [-x * uy + y * ux for x, y in h]
        sides = (max(along) - min(along) + 2 * radius, max(across) - min(across) + 2 * radius)
        if best is None or sides[0] * sides[1] < best[0] * best[1]:
            best = sides
    return flat + around * radius + math.pi * radius**2, max(best) / max(min(best), EPS)


def hulls(lines: DataFrame, radius: float) -> DataFrame:
    """(cluster_id, hull_area, elongation); tasks send the hulls of their own points, so no task has all points of a cluster."""
    kind = dict(lines.dtypes)["cluster_id"]

    def ends(part: pd.DataFrame) -> list[tuple[float, float]]:
        return [*zip(part["x0"], part["y0"], strict=True), *zip(part["x1"], part["y1"], strict=True)]

    def own(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for part in parts:
            for cluster, some in part.groupby("cluster_id", dropna=False):
                held[cluster] = hull(held.get(cluster, []) + ends(some))
        yield pd.DataFrame([(c, x, y) for c, h in held.items() for x, y in h], columns=["cluster_id", "x0", "y0"])

    def whole(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        area, elongation = hull_figures(list(zip(part["x0"], part["y0"], strict=True)), radius)
        return pd.DataFrame({"cluster_id": [key[0]], "hull_area": [area], "elongation": [elongation]})

    known = lines.where("x0 is not null and y0 is not null and x1 is not null and y1 is not null").select("cluster_id", "x0", "y0", "x1", "y1")
    return known.mapInPandas(own, f"cluster_id {kind}, x0 double, y0 double").groupBy("cluster_id").applyInPandas(whole, f"cluster_id {kind}, hull_area double, elongation double")


def shapes(lines: DataFrame, radius: float = 50.0) -> DataFrame:
    """Shape figures of each cluster's lines (cluster_id, x0, y0, x1, y1) widened by ``radius``."""
    joined = outline(lines, radius).join(hulls(lines, radius), "cluster_id")
    root = F.sqrt("area")
    return joined.select(
        "cluster_id", "area", "perimeter", (4 * math.pi * F.col("area") / F.greatest(F.pow("perimeter", F.lit(2.0)), F.lit(EPS))).alias("compactness"), (F.col("area") / F.greatest("hull_area", F.lit(EPS))).alias("hull_ratio"), "elongation", (F.col("perimeter") / F.greatest(root, F.lit(EPS))).alias("perimeter_to_root_area")
    )


# --- polygons ------------------------------------------------------------------------------------------


def ring_area(ring: str = "ring"):
    """Area of a polygon column array<struct<x, y>>, closed or not; from its first corner, so that a far place costs no digits."""
    at = lambda i, c: F.get(F.col(ring), F.pmod(i, F.size(ring)))[c] - F.get(F.col(ring), 0)[c]
    turn = F.transform(F.sequence(F.lit(0), F.size(ring) - 1), lambda i: at(i, "x") * at(i + 1, "y") - at(i + 1, "x") * at(i, "y"))
    return F.abs(F.aggregate(turn, F.lit(0.0), lambda s, v: s + v)) / 2


def inside(px: str, py: str, ring: str = "ring"):
    """Whether a point is inside a polygon, by the number of edges to its right."""
    at = lambda i: F.get(F.col(ring), F.pmod(i, F.size(ring)))
    x, y = F.col(px), F.col(py)
    crosses = F.transform(
        F.sequence(F.lit(0), F.size(ring) - 1),
        lambda i: F.when((at(i)["y"] > y) != (at(i + 1)["y"] > y), (x < at(i)["x"] + (y - at(i)["y"]) / (at(i + 1)["y"] - at(i)["y"]) * (at(i + 1)["x"] - at(i)["x"])).cast("int")).otherwise(0),
    )
    return F.aggregate(crosses, F.lit(0), lambda s, v: s + v) % 2 == 1


def smallest_polygon(points: DataFrame, polygons: DataFrame, cell: float, steps: tuple[int, ...] = (32, 256)) -> DataFrame:
    """(point_id, poly_id, area) of the smallest polygon with each point inside, ties by id, else null.

    ``points``: (point_id, px, py); ``polygons``: (poly_id, ring). They meet by grid cells of side ``cell``.
    Areas that agree to nine digits are equal: the rest of a computed area depends on where its polygon lies.
    Places are looked up, not points, and of equal rings the one of least id. A place meets the 32 smallest polygons of
    its cell first; one that is in none of them goes on to the 256 smallest, then to all the others.
    """
    ends = {f"{c}{n}": f(f"ring.{c}") for c in "xy" for n, f in ((0, F.array_min), (1, F.array_max))}
    span = lambda c: F.explode(F.sequence(F.floor(F.col(f"{c}0") / cell), F.floor(F.col(f"{c}1") / cell)))
    rings = polygons.where(F.size("ring") > 2).groupBy("ring").agg(F.min(F.struct("poly_id")).alias("p")).select("p.poly_id", "ring")
    sized = rings.withColumn("area", ring_area()).withColumns({"size": F.format_string("%.8e", "area").try_cast("double"), **ends})
    order = Window.partitionBy("cx", "cy").orderBy("size", "poly_id", "area")
    placed = cut(sized.withColumn("cx", span("x")).withColumn("cy", span("y")).withColumn("rank", F.row_number().over(order)))
    left, found, low = points.where("px is not null and py is not null").select("px", "py").distinct(), None, 0
    for high in (*steps, None):
        some = placed.where(F.col("rank") > low) if high is None else placed.where((F.col("rank") > low) & (F.col("rank") <= high))
        located = left.withColumns({"cx": F.floor(F.col("px") / cell), "cy": F.floor(F.col("py") / cell)})
        boxed = located.join(some, ["cx", "cy"]).where("px >= x0 and px <= x1 and py >= y0 and py <= y1")
        best = cut(boxed.where(inside("px", "py")).groupBy("px", "py").agg(F.min(F.struct("size", "poly_id", "area")).alias("b")))
        found = best if found is None else found.union(best)
        left, low = left.join(best, ["px", "py"], "left_anti"), high
    each = points.join(found, ["px", "py"]).groupBy("point_id").agg(F.min("b").alias("b"))
    return points.select("point_id").join(each, "point_id", "left").select("point_id", "b.poly_id", "b.area")


def polygonize(lines: np.ndarray, digits: int = 6) -> list[np.ndarray]:
    """The bounded faces that straight lines (x0, y0, x1, y1) make, as rings in order; lines are parted where they cross.

    A kernel for one boundary's lines: crossings are looked for among all pairs, line by line.
    """
    cuts = []
    for i, (x0, y0, x1, y1) in enumerate(lines):
        dx, dy = x1 - x0, y1 - y0
        ax, ay, bx, by = np.delete(lines, i, axis=0).T
        ex, ey = bx - ax, by - ay
        den = dx * ey - dy * ex
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = ((ax - x0) * ey - (ay - y0) * ex) / den, ((ax - x0) * dy - (ay - y0) * dx) / den
            square = dx * dx + dy * dy
            ends = [((x - x0) * dx + (y - y0) * dy) / square for x, y in ((ax, ay), (bx, by))]  # of lines on the same line
            on = [np.abs((x - x0) * dy - (y - y0) * dx) <= 1e-9 * max(square, 1) for x, y in ((ax, ay), (bx, by))]
        at = np.concatenate([t[(den != 0) & (t > 0) & (t < 1) & (u >= -1e-12) & (u <= 1 + 1e-12)], *(e[o & (e > 0) & (e < 1)] for e, o in zip(ends, on, strict=True)), [0.0, 1.0]])
        at = np.unique(at)
        cuts += list(zip(np.round(x0 + at[:-1] * dx, digits), np.round(y0 + at[:-1] * dy, digits), np.round(x0 + at[1:] * dx, digits), np.round(y0 + at[1:] * dy, digits), strict=True))
    near: dict[tuple, set[tuple]] = {}
    for x0, y0, x1, y1 in cuts:
        if (x0, y0) != (x1, y1):
            near.setdefault((x0, y0), set()).add((x1, y1))
            near.setdefault((x1, y1), set()).add((x0, y0))
    loose = [p for p, n in near.items() if len(n) == 1]
    while loose:  # lines that end in nothing bound no face
        p = loose.pop()
        for q in near.pop(p, ()):
            near[q].discard(p)
            if len(near[q]) == 1:
                loose.append(q)
    around = {p: sorted(n, key=lambda q: math.atan2(q[1] - p[1], q[0] - p[0])) for p, n in near.items() if n}  # noqa: B023
    left = {(p, q) for p, n in around.items() for q in n}
    faces = []
    while left:
        p, q = min(left)
        ring = []
        while (p, q) in left:
            left.discard((p, q))
            ring.append(p)
            p, q = q, around[q][around[q].index(p) - 1]  # the next line clockwise from where we came
        face = np.array(ring)
        if len(face) > 2 and (face[:, 0] * np.roll(face[:, 1], -1) - np.roll(face[:, 0], -1) * face[:, 1]).sum() > 0:
            faces.append(face)
    return faces


def _area(ring: np.ndarray) -> float:
    return abs(float((ring[:, 0] * np.roll(ring[:, 1], -1) - np.roll(ring[:, 0], -1) * ring[:, 1]).sum())) / 2


def _has(ring: np.ndarray, x: float, y: float) -> bool:
    a, b = ring, np.roll(ring, -1, axis=0)
    crosses = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        return bool((crosses & (x < a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0]))).sum() % 2)


def boundary_polygon(lines: np.ndarray, centre: tuple[float, float], box: tuple[float, float, float, float], corridor: float) -> np.ndarray:
    """The smallest face of ring lines with the centre inside.

    If the lines do not close, what of the box (x0, y0, x1, y1) is over ``corridor`` away from them and around the
    centre, to a quarter of the corridor; without such a part that is an error.
    """
    found = [f for f in polygonize(lines) if _has(f, *centre)]
    if found:
        return min(found, key=_area)
    step = corridor / 4
    x0, y0, x1, y1 = box
    nx, ny = max(1, int((x1 - x0) // step)), max(1, int((y1 - y0) // step))
    x, y = x0 + (np.arange(nx) + 0.5) * step, (y0 + (np.arange(ny) + 0.5) * step)[:, None]
    free = np.ones((ny, nx), dtype=bool)
    for a, b, c, d in lines:
        k = np.clip(((x - a) * (c - a) + (y - b) * (d - b)) / max((c - a) ** 2 + (d - b) ** 2, 1e-300), 0, 1)
        free &= (x - a - k * (c - a)) ** 2 + (y - b - k * (d - b)) ** 2 > corridor**2
    at = int((centre[1] - y0) // step), int((centre[0] - x0) // step)
    if not (0 <= at[0] < ny and 0 <= at[1] < nx and free[at]):
        raise ValueError("no part of the box holds the centre")
    region, size = np.zeros_like(free), 0
    region[at] = True
    while int(region.sum()) != size:  # grow along rows and columns as far as it is free
        size = int(region.sum())
        for axis in (0, 1):
            for turn in (slice(None), slice(None, None, -1)):
                r, f = (np.swapaxes(z, 0, axis)[turn] for z in (region, free))
                for i in range(1, len(r)):
                    r[i] |= r[i - 1] & f[i]
    padded = np.pad(region, 1)
    sides = [(x0 + j * step, y0 + i * step, x0 + (j + 1) * step, y0 + i * step) for i, j in zip(*np.nonzero(padded[1:, 1:-1] != padded[:-1, 1:-1]), strict=True)]
    sides += [(x0 + j * step, y0 + i * step, x0 + j * step, y0 + (i + 1) * step) for i, j in zip(*np.nonzero(padded[1:-1, 1:] != padded[1:-1, :-1]), strict=True)]
    return _outer(sides, centre)


def _outer(sides: list[tuple[float, float, float, float]], centre: tuple[float, float]) -> np.ndarray:
    """The smallest ring around the centre among unit sides, which meet at their ends alone."""
    near: dict[tuple, list[tuple]] = {}
    for a, b, c, d in sides:
        p, q = (round(a, 6), round(b, 6)), (round(c, 6), round(d, 6))
        near.setdefault(p, []).append(q)
        near.setdefault(q, []).append(p)
    rings = []
    while near:
        start = min(near)
        ring, p = [], start
        while p in near:
            q = near[p].pop(0)
            near[q].remove(p)
            for z in (p, q):
                if z in near and not near[z]:
                    del near[z]
            ring.append(p)
            p = q
        rings.append(np.array(ring))
    found = [r for r in rings if len(r) > 2 and _has(r, *centre)]
    if not found:
        raise ValueError("no part of the box holds the centre")
    return min(found, key=_area)
