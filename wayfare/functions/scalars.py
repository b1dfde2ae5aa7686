"""Scalar functions as Column expressions. Undefined results are null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPS = 1e-9


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slot_floor(ts: Column | str, minutes: int) -> Column:
    """The start of the epoch-aligned slot that holds a timestamp without zone."""
    if minutes <= 0:
        raise ValueError("slot minutes must be positive")
    zero = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    micros = F.timestamp_diff("MICROSECOND", zero, col(ts))
    return F.timestamp_add("MICROSECOND", micros - F.pmod(micros, F.lit(minutes * 60_000_000)), zero)


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Seconds from start to end with their fraction."""
    return F.timestamp_diff("MICROSECOND", col(start), col(end)) / F.lit(1e6)


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, null where the denominator is next to nothing."""
    return F.when(F.abs(col(den)) > EPS, col(num) / col(den))


def truth(value: Column | str) -> Column:
    """Boolean from text: true, 1 and yes in any case; null and all else, 1.0 included, are false."""
    return F.coalesce(F.lower(col(value).cast("string")).isin("true", "1", "yes"), F.lit(False))


def nonempty(name: Column | str) -> Column:
    return F.coalesce(F.trim(col(name)) != "", F.lit(False))


def road_name(name: Column | str) -> Column:
    """Trimmed, without spaces; null becomes empty."""
    return F.coalesce(F.replace(F.trim(col(name)), F.lit(" "), F.lit("")), F.lit(""))


def name_matches(name: Column, include: list[str], exclude: list[str] = ()) -> Column:
    """Whether a road name has one of ``include`` in it and none of ``exclude``."""
    hit, miss = F.lit(False), F.lit(False)
    for x in include:
        hit = hit | name.contains(x)
    for x in exclude:
        miss = miss | name.contains(x)
    return hit & ~miss


def bearing(dx: Column, dy: Column) -> Column:
    """Direction of an undirected line in degrees, 0 to under 180."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))


def angle_between(a: Column | str, b: Column | str) -> Column:
    """Difference of two bearings folded to 0..90; null if either is."""
    d = F.pmod(F.abs(col(a) - col(b)), F.lit(180.0))
    return F.least(d, F.lit(180.0) - d)


def continuity(a: str, b: str, name: float = 2.0, osmid: float = 1.5, highway: float = 0.5, angle: float = 1.0, max_angle: float = 35.0) -> Column:
    """Score of two segments (column prefixes ``a``, ``b``) being one road: equal non-empty name, id, class, and like bearing."""
    same = lambda c: F.coalesce((F.col(f"{a}_{c}") == F.col(f"{b}_{c}")) & (F.col(f"{a}_{c}").cast("string") != ""), F.lit(False))
    part = lambda test, gain: F.when(test, F.lit(float(gain))).otherwise(0.0)
    near = F.coalesce(angle_between(f"{a}_bearing", f"{b}_bearing") <= max_angle, F.lit(False))
    return part(same("name"), name) + part(same("osmid"), osmid) + part(same("highway"), highway) + part(near, angle)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays of doubles; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(col(x), col(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def signed_log(values: Column | str) -> Column:
    """sign(x) * log(1 + |x|) of each element."""
    return F.transform(col(values), lambda x: F.signum(x) * F.log1p(F.abs(x)))


def inverse_difference(a: Column | str, b: Column | str, scale: Column | float) -> Column:
    """1 - |a - b| / scale, at least 0."""
    return F.greatest(F.lit(0.0), 1 - F.abs(col(a) - col(b)) / (F.lit(scale) if isinstance(scale, float) else scale))


def capacity_hinge(value: Column | str, target: Column | str, low: float = 0.5, high: float = 1.5) -> Column:
    """Squared distance of value / target from the band [low, high]; 0 without a target."""
    share = ratio(value, target)
    short, over = F.greatest(F.lit(low) - share, F.lit(0.0)), F.greatest(share - F.lit(high), F.lit(0.0))
    return F.coalesce(short * short + over * over, F.lit(0.0))


def setting_label(value: Column | str) -> Column:
    """A number as part of a label: 1.0 becomes 1p0."""
    return F.replace(F.replace(col(value).cast("string"), F.lit("."), F.lit("p")), F.lit("-"), F.lit("m"))


def utm_xy(lon: Column | str, lat: Column | str, zone: int = 50) -> tuple[Column, Column]:
    """WGS 84 degrees to UTM metres, northern hemisphere, by the Krüger series to third order."""
    n = 1 / 298.257223563 / (2 - 1 / 298.257223563)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3)
    e = 2 * n**0.5 / (1 + n)
    phi, lam = F.radians(col(lat)), F.radians(col(lon) - F.lit(zone * 6 - 183.0))
    s = F.sin(phi)
    atanh = lambda x: F.log((1 + x) / (1 - x)) / 2
    t = F.sinh(atanh(s) - F.lit(e) * atanh(F.lit(e) * s))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(0.9996 * radius) * x + F.lit(500000.0), F.lit(0.9996 * radius) * y
