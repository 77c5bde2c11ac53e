"""Column expressions: units, bearings, geodesy, weather rules and report fields.

Nothing here touches rows in Python; every function maps columns to columns. Missing input gives
null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit factors, reference pressure and pressure altitude step, sphere radius in NM.
NM_M, FT_M, KT_MS, FPM_MS, SM_M = 1852.0, 0.3048, 0.514444, 0.00508, 1609.344
ISA_HPA, M_PER_HPA = 1013.25, 8.2296
EARTH_NM = 3440.065
# WGS-84 ellipsoid.
WGS_A, WGS_F = 6378137.0, 1 / 298.257223563


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def no_nan(c: str | Column) -> Column:
    """NaN as null, so that comparisons and means skip it."""
    return F.nanvl(F.col(c) if isinstance(c, str) else c, F.lit(None).cast("double"))


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def turn(a: Column, b: Column) -> Column:
    """Signed difference a - b of two bearings, -180 up to 180."""
    return F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0


def circular_mean(degrees: Column) -> Column:
    """Mean direction of a group, by the mean unit vector."""
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees))))), F.lit(360.0))


def along_across(x: Column, y: Column, x0: Column, y0: Column, ux: Column, uy: Column) -> tuple[Column, Column]:
    """Offsets of a point along the axis (ux, uy) from (x0, y0), and to its left."""
    dx, dy = x - x0, y - y0
    return dx * ux + dy * uy, dy * ux - dx * uy


def best_altitude(gnss: Column, pressure: Column, qnh: Column) -> Column:
    """Satellite altitude, else pressure altitude corrected by the local pressure (standard if unknown)."""
    return F.coalesce(gnss, pressure + (F.coalesce(qnh, F.lit(ISA_HPA)) - ISA_HPA) * M_PER_HPA)


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_NM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def within_radius(lat: Column, lon: Column, lat0: float, lon0: float, nm: float) -> Column:
    """Great-circle test behind a box that a scan can push down."""
    reach = nm / 60 + 1e-6
    box = lat.between(lat0 - reach, lat0 + reach)
    return box & (haversine_nm(F.lit(lat0), F.lit(lon0), lat, lon) <= nm)


def meridian_radius(lat: Column) -> tuple[Column, Column]:
    """Radii of curvature of the ellipsoid along the meridian and across it."""
    e2 = WGS_F * (2 - WGS_F)
    w = F.sqrt(1 - e2 * F.pow(F.sin(F.radians(lat)), 2))
    return F.lit(WGS_A * (1 - e2)) / F.pow(w, 3), F.lit(WGS_A) / w


def to_local(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """East and north metres around (lat0, lon0): a local azimuthal plane good to metres within 60 km."""
    m, _ = meridian_radius((lat + lat0) / 2)
    _, n = meridian_radius(lat)
    dlon = F.radians(lon - lon0)
    east = n * F.cos(F.radians(lat)) * F.sin(dlon)
    north = m * F.radians(lat - lat0) + n * F.cos(F.radians(lat)) * F.sin(F.radians(lat)) * (1 - F.cos(dlon))
    return east, north


def from_local(east: Column, north: Column, lat0: float, lon0: float, rounds: int = 4) -> tuple[Column, Column]:
    """Inverse of to_local, by fixed-point steps unrolled into the expression."""
    lat, lon = F.lit(lat0) + F.degrees(north / WGS_A), F.lit(lon0) + F.degrees(east / (WGS_A * F.cos(F.radians(F.lit(lat0)))))
    for _ in range(rounds):
        e, n = to_local(lat, lon, lat0, lon0)
        lat, lon = lat + F.degrees((north - n) / WGS_A), lon + F.degrees((east - e) / (WGS_A * F.cos(F.radians(lat))))
    return lat, lon


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def flight_rule(visibility_sm: Column, ceiling_ft: Column) -> Column:
    """Worst class that either measure asks for; empty if both are missing."""
    v, c = F.coalesce(visibility_sm, F.lit(1e9)), F.coalesce(ceiling_ft, F.lit(1e9))
    found = F.when((v < 1) | (c < 500), "LIFR").when((v < 3) | (c < 1000), "IFR").when((v < 5) | (c < 3000), "MVFR").otherwise("VFR")
    return F.when(visibility_sm.isNull() & ceiling_ft.isNull(), "").otherwise(found)


def instrument_weather(visibility_sm: Column, ceiling_ft: Column, rule: Column) -> Column:
    """Under five kilometres, under a thousand feet, or a rule that says so; unknown counts as clear."""
    tests = (visibility_sm < 5 / 1.609, ceiling_ft < 1000, rule.isin("IFR", "LIFR"))
    return F.greatest(*(F.coalesce(t, F.lit(False)) for t in tests))


def number(text: Column) -> Column:
    """A number or null; empty text is null."""
    return F.nullif(text, F.lit("")).try_cast("double")


def report_fields(raw: Column) -> dict[str, Column]:
    """Fields of a weather report line: wind, visibility, temperatures, pressure, ceiling."""
    padded = F.concat(F.lit(" "), raw, F.lit(" "))
    wind = r" (VRB|\d{3})(\d{2,3})(?:G(\d{2,3}))?KT "
    mixed, fraction, whole = r" (\d+) (\d+)/(\d+)SM ", r" M?(\d+)/(\d+)SM ", r" M?(\d+)SM "

    def group(pattern: str, k: int) -> Column:
        return number(F.regexp_extract(padded, pattern, k))

    def celsius(k: int) -> Column:
        return number(F.regexp_replace(F.regexp_extract(padded, r" (M?\d{2})/(M?\d{2}) ", k), "M", "-"))

    layers = F.regexp_extract_all(padded, F.lit(r"(?:BKN|OVC|VV)(\d{3})"), F.lit(1))
    inches, hectopascals = group(r" A(\d{4}) ", 1), group(r" Q(\d{4}) ", 1)
    return {
        "wind_dir_deg": F.regexp_extract(padded, wind, 1).try_cast("double"),
        "wind_kt": group(wind, 2),
        "wind_gust_kt": group(wind, 3),
        "vis_sm": F.coalesce(group(mixed, 1) + group(mixed, 2) / group(mixed, 3), group(fraction, 1) / group(fraction, 2), group(whole, 1)),
        "temp_c": celsius(1),
        "dewpoint_c": celsius(2),
        "altim_hpa": F.coalesce(inches / 100 * 33.8639, hectopascals),
        "ceiling_ft": F.array_min(F.transform(layers, lambda s: s.cast("double") * 100)),
    }


def config_label(arrivals: Column, departures: Column) -> Column:
    """ARR:a+b|DEP:c of two lists of runway ends; UNKNOWN if both are empty."""
    parts = [F.when(F.size(c) > 0, F.concat(F.lit(name), F.array_join(c, "+"))) for name, c in (("ARR:", arrivals), ("DEP:", departures))]
    return F.coalesce(F.nullif(F.concat_ws("|", *parts), F.lit("")), F.lit("UNKNOWN"))


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a value on a circle; 0, 0 where it is missing."""
    angle = value * (2 * 3.141592653589793 / period)
    return F.coalesce(F.sin(angle), F.lit(0.0)), F.coalesce(F.cos(angle), F.lit(0.0))


def uniform(*key: Column | str, salt: int = 0) -> Column:
    """A number in [0, 1) that depends on the key alone, so samples do not depend on partitions."""
    return F.pmod(F.xxhash64(F.lit(salt), *key), F.lit(1 << 30)) / float(1 << 30)


#: Quadratic steps modulo a prime, 2**31 - 1, as linear ones would leave draws of neighbouring keys in line; all products fit a long.
DRAW_PRIME, DRAW_FACTOR = 2_147_483_647, 48_271


def draw(*key: Column | str, salt: int = 0) -> Column:
    """As uniform, by whole-number arithmetic that any engine can repeat; keys are whole numbers from 0 up to 2**31."""
    seed = F.lit(salt * 15_485_863 + 1).cast("long")
    for k, part in enumerate(key):
        seed = (seed + (F.col(part) if isinstance(part, str) else part) * (40_503 + 1_299_709 * k)) % DRAW_PRIME
        for _ in range(2):
            seed = (seed * seed % DRAW_PRIME + seed * DRAW_FACTOR + 12_345) % DRAW_PRIME
    return seed / float(DRAW_PRIME)


def draw_sql(*key: str, salt: int = 0) -> str:
    """draw, as SQL."""
    seed = f"{salt * 15_485_863 + 1}::bigint"
    for k, part in enumerate(key):
        seed = f"(({seed} + {part} * {40_503 + 1_299_709 * k}) % {DRAW_PRIME})"
        for _ in range(2):
            seed = f"(({seed} * {seed} % {DRAW_PRIME} + {seed} * {DRAW_FACTOR} + 12345) % {DRAW_PRIME})"
    return f"({seed} / {DRAW_PRIME}.0::double)"
