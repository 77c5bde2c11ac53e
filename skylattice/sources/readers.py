"""Scans: typed readers and line parsers that give normalised columns. NaN becomes null here."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators.joins import interval_overlay

STATE_FIELDS = {"time_utc": "timestamp", "icao24": "string", "callsign": "string", "lon_wgs": "float", "lat_wgs": "float", "baro_alt_m": "float", "geo_alt_m": "float", "velocity_ms": "float", "track_deg": "float", "vert_rate_ms": "float", "on_ground": "boolean"}


def state_vectors(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """State vectors of parquet files; keys lower-cased, NaN as null. A missing column is an error."""
    found = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if missing := set(STATE_FIELDS) - set(found.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    numbers = [c for c, t in STATE_FIELDS.items() if t == "float"]
    return found.select(*(F.nanvl(c, F.lit(None).cast("float")).alias(c) if c in numbers else F.lower(F.trim(c)).alias(c) if c == "icao24" else F.col(c).cast(STATE_FIELDS[c]).alias(c) for c in STATE_FIELDS))


def day_window(spec: str, year_month: str | None = None) -> list[str]:
    """Days of 'A..B', a comma list, one day, or the Fridays of a month 'YYYY-MM'."""
    if ".." in spec:
        a, b = (date.fromisoformat(x.strip()) for x in spec.split(".."))
        return [(a + timedelta(k)).isoformat() for k in range((b - a).days + 1)]
    if len(spec) == 7:
        day, out = date.fromisoformat(spec + "-01"), []
        while day.isoformat().startswith(spec):
            out += [day.isoformat()] if day.weekday() == 4 else []
            day += timedelta(1)
        return out
    return [date.fromisoformat(x.strip()).isoformat() for x in spec.split(",")]


TRACE = "icao string, r string, timestamp double, trace array<array<string>>"


def trace_lines(lines: DataFrame, value: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Points of trace documents, one JSON text a row. Corrupt texts give no rows.

    box (lat0, lat1, lon0, lon1): an aircraft is kept if any of its points lies in it, tested before
    its points are unpacked; then only the points inside stay."""
    doc = lines.select(F.from_json(value, TRACE, {"mode": "PERMISSIVE"}).alias("d")).where("d.icao is not null and d.trace is not null")
    lat, lon = (lambda p: F.get(p, F.lit(1)).try_cast("double")), (lambda p: F.get(p, F.lit(2)).try_cast("double"))

    def inside(p: Column) -> Column:
        return lat(p).between(box[0], box[1]) & lon(p).between(box[2], box[3])

    if box:
        doc = doc.where(F.exists("d.trace", inside))
    points = doc.select(F.lower("d.icao").alias("icao24"), F.col("d.timestamp").alias("t0"), F.posexplode("d.trace").alias("k", "p"))
    points = points.where(inside(F.col("p"))) if box else points
    ground = F.get("p", F.lit(3)) == "ground"

    def part(k: int) -> Column:
        return F.get("p", F.lit(k)).try_cast("double")

    return points.select(
        "icao24", F.timestamp_micros(((F.col("t0") + part(0)) * 1_000_000).cast("long")).alias("time_utc"), lat(F.col("p")).alias("lat_wgs"), lon(F.col("p")).alias("lon_wgs"),
        F.when(~ground, part(3) * X.FT_M).alias("baro_alt_m"), (part(4) * X.KT_MS).alias("velocity_ms"), part(5).alias("track_deg"), (part(7) * X.FPM_MS).alias("vert_rate_ms"), F.coalesce(ground, F.lit(False)).alias("on_ground"),
    )


def trace_archives(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Points of traces in tar files of gzipped JSON members; unreadable members are skipped, a cut-off archive gives what it has."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip
        import io
        import tarfile
        import zlib

        for batch in batches:
            for content in batch["content"]:
                texts: list[str] = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as archive:
                        for member in archive:
                            body = archive.extractfile(member) if member.isfile() else None
                            if body is None:
                                continue
                            raw = body.read()
                            try:
                                texts.append((gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode())
                            except (OSError, EOFError, zlib.error, UnicodeDecodeError):
                                continue
                except (tarfile.TarError, EOFError, OSError):
                    pass
                for k in range(0, len(texts), 64):
                    yield pd.DataFrame({"value": texts[k : k + 64]})

    files = spark.read.format("binaryFile").load(path).select("content")
    return trace_lines(files.mapInPandas(members, "value string"), "value", box)


# Layout of the obstacle file (first column and length, 1-based), and its lighting codes.
OBSTACLE_LAYOUT = {"id": (1, 9), "lat": (36, 12), "lon": (49, 13), "type": (63, 18), "agl": (84, 5), "msl": (90, 5), "h": (98, 1), "v": (100, 1), "mark": (102, 1)}
LIGHTING = {"R": "red lights", "D": "dual white", "H": "dual red", "M": "strobe white", "S": "strobe red", "F": "flood", "C": "dual strobe", "W": "synchronized", "L": "lighted", "N": "none", "U": "unknown"}
OBSTACLE_CSV = {"obstacle_id": ("OAS", "OAS_NUMBER", "OBSTACLE"), "lat": ("LATDEC", "LAT", "LATITUDE"), "lon": ("LONDEC", "LON", "LONGITUDE"), "kind": ("TYPE", "TYPE_CODE"), "agl_ft": ("AGL",), "msl_ft": ("AMSL", "MSL"), "lighting": ("LIGHTING",)}


def degrees_of(text: Column) -> Column:
    """DD MM SS.ssH as signed degrees; null if it is not that."""
    pattern = r"(\d+)[\s-]+(\d+)[\s-]+([\d.]+)\s*([NSEW])"
    part = [F.nullif(F.regexp_extract(text, pattern, k), F.lit("")) for k in range(1, 5)]
    size = part[0].try_cast("double") + part[1].try_cast("double") / 60 + part[2].try_cast("double") / 3600
    return F.when(part[3].isin("S", "W"), -size).otherwise(size)


def obstacle_lines(lines: DataFrame, layout: dict[str, tuple[int, int]], value: str = "value") -> DataFrame:
    """Obstacles of fixed-width lines; lines that do not begin with an id (headers) are skipped."""
    cut = {k: F.trim(F.substring(value, a, n)) for k, (a, n) in layout.items()}
    codes = F.create_map(*(F.lit(x) for kv in LIGHTING.items() for x in kv))
    kept = [c for c in lines.columns if c != value]
    return lines.where(F.col(value).rlike(r"^[A-Z0-9]{2}-?\d{5,}")).select(
        *kept, cut["id"].alias("obstacle_id"), degrees_of(cut["lat"]).alias("lat"), degrees_of(cut["lon"]).alias("lon"), cut["type"].alias("kind"),
        (cut["agl"].try_cast("double") * X.FT_M).alias("agl_m"), (cut["msl"].try_cast("double") * X.FT_M).alias("msl_m"), cut["h"].alias("h_accuracy"), cut["v"].alias("v_accuracy"), F.try_element_at(codes, cut["mark"]).alias("lighting"),
    )


def first_of(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of several columns that df has, whatever its case; null if it has none."""
    by = {c.upper(): c for c in df.columns}
    found = [F.col(f"`{by[n.upper()]}`") for n in names if n.upper() in by]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def obstacles(spark: SparkSession, path: str) -> DataFrame:
    """Obstacles of a delimited or fixed-width file, told by its first lines."""
    head = [r["value"] for r in spark.read.text(path).limit(5).collect()]
    if not any(line.count(",") > 4 for line in head):
        return obstacle_lines(spark.read.text(path), OBSTACLE_LAYOUT)
    csv = spark.read.option("header", True).csv(path)
    c = {k: first_of(csv, names) for k, names in OBSTACLE_CSV.items()}
    return csv.select(c["obstacle_id"].alias("obstacle_id"), c["lat"].try_cast("double").alias("lat"), c["lon"].try_cast("double").alias("lon"), c["kind"].alias("kind"), (c["agl_ft"].try_cast("double") * X.FT_M).alias("agl_m"), (c["msl_ft"].try_cast("double") * X.FT_M).alias("msl_m"), c["lighting"].alias("lighting"))


def weather_lines(lines: DataFrame, raw: str) -> DataFrame:
    """lines with the fields of its raw report texts and the flight rule."""
    found = lines.withColumns(X.report_fields(F.col(raw)))
    return found.withColumn("flight_rule", X.flight_rule(F.col("vis_sm"), F.col("ceiling_ft")))


TIME_NAMES = ("time_utc", "valid", "obsTime", "reportTime", "receiptTime", "observation_time")
WEATHER_NAMES = {"station_id": ("station_id", "station", "icaoId"), "wind_dir_deg": ("wind_dir_deg", "drct", "wdir"), "wind_kt": ("wind_kt", "sknt", "wspd"), "wind_gust_kt": ("wind_gust_kt", "gust", "wgst"), "vis_sm": ("vis_sm", "visibility_sm", "vsby", "visib"), "temp_c": ("temp_c", "temp"), "ceiling_ft": ("ceiling_ft", "ceiling"), "raw": ("raw", "metar", "rawOb")}


def weather_table(df: DataFrame) -> DataFrame:
    """Weather rows of any known naming; times may be texts or epoch seconds. Fields that are missing come from the raw text."""
    time = first_of(df, TIME_NAMES).cast("string")
    when = F.coalesce(F.timestamp_seconds(time.try_cast("double")), F.try_to_timestamp(time))
    cols = {k: first_of(df, names) for k, names in WEATHER_NAMES.items()}
    texts = ("station_id", "raw")
    rows = df.select(when.alias("time_utc"), *(c.cast("string").alias(k) if k in texts else c.cast("string").try_cast("double").alias(k) for k, c in cols.items()))
    parsed = X.report_fields(F.col("raw"))
    filled = rows.withColumns({k: F.coalesce(X.no_nan(k), parsed[k]) for k in rows.columns if k in parsed})
    filled = filled.withColumns({k: parsed[k] for k in ("dewpoint_c", "altim_hpa")})
    return filled.withColumn("flight_rule", X.flight_rule(F.col("vis_sm"), F.col("ceiling_ft"))).where("time_utc is not null").dropDuplicates(["station_id", "time_utc"])


def weather_archive(spark: SparkSession, path: str) -> DataFrame:
    """Archive CSV with comment lines and M for missing."""
    return weather_table(spark.read.option("header", True).option("comment", "#").option("nullValue", "M").csv(path))


FORECAST = "array<struct<icaoId:string,issueTime:string,validTimeFrom:bigint,validTimeTo:bigint,fcsts:array<struct<timeFrom:bigint,timeTo:bigint,timeBec:bigint,fcstChange:string,probability:int,wdir:string,wspd:int,wgst:int,visib:string,clouds:array<struct<cover:string,base:int>>>>>>"
#: Which change group counts where several of one forecast hold: passing ones over lasting ones over the first group.
GROUP_RANK = {"BASE": 0, "FM": 1, "BECMG": 1, "TEMPO": 2, "PROB": 2}


def forecast_groups(lines: DataFrame, value: str) -> DataFrame:
    """Change groups of terminal forecasts (JSON documents of one forecast or a list): when each holds, its wind, visibility,
    ceiling and flight rule. The first group is BASE; a becoming group holds from the end of its change. What a group
    does not say is null; groups that do not end after they begin, and texts that do not parse, give no rows."""
    docs = lines.select(F.inline(F.from_json(value, FORECAST))).where("icaoId is not null")
    groups = docs.select(F.trim("icaoId").alias("station"), F.to_timestamp("issueTime").alias("issued"), F.posexplode("fcsts").alias("group_no", "g"))
    kind = F.when(F.col("g.fcstChange").isNull() & (F.col("group_no") == 0), "BASE").otherwise(F.regexp_extract(F.coalesce("g.fcstChange", F.lit("FM")), r"^(FM|BECMG|TEMPO|PROB)", 1))
    begin = F.when(kind == "BECMG", F.coalesce("g.timeBec", "g.timeFrom")).otherwise(F.col("g.timeFrom"))
    visible = F.regexp_extract("g.visib", r"^([\d.]+)", 1).try_cast("double")
    ceiling = F.array_min(F.transform(F.filter("g.clouds", lambda c: c["cover"].isin("BKN", "OVC", "OVX", "VV")), lambda c: c["base"])).cast("double")
    found = groups.select(
        "station", "issued", "group_no", kind.alias("kind"), F.timestamp_seconds(begin).alias("valid_from"), F.timestamp_seconds("g.timeTo").alias("valid_to"), F.col("g.probability").alias("probability"),
        F.col("g.wdir").try_cast("double").alias("wind_dir_deg"), F.col("g.wspd").cast("double").alias("wind_kt"), F.col("g.wgst").cast("double").alias("wind_gust_kt"), visible.alias("vis_sm"), ceiling.alias("ceiling_ft"),
    )
    return found.where("valid_to > valid_from and kind <> ''").withColumn("flight_rule", X.flight_rule(F.col("vis_sm"), F.col("ceiling_ft")))


def forecast_timeline(groups: DataFrame, width: int = 6 * 3_600_000_000) -> DataFrame:
    """(station, from_us, to_us, kind, ..): at every moment the change group that counts: of the latest forecast, passing groups
    over lasting ones, the later begun over the earlier. groups: forecast_groups, or its columns station, issued, group_no,
    kind, from_us, to_us and what else is to be carried; an unknown kind counts as BASE."""
    if "from_us" not in groups.columns:
        groups = groups.withColumns({n: X.micros(c) for n, c in (("from_us", "valid_from"), ("to_us", "valid_to"), ("issued", "issued"))}).drop("valid_from", "valid_to")
    ranks = F.create_map(*(F.lit(x) for kv in GROUP_RANK.items() for x in kv))
    ranked = groups.withColumns({"__kind": F.coalesce(F.try_element_at(ranks, F.col("kind")), F.lit(0)), "__from": F.col("from_us")})
    carried = [c for c in groups.columns if c not in ("station", "from_us", "to_us")]
    return interval_overlay(ranked, ["station"], "from_us", "to_us", ["issued", "__kind", "__from", "group_no"], carried, width)


MARKET_NAMES = {"itin_id": ("ItinID", "bigint"), "origin": ("Origin", "string"), "dest": ("Dest", "string"), "reporting_carrier": ("Reporting_Airline,RPCarrier,TkCarrier", "string"), "passengers": ("Passengers", "double"), "market_fare": ("MktFare", "float"), "market_distance": ("MktDistance", "float"), "quarter": ("Quarter", "tinyint"), "year": ("Year", "smallint")}


def markets(spark: SparkSession, path: str, airports: list[str]) -> DataFrame:
    """Passenger markets that begin or end at the airports; numbers that do not parse are null."""
    csv = spark.read.option("header", True).csv(path)
    typed = csv.select(*(first_of(csv, tuple(names.split(","))).try_cast(kind).alias(k) for k, (names, kind) in MARKET_NAMES.items()))
    return typed.withColumn("passengers", F.col("passengers").cast("int")).where(F.col("origin").isin(airports) | F.col("dest").isin(airports))


CORRIDOR = "feasible boolean, baseline string, vertiport_pair array<string>, date string, hour int, time_s double, energy_j double, risk_integral double, noise_integral double, capacity_impact double, total_cost double, length_m double, n_expansions bigint, n_waypoints int, source string"


def corridors(spark: SparkSession, folder: str) -> DataFrame:
    """Corridor results below a folder, one JSON document a file; the file stem is the key."""
    found = spark.read.schema(CORRIDOR).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).json(folder)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return found.select(stem.alias("corridor_id"), *found.columns).where("baseline is not null")


def buildings(lines: DataFrame, value: str) -> DataFrame:
    """Ways of map extracts as closed polygons, with centroid, area in square degrees, and height by tag, levels or null."""
    kind = "elements array<struct<type:string,id:bigint,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>"
    ways = lines.select(F.inline(F.from_json(value, kind)["elements"])).where("type = 'way' and size(geometry) >= 4")
    ring = F.col("geometry")
    following = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    area = F.aggregate(F.zip_with(ring, following, lambda a, b: a["lon"] * b["lat"] - b["lon"] * a["lat"]), F.lit(0.0), lambda s, x: s + x) / 2

    def tag(name: str) -> Column:
        return F.regexp_extract(F.try_element_at("tags", F.lit(name)), r"^\s*([\d.]+)", 1).try_cast("double")

    height = F.coalesce(tag("height"), tag("building:height"), tag("building:levels") * 3)
    lat = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lat"]) / F.size(ring)
    lon = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lon"]) / F.size(ring)
    closed = F.get(ring, F.lit(0)) == F.element_at(ring, -1)
    return ways.select("id", lat.alias("lat"), lon.alias("lon"), F.abs(area).alias("area_deg2"), height.alias("height_m"), closed.alias("closed"), F.try_element_at("tags", F.lit("building")).alias("building"))


SNAPSHOT = "time double, states array<array<string>>"
# Places of the fields in a state of a snapshot.
SNAPSHOT_PLACES = {"icao24": 0, "callsign": 1, "lon_wgs": 5, "lat_wgs": 6, "baro_alt_m": 7, "on_ground": 8, "velocity_ms": 9, "track_deg": 10, "vert_rate_ms": 11, "geo_alt_m": 13}


def snapshot_lines(lines: DataFrame, value: str) -> DataFrame:
    """States of snapshot documents, whose states are arrays by place; numbers that do not parse are null, documents without states give no rows."""
    others = [c for c in lines.columns if c != value]
    doc = lines.select(*others, F.from_json(value, SNAPSHOT).alias("d")).select(*others, F.timestamp_seconds("d.time").alias("time_utc"), F.explode("d.states").alias("s"))

    def at(name: str) -> Column:
        text = F.trim(F.get("s", F.lit(SNAPSHOT_PLACES[name])))
        return text if name in ("icao24", "callsign") else F.coalesce(text.try_cast("boolean"), F.lit(False)) if name == "on_ground" else text.try_cast("double")

    return doc.select(*others, "time_utc", *(at(n).alias(n) for n in SNAPSHOT_PLACES))


def enriched(states: DataFrame, elevation_m: float, origin: tuple[float, float] | None = None) -> DataFrame:
    """states with z_msl_m (satellite height, else pressure height) and z_agl_m above the field, and x_m, y_m around an origin
    (lat, lon) if one is given; states without a position are left out."""
    placed = states.where("lon_wgs is not null and lat_wgs is not null").withColumn("z_msl_m", F.coalesce("geo_alt_m", "baro_alt_m"))
    placed = placed.withColumn("z_agl_m", F.col("z_msl_m") - elevation_m)
    if origin is None:
        return placed
    x, y = X.to_local(F.col("lat_wgs"), F.col("lon_wgs"), *origin)
    return placed.withColumns({"x_m": x, "y_m": y})


LINES = "features array<struct<geometry:struct<type:string,coordinates:array<array<double>>>>>"


def line_strings(lines: DataFrame, value: str, key: str) -> DataFrame:
    """(key, at, lon, lat, z) of the first feature of each document, if it is a line string of points with heights."""
    line = F.get(F.from_json(value, LINES)["features"], F.lit(0))["geometry"]
    points = lines.select(key, line.alias("g")).where("g.type = 'LineString'").select(key, F.posexplode("g.coordinates").alias("at", "p")).where("size(p) >= 3")
    return points.select(key, "at", *(F.get("p", F.lit(k)).alias(n) for k, n in enumerate(("lon", "lat", "z"))))


# Trips of a peak hour by direction and mode.
PEAK_TRIPS = """
08-09 in private_vehicle 3200
08-09 in shuttle 1100
08-09 in taxi 310
08-09 in rideshare 980
08-09 in transit 150
08-09 in employee_bus 520
08-09 out private_vehicle 2900
08-09 out shuttle 1050
08-09 out taxi 290
08-09 out rideshare 930
08-09 out transit 140
08-09 out employee_bus 490
11-12 in private_vehicle 3500
11-12 in shuttle 1250
11-12 in taxi 340
11-12 in rideshare 1110
11-12 in transit 175
11-12 in employee_bus 400
11-12 out private_vehicle 3380
11-12 out shuttle 1200
11-12 out taxi 325
11-12 out rideshare 1080
11-12 out transit 170
11-12 out employee_bus 380
17-18 in private_vehicle 3700
17-18 in shuttle 1320
17-18 in taxi 370
17-18 in rideshare 1180
17-18 in transit 185
17-18 in employee_bus 450
17-18 out private_vehicle 3600
17-18 out shuttle 1290
17-18 out taxi 360
17-18 out rideshare 1140
17-18 out transit 180
17-18 out employee_bus 435
"""


def peak_trips(spark: SparkSession, airport: str, year: int) -> DataFrame:
    """(year, airport, peak_hour, direction, mode, trips) of the report of peak hours."""
    rows = [(year, airport, *words[:3], int(words[3])) for words in map(str.split, PEAK_TRIPS.split("\n")) if words]
    return spark.createDataFrame(rows, "year int, airport string, peak_hour string, direction string, mode string, trips int")


def peak_shares() -> dict[int, float]:
    """Of all trips, the share of those that come in in each peak hour."""
    rows = [words for words in map(str.split, PEAK_TRIPS.split("\n")) if words]
    total, inward = sum(int(w[3]) for w in rows), {}
    for hour, direction, _, trips in rows:
        if direction == "in":
            inward[int(hour[:2])] = inward.get(int(hour[:2]), 0) + int(trips)
    return {h: n / total for h, n in inward.items()}


RUNWAY = "id string, thr_lat double, thr_lon double, end_lat double, end_lon double, thr_elev_m double, end_elev_m double, width_m double, bearing_deg double, code_letter string, code_number int, precision boolean"
RUNWAY_DEFAULTS = {"thr_elev_m": 0.0, "end_elev_m": 0.0, "code_letter": "F", "code_number": 4, "precision": True}


def runway_frame(spark: SparkSession, configuration: list[dict], lat0: float, lon0: float) -> DataFrame:
    """Runways of a configuration with the frame of each around (lat0, lon0): threshold (x0, y0), unit axis (ux, uy), left-hand
    normal (px, py) and length. One shorter than a metre is an error."""
    names = [f.split()[0] for f in RUNWAY.split(", ")]
    rows = spark.createDataFrame([tuple((RUNWAY_DEFAULTS | r).get(n) for n in names) for r in configuration], RUNWAY)
    (x0, y0), (x1, y1) = (X.to_local(F.col(f"{k}_lat"), F.col(f"{k}_lon"), lat0, lon0) for k in ("thr", "end"))
    placed = rows.withColumns({"x0": x0, "y0": y0, "x1": x1, "y1": y1}).withColumn("length", F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2)))
    placed = placed.withColumn("length", F.when(F.col("length") >= 1, F.col("length")).otherwise(F.raise_error(F.concat(F.lit("degenerate runway "), F.col("id")))))
    ux, uy = (F.col("x1") - F.col("x0")) / F.col("length"), (F.col("y1") - F.col("y0")) / F.col("length")
    return placed.withColumns({"ux": ux, "uy": uy, "px": -uy, "py": ux})


def vertiport_anchor(lat: Column, lon: Column, elevation_ft: Column, lat0: float, lon0: float, clearance_m: float = 30.0) -> tuple[Column, Column, Column]:
    """Where corridors of a vertiport begin: its place, at its height and a hover above."""
    x, y = X.to_local(lat, lon, lat0, lon0)
    return x, y, F.coalesce(elevation_ft, F.lit(0.0)) * X.FT_M + clearance_m


def runway_configs(df: DataFrame) -> DataFrame:
    """Runway use by slice of any of the three layouts: time_utc or slice_start; active_* or *_active or active_runways, as
    lists, comma lists or semicolon lists; config_id or config, else the two lists joined by a bar."""
    if not {"time_utc", "slice_start"} & set(df.columns):
        raise ValueError("runway use has neither time_utc nor slice_start")

    def joined(*names: str) -> Column | None:
        name = next((n for n in names if n in df.columns), None)
        if name is None:
            return None
        if df.schema[name].dataType.typeName() == "array":
            return F.array_join(F.filter(F.coalesce(name, F.array().cast("array<string>")), lambda v: v != ""), ";")
        parts = F.filter(F.transform(F.split(F.coalesce(name, F.lit("")), "[,;]"), lambda v: F.trim(v)), lambda v: v != "")
        return F.array_join(parts, ";")

    arrivals = joined("active_arrivals", "arrivals_active", "active_runways")
    arrivals = F.lit("") if arrivals is None else arrivals
    departures = joined("active_departures", "departures_active", "active_runways")
    departures = arrivals if departures is None else departures
    time = F.to_timestamp(F.col("time_utc" if "time_utc" in df.columns else "slice_start"))
    label = next((F.col(n).cast("string") for n in ("config_id", "config") if n in df.columns), F.concat(arrivals, F.lit("|"), departures))
    rest = [c for c in df.columns if c not in ("time_utc", "active_arrivals", "active_departures", "config_id")]
    return df.select(time.alias("time_utc"), arrivals.alias("active_arrivals"), departures.alias("active_departures"), label.alias("config_id"), *rest)


def with_sample_date(df: DataFrame, column: str = "sample_date") -> DataFrame:
    """The day in the name of the file of each row, where the column is missing or null."""
    found = F.to_date(F.nullif(F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})[^/]*$", 1), F.lit(""))).cast("string")
    return df.withColumn(column, F.coalesce(F.col(column).cast("string"), found) if column in df.columns else found)


GRID_FIELDS = "x_min double, y_min double, z_min double, dx double, dy double, dz double, nx int, ny int, nz int"


def voxel_table(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Voxels of a field below path/voxels, and its grid, the one row of path/grid."""
    grid = spark.read.schema(GRID_FIELDS).parquet(f"{path}/grid").limit(2).collect()
    if len(grid) != 1:
        raise ValueError(f"{path} has {len(grid)} grids")
    return spark.read.parquet(f"{path}/voxels"), grid[0].asDict()


def voxel_slice(spark: SparkSession, path: str, at: int) -> DataFrame:
    """Voxels of the slice that is nearest to a time; slices are partitions, so only one is read. The earlier wins a tie."""
    voxels = spark.read.parquet(path)
    nearest = voxels.select("slice").distinct().orderBy(F.abs(F.col("slice") - at), "slice").limit(1).collect()
    return voxels.where(F.col("slice") == nearest[0][0]) if nearest else voxels.where("false")


def voxel_box(spark: SparkSession, path: str, box: dict[str, tuple[int, int]], slices: tuple[int, int] | None = None) -> DataFrame:
    """Voxels of a field below path/voxels whose indices lie in a box (first and last, both inside), in slices from one to
    another: plain comparisons, so folders, files and row groups that hold none are not read."""
    found = spark.read.parquet(f"{path}/voxels")
    for column, (low, high) in (box | ({"slice": slices} if slices else {})).items():
        found = found.where(F.col(column).between(low, high))
    return found


def voxels_under(spark: SparkSession, path: str, value: str, limit: float, box: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Voxels of a stored field whose value is `limit` at most: what a threshold closes, read from the file alone; null values never are."""
    return voxel_box(spark, path, box or {}).where(F.col(value) <= limit)


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The parquet table at a path, or one of the schema without rows where there is none, so that what is joined to it is null."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.parquet(path) if there else spark.createDataFrame([], schema)


def map_shapes(elements: DataFrame) -> DataFrame:
    """(id, shape, points) of map elements (id, type, lon, lat, line array<struct<lon,lat>>): points, polygons (closed, of four
    points at least), lines of two points at least; what is neither gives no row."""
    closed = (F.size("line") >= 4) & (F.get("line", F.lit(0)) == F.element_at("line", -1))
    shape = F.when(F.col("type") == "node", "point").when((F.col("type") == "way") & closed, "polygon").when((F.col("type") == "way") & (F.size("line") >= 2), "line")
    points = F.when(F.col("type") == "node", F.array(F.struct("lon", "lat"))).otherwise(F.col("line"))
    return elements.select("id", shape.alias("shape"), points.alias("points")).where("shape is not null")
