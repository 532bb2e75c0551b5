"""Mission templates, photo rosettes and reference points of archives, and flown routes in local metres.

Inputs are the member rows of :func:`scanloom.sources.missions.read_archives`. Tags are found by
their local names, so prefixes don't matter; everything stays in column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import angles, geo

#: Settings that count wherever they stand in a template.
ANYWHERE = ("globalShootHeight", "autoFlightSpeed", "orthoCameraOverlapH", "orthoCameraOverlapW", "height")
OBLIQUE = "startSmartOblique"


def _block(tag: str) -> str:
    return f"(?s)<(?:[\\w-]+:)?{tag}(?:\\s[^>]*)?>(.*?)</(?:[\\w-]+:)?{tag}>"


def _all(text: Column, tag: str) -> Column:
    """The inner text of every element of that name."""
    return F.regexp_extract_all(text, F.lit(_block(tag)), F.lit(1))


def _first(text: Column, tag: str) -> Column:
    return F.try_element_at(_all(text, tag), F.lit(1))


def _numbers(text: Column) -> Column:
    return F.transform(F.split(F.trim(text), ","), lambda v: F.trim(v).try_cast("double"))


def parse_template(members: DataFrame) -> DataFrame:
    """``archive_id, config, ring, takeoff`` of each template.

    config: the leaves right under the mission's settings and the settings that count anywhere, the
    last one with a text winning. ring: (lon, lat, alt) of the area, height 0 where it has none,
    lines without two numbers left out. takeoff: (lat, lon, alt), null unless it has three numbers.
    """
    t = F.col("text")
    nested = r"(?s)<([\w:-]+)(?:\s[^>]*)?>\s*(?:<[^/][^>]*>[^<]*</[^>]+>\s*)+</\1>"
    flat = F.regexp_replace(F.coalesce(_first(t, "missionConfig"), F.lit("")), nested, "<$1></$1>")
    leaf = r"<(?:[\w-]+:)?([\w-]+)(?:\s[^>]*)?>([^<]*)</"
    pair = lambda n, v: F.struct(n.alias("n"), F.trim(v).alias("v"))
    own = F.zip_with(F.regexp_extract_all(flat, F.lit(leaf), F.lit(1)), F.regexp_extract_all(flat, F.lit(leaf), F.lit(2)), pair)
    named = lambda n: F.transform(F.filter(_all(t, n), lambda v: ~v.contains("<") & (F.length(F.trim(v)) > 0)), lambda v: pair(F.lit(n), v))
    anywhere = [named(n) for n in ANYWHERE]
    rows = members.where("kind = 'template'").withColumn("pairs", F.concat(own, *anywhere))
    keys = F.array_distinct(F.transform("pairs", lambda p: p["n"]))
    value = lambda k: F.element_at(F.filter("pairs", lambda p: p["n"] == k), -1)["v"]
    area = _first(_first(_first(t, "Placemark"), "Point"), "coordinates")
    lines = F.filter(F.transform(F.split(F.trim(area), "\\s*\n\\s*"), _numbers), lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull())
    corner = lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"), F.coalesce(F.try_element_at(p, F.lit(3)), F.lit(0.0)).alias("alt"))
    at = _numbers(_first(t, "takeOffRefPoint"))
    takeoff = F.when((F.size(at) >= 3) & F.forall(F.slice(at, 1, 3), lambda v: v.isNotNull()), F.struct(at[0].alias("lat"), at[1].alias("lon"), at[2].alias("alt")))
    return rows.select("archive_id", F.map_from_arrays(keys, F.transform(keys, value)).alias("config"), F.coalesce(F.transform(lines, corner), F.array().cast("array<struct<lon:double,lat:double,alt:double>>")).alias("ring"), takeoff.alias("takeoff"))


def parse_oblique_groups(members: DataFrame) -> DataFrame:
    """``archive_id, pos, start_idx, end_idx, poses`` (pitch, yaw_offset, roll) of the action groups that start a rosette.

    pos: place in the file. A missing angle is 0; poses with a bad number are skipped, and groups without a pose or a whole-number range.
    """
    g = members.where("kind = 'waylines'").select("archive_id", F.posexplode(_all(F.col("text"), "actionGroup")).alias("pos", "g"))
    g = g.where(F.exists(_all(F.col("g"), "actionActuatorFunc"), lambda f: F.trim(f) == OBLIQUE))
    whole = lambda tag: F.trim(_first(F.col("g"), tag)).try_cast("int")
    angle = lambda p, tag: F.when(_first(p, tag).isNull(), F.lit(0.0)).otherwise(F.trim(_first(p, tag)).try_cast("double"))
    roll = lambda p: F.when(F.coalesce(_first(p, "smartObliqueEulerRoll"), F.lit("")) == "", F.lit(0.0)).otherwise(angle(p, "smartObliqueEulerRoll"))
    pose = lambda p: F.struct(angle(p, "smartObliqueEulerPitch").alias("pitch"), angle(p, "smartObliqueEulerYaw").alias("yaw_offset"), roll(p).alias("roll"))
    poses = F.filter(F.transform(_all(F.col("g"), "smartObliquePoint"), pose), lambda p: p["pitch"].isNotNull() & p["yaw_offset"].isNotNull() & p["roll"].isNotNull())
    rows = g.select("archive_id", "pos", whole("actionGroupStartIndex").alias("start_idx"), whole("actionGroupEndIndex").alias("end_idx"), poses.alias("poses"))
    return rows.where("start_idx is not null and end_idx is not null and size(poses) > 0")


def rosette_absolute(poses: Column, heading: Column) -> Column:
    """Poses with ``yaw``: from north, as their offsets count from the nose of the aircraft."""
    return F.transform(poses, lambda p: F.struct(p["pitch"].alias("pitch"), angles.to_pm180(heading + p["yaw_offset"]).alias("yaw"), p["yaw_offset"].alias("yaw_offset"), p["roll"].alias("roll")))


def resolve_reference(members: DataFrame, route: DataFrame, templates: DataFrame) -> DataFrame:
    """``archive_id, ref_lat, ref_lon, ref_alt``: the scan's description (numbers that it lacks are 0), else the
    take-off point, else the first waypoint, else zero. One row for every archive with a route."""
    shape = "ref_GPS STRUCT<latitude: DOUBLE, longitude: DOUBLE, altitude: DOUBLE>"
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    d = F.from_json("text", shape)
    described = members.where("kind = 'geo_desc'").select("archive_id", F.struct(zero(d["ref_GPS"]["latitude"]).alias("lat"), zero(d["ref_GPS"]["longitude"]).alias("lon"), zero(d["ref_GPS"]["altitude"]).alias("alt")).alias("described"))
    first = route.groupBy("archive_id").agg(F.min_by(F.struct("lat", "lon", "alt"), "idx").alias("first"))
    rows = members.where("kind = 'waylines'").select("archive_id").distinct().join(described, "archive_id", "left").join(templates.select("archive_id", "takeoff"), "archive_id", "left").join(first, "archive_id", "left")
    at = F.coalesce("described", "takeoff", "first")
    return rows.select("archive_id", *[zero(at[k]).alias(f"ref_{k}") for k in ("lat", "lon", "alt")])


def flown_waypoints(route: DataFrame, reference: DataFrame, groups: DataFrame) -> DataFrame:
    """A parsed route in metres east, north and up of its reference point, numbered by position.

    Gimbal yaw counts from north: ``gimbal_yaw_raw_deg`` does so already where ``gimbal_yaw_base`` is 'north', else
    the heading is added. ``poses`` are those of the first rosette in the file whose range holds the row's own index, an empty list
    elsewhere. No row has a face yet; each is one photo of the wide camera.
    """
    rows = route.join(reference, "archive_id")
    x, y, z = geo.wgs84_to_enu(F.col("lat"), F.col("lon"), F.col("alt"), F.col("ref_lat"), F.col("ref_lon"), F.col("ref_alt"))
    held = F.collect_list(F.struct("pos", "start_idx", "end_idx", "poses"))
    rows = rows.join(groups.groupBy("archive_id").agg(F.array_sort(held).alias("held")), "archive_id", "left")
    inside = F.filter("held", lambda g: F.col("idx").between(g["start_idx"], g["end_idx"]))
    poses = F.coalesce(F.try_element_at(inside, F.lit(1))["poses"], F.array().cast("array<struct<pitch:double,yaw_offset:double,roll:double>>"))
    yaw = angles.absolute_gimbal_yaw(F.col("gimbal_yaw_base"), F.col("heading_deg"), F.coalesce("gimbal_yaw_raw_deg", F.lit(0.0)))
    order = Window.partitionBy("archive_id").orderBy("idx")
    return rows.select(
        "archive_id", (F.row_number().over(order) - 1).alias("idx"), x.alias("x"), y.alias("y"), z.alias("z"), "lat", "lon", "alt", "heading_deg", "gimbal_pitch_deg", yaw.alias("gimbal_yaw_deg"), "speed_ms",
        F.lit(-1).alias("facade_index"), F.lit(False).alias("is_transition"), F.lit("wide").alias("camera"), rosette_absolute(poses, F.col("heading_deg")).alias("poses"),
    )


def template_xml(missions: DataFrame) -> DataFrame:
    """``mission_id, xml`` of missions ``mission_id, config (map), ring (lon, lat, alt), takeoff (lat, lon, alt)``; what is null is left out."""
    n = lambda c: F.format_string("%.8f", c.cast("double"))
    config = F.array_join(F.transform(F.map_entries("config"), lambda e: F.concat(F.lit("<wpml:"), e["key"], F.lit(">"), geo.html_escape(e["value"]), F.lit("</wpml:"), e["key"], F.lit(">"))), "")
    ring = F.array_join(F.transform("ring", lambda p: F.concat_ws(",", n(p["lon"]), n(p["lat"]), n(p["alt"]))), "\n")
    config, ring = F.coalesce(config, F.lit("")), F.coalesce(ring, F.lit(""))
    at = F.coalesce(F.concat(F.lit("<wpml:takeOffRefPoint>"), F.concat(n(F.col("takeoff.lat")), F.lit(","), n(F.col("takeoff.lon")), F.lit(","), n(F.col("takeoff.alt"))), F.lit("</wpml:takeOffRefPoint>")), F.lit(""))
    xml = F.concat(F.lit('<?xml version="1.0"?><kml><Document><wpml:missionConfig>'), config, at, F.lit("</wpml:missionConfig><Folder><Placemark><Point><coordinates>\n"), ring, F.lit("\n</coordinates></Point></Placemark></Folder></Document></kml>"))
    return missions.select("mission_id", xml.alias("xml"))
