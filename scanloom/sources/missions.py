"""Mission archives, intents, footprints and flight logs as tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import angles
from scanloom.operators import paths

#: Entry of the route in an archive.
WAYLINES = "wpmz/waylines.wpml"
#: Namespaces of the format.
KML, WPML = "http://www.opengis.net/kml/2.2", "http://www.dji.com/wpmz/1.0.6"
#: Rows of a file when a mission is cut into several: a document of a few megabytes, whatever the length of the mission.
PART_ROWS = 5_000
#: Bytes of documents that go to Python together, unless the session says how many.
BATCH_BYTES = 16 << 20
LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+(STATE|ACTION|UPLOAD|START|ERROR)\b(.*)$"


def _tag(name: str, *inner: Column) -> Column:
    """An element of the mission namespace."""
    return F.concat(F.lit(f"<wpml:{name}>"), *inner, F.lit(f"</wpml:{name}>"))


def _value(name: str, value: str) -> Column:
    return _tag(name, F.lit(value))


def _number(c: Column) -> Column:
    return F.format_string("%.8f", c.cast("double"))


def _gimbal(pitch: Column, yaw: Column) -> Column:
    """A gimbal command: yaw from north, or none of its own where it is null."""
    base = F.when(yaw.isNull(), F.lit("aircraft")).otherwise(F.lit("north"))
    on = F.when(yaw.isNull(), F.lit("0")).otherwise(F.lit("1"))
    return _tag(
        "actionActuatorFuncParam", _tag("gimbalHeadingYawBase", base), _value("gimbalRotateMode", "absoluteAngle"), _value("gimbalPitchRotateEnable", "1"), _tag("gimbalPitchRotateAngle", _number(angles.clamp_pitch(pitch))),
        _value("gimbalRollRotateEnable", "0"), _value("gimbalRollRotateAngle", "0"), _tag("gimbalYawRotateEnable", on), _tag("gimbalYawRotateAngle", _number(F.coalesce(yaw, F.lit(0.0)))),
        _value("gimbalRotateTimeEnable", "0"), _value("gimbalRotateTime", "0"), _value("payloadPositionIndex", "0"),
    )


def _start_group(pitch: Column) -> Column:
    """Before the first waypoint: its pitch, half a second to settle, manual focus."""
    act = lambda n, func, inner: _tag("action", _value("actionId", str(n)), _value("actionActuatorFunc", func), inner)
    hover = _tag("actionActuatorFuncParam", _value("hoverTime", "0.5"))
    focus = _tag("actionActuatorFuncParam", _value("cameraFocusType", "manual"), _value("payloadPositionIndex", "0"))
    return _tag("startActionGroup", act(0, "gimbalRotate", _gimbal(pitch, F.lit(None).cast("double"))), act(1, "hover", hover), act(2, "setFocusType", focus))


def part_of(idx: Column, part_rows: int | None) -> Column:
    """The file that a row goes to, from 0: files hold ranges of ``part_rows`` indexes; without it there is one."""
    return F.floor(idx / part_rows).cast("long") if part_rows else F.lit(0).cast("long")


def waylines_xml(waypoints: DataFrame, most: int = 65_535, speed_ms: float = 3.0, part_rows: int | None = None) -> DataFrame:
    """``mission_id, n, xml``: the executable route of every mission in the standard layout, built from columns.

    Height over the start (``z``, else ``alt``) is at least 2 m, the ellipsoid height is ``alt`` unless that is 0; headings
    lie within 180 degrees, pitch within the gimbal's limits. Other than transit rows command the gimbal (yaw from
    north, none of its own where null) and a photo; rows where ``emit_gimbal`` is false (see
    :func:`scanloom.operators.paths.dedupe_poses`) only a photo, and a heading where ``emit_heading`` is true.
    The folder holds distance and duration (half a second a row, at ``speed_ms``) where rows have x, y and z,
    and the group of actions before the first row. A mission of more than ``most`` rows has a null xml.

    part_rows: missions are cut into files of so many indexes, ``mission_id, part, n, xml``, which together hold all rows of a mission of any
    length; n counts the file's rows, distance and duration are the whole mission's.
    """
    have = set(waypoints.columns)

    def placemark(c: Callable[[str], Column]) -> Column:
        height = F.greatest(c("z" if "z" in have else "alt").cast("double"), F.lit(2.0))
        ellipsoid = F.coalesce(F.nullif(c("alt").cast("double"), F.lit(0.0)), height)
        emit = F.coalesce(c("emit_gimbal"), F.lit(True)) if "emit_gimbal" in have else F.lit(True)
        nose = F.coalesce(c("emit_heading"), F.lit(False)) if "emit_heading" in have else F.lit(False)
        heading = _number(angles.heading_fold(c("heading_deg")))
        # Ids count what is there: the gimbal, the heading and the photo.
        func = lambda n, name, inner: _tag("action", _tag("actionId", n.cast("string")), _value("actionActuatorFunc", name), inner)
        rotate = F.when(emit, func(F.lit(0), "gimbalRotate", _gimbal(c("gimbal_pitch_deg"), c("gimbal_yaw_deg")))).otherwise("")
        turn = F.when(nose, func(emit.cast("int"), "rotateYaw", _tag("actionActuatorFuncParam", _tag("aircraftHeading", heading), _value("aircraftPathMode", "counterClockwise")))).otherwise("")
        photo = func(emit.cast("int") + nose.cast("int"), "takePhoto", _tag("actionActuatorFuncParam", _tag("fileSuffix", F.concat(F.lit("wp"), c("idx").cast("string"))), _value("payloadPositionIndex", "0")))
        group = _tag("actionGroup", _tag("actionGroupId", c("idx").cast("string")), _tag("actionGroupStartIndex", c("idx").cast("string")), _tag("actionGroupEndIndex", c("idx").cast("string")), _value("actionGroupMode", "sequence"), _tag("actionTrigger", _value("actionTriggerType", "reachPoint")), rotate, turn, photo)
        return F.concat(
            F.lit("<Placemark><Point><coordinates>"), _number(c("lon")), F.lit(","), _number(c("lat")), F.lit("</coordinates></Point>"), _tag("index", c("idx").cast("string")),
            _tag("executeHeight", _number(height)), _tag("ellipsoidHeight", _number(ellipsoid)), _tag("waypointSpeed", _number(c("speed_ms"))), _tag("waypointHeadingParam", _value("waypointHeadingMode", "smoothTransition"), _tag("waypointHeadingAngle", heading)),
            _tag("waypointTurnParam", _value("waypointTurnMode", "toPointAndPassWithContinuityCurvature"), _value("waypointTurnDampingDist", "0")), F.when(c("is_transition"), "").otherwise(group), F.lit("</Placemark>"),
        )

    c, measured = F.col, have >= {"x", "y", "z"}
    rows = (paths.with_path(waypoints) if measured else waypoints.withColumn("seg_m", F.lit(None).cast("double")))
    totals = rows.groupBy(c("mission_id").alias("_of")).agg(F.count("*").alias("rows"), F.sum("seg_m").alias("m"))
    # Files are collected as numbers and written out one at a time: the text is twenty times as long.
    rest = [n for n in ("alt", "emit_gimbal", "emit_heading", "gimbal_pitch_deg", "gimbal_yaw_deg", "heading_deg", "is_transition", "lat", "lon", "speed_ms", "z") if n in have]
    g = rows.groupBy("mission_id", part_of(c("idx"), part_rows).alias("part")).agg(F.count("*").alias("n"), F.min_by("gimbal_pitch_deg", "idx").alias("pitch"), F.array_sort(F.collect_list(F.struct("idx", *rest))).alias("p"))
    g = g.join(totals, c("mission_id").eqNullSafe(c("_of")))
    three = lambda v: F.format_string("%.3f", v)
    size = F.concat(_tag("distance", three(c("m"))), _tag("duration", three(c("m") / max(speed_ms, 0.1) + 0.5 * c("rows")))) if measured else F.lit("")
    head = F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="{KML}" xmlns:wpml="{WPML}"><Document><Folder>'), _value("templateId", "0"), _value("executeHeightMode", "relativeToStartPoint"), _value("waylineId", "0"), size, _start_group(F.coalesce("pitch", F.lit(0.0))))
    body = F.concat(head, F.array_join(F.transform("p", lambda x: placemark(lambda n: x[n])), ""), F.lit("</Folder></Document></kml>"))
    return g.select("mission_id", *(["part"] if part_rows else []), "n", F.when(F.col("n") <= most, body).alias("xml"))


def _few_bytes(spark: SparkSession) -> None:
    """A batch of documents ends by its bytes, as a document may be megabytes and a batch counts thousands of rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def archives(xml: DataFrame) -> DataFrame:
    """``mission_id, content``: each route zipped."""
    _few_bytes(xml.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for x in pdf["xml"]:
                sink = io.BytesIO()
                with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(zipfile.ZipInfo(WAYLINES), x)
                out.append(sink.getvalue())
            yield pd.DataFrame({"mission_id": pdf["mission_id"], "content": out})

    return xml.where("xml is not null").select("mission_id", "xml").mapInPandas(run, f"mission_id {dict(xml.dtypes)['mission_id']}, content binary")


def read_archives(files: DataFrame) -> DataFrame:
    """``archive_id, kind, text, error, data`` members of archives ``archive_id, content``: template, waylines, scan description
    and cloud (its bytes in ``data``) by suffix (the last match wins), archives inside archives only where neither is there; a row with an error where
    no route is found."""
    def members(content: bytes, depth: int = 0) -> dict[str, bytes]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            got = {}
            for name in names:
                low = name.lower()
                if low.endswith("template.kml"):
                    got["template"] = z.read(name)
                elif low.endswith("waylines.wpml"):
                    got["waylines"] = z.read(name)
                elif low.endswith("sfm_geo_desc.json"):
                    got["geo_desc"] = z.read(name)
                elif low.endswith("cloud.ply"):
                    got["cloud"] = z.read(name)
            if not got.keys() & {"template", "waylines"} and depth < 2:
                for name in names:
                    if name.lower().endswith((".kmz", ".zip")):
                        got = members(z.read(name), depth + 1)
            return got

    _few_bytes(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Texts are many times as long as their archives, so each archive goes back by itself.
        for pdf in batches:
            for k, content in zip(pdf["archive_id"], pdf["content"], strict=True):
                rows: list[tuple] = []
                try:
                    got = members(bytes(content))
                    if "waylines" not in got:
                        raise ValueError("no route")
                    rows += [(k, kind, None, None, x) if kind == "cloud" else (k, kind, x.decode("utf-8"), None, None) for kind, x in got.items()]
                except (ValueError, zipfile.BadZipFile) as e:
                    rows.append((k, "error", None, str(e), None))
                yield pd.DataFrame(rows, columns=["archive_id", "kind", "text", "error", "data"])

    return files.select("archive_id", "content").mapInPandas(run, f"archive_id {dict(files.dtypes)['archive_id']}, kind string, text string, error string, data binary")


#: What is read of a placemark; everything as text, so that one bad number doesn't lose the row.
_ACTION = "STRUCT<actionActuatorFunc: STRING, actionActuatorFuncParam: STRUCT<aircraftHeading: STRING, gimbalPitchRotateAngle: STRING, gimbalYawRotateAngle: STRING, gimbalHeadingYawBase: STRING>>"
_PLACE = (
    "STRUCT<Point: STRUCT<coordinates: STRING>, index: STRING, executeHeight: STRING, ellipsoidHeight: STRING, waypointSpeed: STRING, waypointHeadingParam: STRUCT<waypointHeadingAngle: STRING>, "
    f"waypointGimbalHeadingParam: STRUCT<waypointGimbalPitchAngle: STRING, waypointGimbalYawAngle: STRING, waypointGimbalHeadingMode: STRING>, actionGroup: ARRAY<STRUCT<action: ARRAY<{_ACTION}>>>>"
)
_ROUTE = f"Document STRUCT<Folder: ARRAY<STRUCT<Placemark: ARRAY<{_PLACE}>>>>"


def _placemarks(members: DataFrame) -> DataFrame:
    """``archive_id, base, places`` of every route: the file's first yaw base and the placemarks of one coordinate line with two numbers."""
    first = F.regexp_extract("text", r"<(?:[\w-]+:)?gimbalHeadingYawBase(?:\s[^>]*)?>([^<]+)</", 1)
    rows = members.where("kind = 'waylines'").select("archive_id", first.alias("base"), F.from_xml("text", _ROUTE, {"ignoreNamespace": "true"}).alias("d"))
    found = F.flatten(F.transform(F.coalesce("d.Document.Folder", F.array()), lambda f: F.coalesce(f["Placemark"], F.array())))
    lines = lambda p: F.filter(F.split(F.coalesce(p["Point"]["coordinates"], F.lit("")), "\n"), lambda v: F.length(F.trim(v)) > 0)
    number = lambda p, k: F.trim(F.try_element_at(F.split(lines(p)[0], ","), F.lit(k))).try_cast("double")
    good = lambda p: F.when(F.size(lines(p)) == 1, number(p, 1).isNotNull() & number(p, 2).isNotNull()).otherwise(F.lit(False))
    return rows.select("archive_id", F.coalesce(F.nullif(F.trim("base"), F.lit("")), F.lit("aircraft")).alias("base"), F.filter(found, good).alias("places"))


def parse_waylines(members: DataFrame) -> DataFrame:
    """``archive_id, idx, lat, lon, alt, heading_deg, gimbal_pitch_deg, gimbal_yaw_raw_deg, gimbal_heading_mode, gimbal_yaw_base, speed_ms, is_transition`` of every placemark; namespaces are ignored.

    Placemarks of several coordinate lines (areas) are left out. Height is the ellipsoid's unless that is 0 or
    missing. Actions override what stands in the placemark, the last one that has the number. The yaw base is the action's,
    else the file's first, else the aircraft. A row without index has its place in the file; what else
    is missing or no number is 0, 2 m/s for the speed. Rows without gimbal angles and actions are transit.
    """
    p = _placemarks(members).select("archive_id", "base", F.posexplode("places").alias("pos", "p"))
    acts = F.filter(F.flatten(F.transform(F.coalesce("p.actionGroup", F.array()), lambda g: F.coalesce(g["action"], F.array()))), lambda a: a["actionActuatorFunc"].isNotNull() & a["actionActuatorFuncParam"].isNotNull())
    p = p.withColumn("acts", acts)
    zero, text = F.lit(0.0), lambda c: F.nullif(F.trim(c), F.lit(""))
    num = lambda c: F.trim(c).try_cast("double")
    own = lambda func: F.filter("acts", lambda a: F.trim(a["actionActuatorFunc"]) == func)
    last = lambda func, f, read: F.try_element_at(F.filter(F.transform(own(func), lambda a: read(a["actionActuatorFuncParam"][f])), lambda v: v.isNotNull()), F.lit(-1))
    point = F.split(F.col("p.Point.coordinates"), ",")
    inline = F.col("p.waypointGimbalHeadingParam")
    alt = F.coalesce(F.nullif(num(F.col("p.ellipsoidHeight")), zero), num(F.col("p.executeHeight")), zero)
    return p.select(
        "archive_id", F.coalesce(num(F.col("p.index")).cast("int"), "pos").alias("idx"), num(point[1]).alias("lat"), num(point[0]).alias("lon"), alt.alias("alt"),
        F.coalesce(last("rotateYaw", "aircraftHeading", num), num(F.col("p.waypointHeadingParam.waypointHeadingAngle")), zero).alias("heading_deg"),
        F.coalesce(last("gimbalRotate", "gimbalPitchRotateAngle", num), num(inline["waypointGimbalPitchAngle"]), zero).alias("gimbal_pitch_deg"),
        F.coalesce(last("gimbalRotate", "gimbalYawRotateAngle", num), num(inline["waypointGimbalYawAngle"]), zero).alias("gimbal_yaw_raw_deg"),
        F.coalesce(text(inline["waypointGimbalHeadingMode"]), F.lit("smoothTransition")).alias("gimbal_heading_mode"),
        F.coalesce(last("gimbalRotate", "gimbalHeadingYawBase", text), "base").alias("gimbal_yaw_base"),
        F.coalesce(num(F.col("p.waypointSpeed")), F.lit(2.0)).alias("speed_ms"), ((F.size("acts") == 0) & inline.isNull()).alias("is_transition"),
    )


def unreadable_routes(members: DataFrame) -> DataFrame:
    """``archive_id, error`` of routes without a single readable waypoint, for the quarantine."""
    return _placemarks(members).where("coalesce(size(places), 0) < 1").select("archive_id", F.lit("no readable waypoint").alias("error"))


#: A pose of a rosette, and a waypoint of an intent.
_POSE = "STRUCT<pitch_deg: DOUBLE, yaw_offset_deg: DOUBLE, roll_deg: DOUBLE>"
_INTENT = (
    "STRUCT<index: INT, lon: DOUBLE, lat: DOUBLE, alt_egm96: DOUBLE, heading_deg: DOUBLE, gimbal_pitch_deg: DOUBLE, speed_ms: DOUBLE, "
    f"gimbal_yaw_raw_deg: DOUBLE, gimbal_heading_mode: STRING, gimbal_yaw_base: STRING, smart_oblique_poses: ARRAY<{_POSE}>>"
)


def write_intents(route: DataFrame, reference: DataFrame | None = None, rings: DataFrame | None = None, part_rows: int | None = None) -> DataFrame:
    """``value``: one compact JSON document a mission, or one for every ``part_rows`` indexes of it (with the mission's name, reference and area), from rows as :func:`parse_waylines` gives them (key ``mission_id`` or ``archive_id``, its name).

    ``poses`` (pitch, yaw_offset, roll) is optional; reference: ``key, ref_lat, ref_lon, ref_alt``; rings: ``key, ring`` of (lon, lat, alt).
    """
    key = "mission_id" if "mission_id" in route.columns else "archive_id"
    none = F.array().cast(f"array<{_POSE}>")
    poses = F.coalesce(F.transform("poses", lambda p: F.struct(p["pitch"].alias("pitch_deg"), p["yaw_offset"].alias("yaw_offset_deg"), p["roll"].alias("roll_deg"))), none) if "poses" in route.columns else none
    item = F.struct(F.col("idx").alias("index"), "lon", "lat", F.col("alt").alias("alt_egm96"), "heading_deg", "gimbal_pitch_deg", "speed_ms", "gimbal_yaw_raw_deg", "gimbal_heading_mode", "gimbal_yaw_base", poses.alias("smart_oblique_poses"))
    g = route.groupBy(key, part_of(F.col("idx"), part_rows).alias("part")).agg(F.array_sort(F.collect_list(item)).alias("waypoints"))
    at, area = ["ref_lat", "ref_lon", "ref_alt"], F.array().cast("array<array<double>>")
    g = g.join(reference.select(key, *at), key, "left") if reference is not None else g.select("*", *[F.lit(None).cast("double").alias(c) for c in at])
    if rings is not None:
        g = g.join(rings.select(key, F.transform("ring", lambda p: F.array(p["lon"], p["lat"], p["alt"])).alias("area")), key, "left")
        area = F.coalesce("area", area)
    ref = F.struct(*[F.coalesce(c, F.lit(0.0)).alias(c[4:]) for c in at])
    return g.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.col(key).cast("string").alias("name"), ref.alias("ref"), area.alias("mission_area_wgs84"), "waypoints")).alias("value"))


def read_intents(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(waypoints with ``name, ref, ring``, quarantine) of JSON documents in ``value``.

    Quarantined are documents of another schema version, without a reference or with a waypoint that lacks a place, heading or pitch.
    """
    d = F.from_json("value", f"schema_version INT, name STRING, ref STRUCT<lat: DOUBLE, lon: DOUBLE, alt: DOUBLE>, mission_area_wgs84 ARRAY<ARRAY<DOUBLE>>, waypoints ARRAY<{_INTENT}>")
    whole = F.forall("d.waypoints", lambda w: (w["index"] + w["lon"] + w["lat"] + w["alt_egm96"] + w["heading_deg"] + w["gimbal_pitch_deg"]).isNotNull())
    rows = lines.withColumn("d", d)
    good = F.coalesce((F.col("d.schema_version") == 1) & F.col("d.ref").isNotNull() & whole, F.lit(False))
    ring = F.transform(F.coalesce("d.mission_area_wgs84", F.array().cast("array<array<double>>")), lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"), F.coalesce(F.try_element_at(p, F.lit(3)), F.lit(0.0)).alias("alt")))
    w = rows.where(good).select(F.coalesce("d.name", F.lit("")).alias("name"), F.col("d.ref").alias("ref"), ring.alias("ring"), F.explode("d.waypoints").alias("w"))
    zero = F.lit(0.0)
    poses = F.transform(F.coalesce("w.smart_oblique_poses", F.array().cast(f"array<{_POSE}>")), lambda p: F.struct(p["pitch_deg"].alias("pitch"), p["yaw_offset_deg"].alias("yaw_offset"), F.coalesce(p["roll_deg"], zero).alias("roll")))
    points = w.select(
        "name", "ref", "ring", F.col("w.index").alias("idx"), "w.lat", "w.lon", F.col("w.alt_egm96").alias("alt"), "w.heading_deg", "w.gimbal_pitch_deg", F.coalesce("w.gimbal_yaw_raw_deg", zero).alias("gimbal_yaw_raw_deg"),
        F.coalesce("w.gimbal_heading_mode", F.lit("smoothTransition")).alias("gimbal_heading_mode"), F.coalesce("w.gimbal_yaw_base", F.lit("aircraft")).alias("gimbal_yaw_base"), F.coalesce("w.speed_ms", F.lit(2.0)).alias("speed_ms"), poses.alias("poses"),
    )
    return points, rows.where(~good).select("value")


def read_geojson(spark: SparkSession, path: str, height: float = 8.0) -> DataFrame:
    """``footprint_id, ring, height`` of all features (first ring, closing point dropped); rings under three corners go."""
    shape = "features ARRAY<STRUCT<geometry: STRUCT<type: STRING, coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>, properties: STRUCT<height: DOUBLE>>>"
    f = spark.read.schema(shape).option("multiLine", "true").json(path).select(F.col("_metadata.file_name").alias("file"), F.posexplode("features").alias("pos", "f"))
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    rows = f.select(F.concat_ws("#", "file", "pos").alias("footprint_id"), ring.alias("ring"), F.coalesce(F.nullif("f.properties.height", F.lit(0.0)), F.lit(height)).alias("height"))
    closed = F.element_at("ring", 1) == F.element_at("ring", -1)
    return rows.withColumn("ring", F.when(closed, F.slice("ring", 1, F.size("ring") - 1)).otherwise(F.col("ring"))).where(F.size("ring") >= 3)


def parse_log(lines: DataFrame) -> DataFrame:
    """``flight_id, ts, kind, mission_state, waypoint_index`` of log lines in ``flight_id, value``; works on streams.
    NULs and terminal colours are stripped and other lines dropped."""
    clean = F.regexp_replace(F.translate("value", "\x00", ""), "\x1b\\[[0-9;]*[A-Za-z]", "")
    got = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit("")).try_cast("int")
    rows = lines.withColumn("line", clean).where(F.col("line").rlike(LOG_LINE))
    return rows.select("flight_id", F.to_timestamp(F.regexp_extract("line", LOG_LINE, 1)).alias("ts"), F.regexp_extract("line", LOG_LINE, 2).alias("kind"), got(r"state[= ](\d+)").alias("mission_state"), got(r"(?:wp|waypoint)[= ](\d+)").alias("waypoint_index"))
