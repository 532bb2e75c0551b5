"""Shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.operators import generate
from scanloom.sources.fixtures import VIEWS, view


def decimals(c: Column, n: int) -> Column:
    """c to n decimals, halves away from zero, as DuckDB rounds; numbers of up to 15 digits don't go through Spark's decimals, which cost more than the columns they round."""
    ten = float(10**n)
    return F.when(F.abs(c) < 1e15 / ten, F.signum(c) * F.floor(F.abs(c) * ten + 0.5) / ten).otherwise(F.round(c, n))


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero, for comparison across engines."""
    return decimals(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def facades(spark, sf_dir: str) -> DataFrame:
    return generate.rectangular_facades(view(spark, sf_dir, "buildings"))


#: The faces of all buildings as SQL: a table of corners by face, turned by the heading.
FACADES_SQL = f"""
buildings AS ({VIEWS['buildings']}),
corner(face, label, lx, ly, lz, k, sx, sy, top) AS (VALUES
  (0,'back_wall',0,-1,0,0,-1,-1,0),(0,'back_wall',0,-1,0,1,1,-1,0),(0,'back_wall',0,-1,0,2,1,-1,1),(0,'back_wall',0,-1,0,3,-1,-1,1),
  (1,'right_wall',1,0,0,0,1,-1,0),(1,'right_wall',1,0,0,1,1,1,0),(1,'right_wall',1,0,0,2,1,1,1),(1,'right_wall',1,0,0,3,1,-1,1),
  (2,'front_wall',0,1,0,0,1,1,0),(2,'front_wall',0,1,0,1,-1,1,0),(2,'front_wall',0,1,0,2,-1,1,1),(2,'front_wall',0,1,0,3,1,1,1),
  (3,'left_wall',-1,0,0,0,-1,1,0),(3,'left_wall',-1,0,0,1,-1,-1,0),(3,'left_wall',-1,0,0,2,-1,-1,1),(3,'left_wall',-1,0,0,3,-1,1,1),
  (4,'roof_flat',0,0,1,0,-1,-1,1),(4,'roof_flat',0,0,1,1,1,-1,1),(4,'roof_flat',0,0,1,2,1,1,1),(4,'roof_flat',0,0,1,3,-1,1,1),
  (4,'roof_back',0,-1,2,0,-1,-1,1),(4,'roof_back',0,-1,2,1,1,-1,1),(4,'roof_back',0,-1,2,2,1,0,2),(4,'roof_back',0,-1,2,3,-1,0,2),
  (5,'roof_front',0,1,2,0,1,1,1),(5,'roof_front',0,1,2,1,-1,1,1),(5,'roof_front',0,1,2,2,-1,0,2),(5,'roof_front',0,1,2,3,1,0,2)),
verts AS (
  SELECT b.*, c.face AS facade_index, c.label, k,
    sx * width / 2 * cos(radians(heading_deg)) - sy * depth / 2 * sin(radians(heading_deg)) AS px, sx * width / 2 * sin(radians(heading_deg)) + sy * depth / 2 * cos(radians(heading_deg)) AS py,
    CASE top WHEN 0 THEN 0e0 WHEN 1 THEN height ELSE height + depth / 2 * tan(radians(roof_pitch_deg)) END AS pz,
    CASE lz WHEN 2 THEN ly * sin(radians(roof_pitch_deg)) ELSE ly END AS qy, lx AS qx, CASE lz WHEN 2 THEN cos(radians(roof_pitch_deg)) ELSE lz END AS nz
  FROM buildings b JOIN corner c ON (c.lz = 0) OR (c.lz = 1 AND roof_type = 'flat') OR (c.lz = 2 AND roof_type = 'pitched')),
turned AS (SELECT *, qx * cos(radians(heading_deg)) - qy * sin(radians(heading_deg)) AS nx, qx * sin(radians(heading_deg)) + qy * cos(radians(heading_deg)) AS ny FROM verts),
facades AS (
  SELECT building_id, facade_index, label, CASE WHEN nz = 0 THEN '21.1' ELSE '47.1' END AS component_tag, nx, ny, CAST(nz AS DOUBLE) AS nz, avg(px) AS cx, avg(py) AS cy, avg(pz) AS cz,
    CASE WHEN sqrt(nx*nx+ny*ny) < 1e-9 THEN greatest(max(px)-min(px), max(py)-min(py)) ELSE max((py*nx-px*ny)/sqrt(nx*nx+ny*ny)) - min((py*nx-px*ny)/sqrt(nx*nx+ny*ny)) END AS width_m,
    CASE WHEN abs(nz) > 0.99 THEN least(max(px)-min(px), max(py)-min(py)) WHEN abs(nz) < 0.01 THEN max(pz)-min(pz) ELSE (max(pz)-min(pz))/sqrt(1-nz*nz) END AS height_m,
    list({{'px': px, 'py': py, 'pz': pz}}) AS vs
  FROM turned GROUP BY building_id, facade_index, label, nx, ny, nz)"""

#: The photo grid before those faces.
GRID_SQL = """
cam AS (SELECT 12e0 * 2 * 5280 / (17.3e0 * 1000) AS d),
fr AS (
  SELECT f.*, d, (1 - 0.5e0) * d * 17.3e0 / 12 AS hs, (1 - 0.6e0) * d * 13e0 / 12 AS vs_, sqrt(nx*nx+ny*ny) AS fl,
    abs(nz) > 0.99 OR sqrt(nx*nx+ny*ny) < 1e-6 AS lev FROM facades f, cam),
ax AS (SELECT *, CASE WHEN lev THEN 1e0 ELSE -ny/fl END AS ux, CASE WHEN lev THEN 0e0 ELSE nx/fl END AS uy, CASE WHEN lev THEN 0e0 ELSE -nx*nz/fl END AS vx,
         CASE WHEN lev THEN 1e0 ELSE -ny*nz/fl END AS vy, CASE WHEN lev THEN 0e0 ELSE fl END AS vz FROM fr),
ext AS (SELECT *, list_transform(vs, lambda p: (p.px-cx)*ux + (p.py-cy)*uy) AS us, list_transform(vs, lambda p: (p.px-cx)*vx + (p.py-cy)*vy + (p.pz-cz)*vz) AS ws FROM ax),
ins AS (SELECT *, least(0.1e0, 0.25e0*(list_max(us)-list_min(us)), 0.25e0*(list_max(ws)-list_min(ws))) AS i FROM ext),
lim AS (SELECT *, list_min(us)+i AS u0, list_max(us)-i AS u1, list_min(ws)+i AS v0, list_max(ws)-i AS v1 FROM ins),
cnt AS (SELECT *, greatest(1, CAST(ceil((u1-u0)/hs) AS INT)+1) AS ncol, greatest(1, CAST(ceil((v1-v0)/vs_) AS INT)+1) AS nrow FROM lim),
st AS (SELECT *, (u0+u1)/2-(ncol-1)*hs/2 AS us0, (v0+v1)/2-(nrow-1)*vs_/2 AS vs0 FROM cnt),
rw AS (SELECT st.*, r, greatest(cz+(vs0+r*vs_)*vz+d*nz, 2e0) AS camz, greatest(cz+vs0*vz+d*nz, 2e0) AS camz0 FROM (SELECT *, unnest(range(nrow)) AS r FROM st) st),
kept AS (SELECT *, row_number() OVER (PARTITION BY building_id, facade_index ORDER BY r) - 1 AS row FROM rw WHERE abs(nz) > 0.99 OR r = 0 OR camz - camz0 >= 0.01),
cl AS (SELECT *, CASE WHEN row % 2 = 0 THEN step ELSE ncol-1-step END AS col FROM (SELECT *, unnest(range(ncol)) AS step FROM kept)),
tg AS (SELECT *, cx+(us0+col*hs)*ux+(vs0+r*vs_)*vx AS tx, cy+(us0+col*hs)*uy+(vs0+r*vs_)*vy AS ty, cz+(vs0+r*vs_)*vz AS tz FROM cl),
wp AS (SELECT *, tx+d*nx AS x, ty+d*ny AS y, greatest(tz+d*nz, 2e0) AS z FROM tg),
grid AS (SELECT building_id, facade_index, row*ncol+step AS seq, row, col, x, y, z,
    degrees(atan2(tx-x, ty-y)) - 360*floor(degrees(atan2(tx-x, ty-y))/360) AS heading_deg,
    greatest(-85e0, least(30e0, CASE WHEN sqrt((tx-x)*(tx-x)+(ty-y)*(ty-y)) > 1e-6 THEN degrees(atan2(tz-z, sqrt((tx-x)*(tx-x)+(ty-y)*(ty-y)))) ELSE -90e0 END)) AS gimbal_pitch_deg, 3e0 AS speed_ms FROM wp)"""


def pmod360(x: str) -> str:
    return f"({x} - 360e0*floor(({x})/360e0))"


def fold180(x: str) -> str:
    """Circular distance of 0 and x, 0..180."""
    return f"(180e0 - abs({pmod360(x)} - 180e0))"
