"""From records and poses to cells: floor metadata, origins, room and pose cells; dictionaries of names and devices."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomcast.functions.exprs import floor_from_plan_text, r6
from roomcast.operators import dictionary as D
from roomcast.operators import grid as G
from roomcast.plans.q_maps import W_SQL
from roomcast.plans.q_routes import PIX_SQL
from roomcast.plans.registry import register
from roomcast.session import materialize
from roomcast.sources import maps
from roomcast.sources.tables import table

#: Floors of the fixture that need metadata; only the first two have a mask.
FLOORS = [0, 1, 2, 3, 4]


def manifest(spark, sf):
    """Manifest entries from ``nation``: plan text and explicit floor as in ``manifest_pick``; sizes, spacing and origin
    are missing in turn, and one size in four is 0."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    n = table(spark, sf, "nation")
    plan = F.concat(F.lit("Level"), (r % 3).cast("string"), F.lit(" plan "), F.col("n_name"))
    floor = F.when(k % 2 == 0, (r % 3).cast("string")).otherwise(F.concat(F.lit("x"), r.cast("string")))
    none = F.lit(None).cast("double")
    return n.select(
        k.alias("ord"), floor_from_plan_text(floor, plan).alias("pfloor"), F.lower(F.concat_ws(" ", plan, floor)).alias("txt"),
        F.when(k % 4 == 1, 0.0).when(k % 4 > 1, 50.0 + 10.0 * k).alias("width"), F.when(k % 3 > 0, 80.0 + k).alias("height"),
        F.when(k % 5 > 0, 1.5 + k % 3).alias("grid_spacing"),
        F.when(k % 2 == 0, F.struct((k * 1.5).alias("x"), none.alias("y"))).alias("origin"),
        F.when(k % 2 == 1, k + 0.5).alias("origin_x"), F.when(k % 3 == 1, k * 2.0).alias("origin_y"),
    )


def records(spark, sf):
    """Room records from ``supplier`` on floors 1 to 4 and, one in eleven, on none; grid coordinates around the origin,
    centres on every third record but those of floor 4."""
    k = F.col("s_suppkey")
    floor = F.when(k % 11 > 0, (k % 4 + 1).cast("int"))
    centred = (k % 3 == 0) & (k % 4 < 3)
    return table(spark, sf, "supplier").select(
        k.alias("ord"), maps.room_id(k).alias("room_id"), floor.alias("floor"),
        F.when(k % 13 > 0, F.col("s_nationkey") - 12 + (k % 2) * 0.5).alias("x"), (k % 7 - 3).cast("double").alias("y"),
        F.when(centred, F.col("s_nationkey") + 20.5).alias("center_x"), F.when(centred, k % 50 + 0.25).alias("center_y"),
        F.when(k % 2 == 0, 3.0 + k % 3).alias("grid_spacing"),
    )


def floor_places(spark, sf, w):
    floors = spark.createDataFrame([(f,) for f in FLOORS], "floor int").select("floor", F.lit(w).alias("mask_w"), F.lit(w).alias("mask_h"))
    return G.origin_and_spacing(G.pick_floor_meta(manifest(spark, sf), records(spark, sf), floors))


META_SQL = f"""
man AS (SELECT n_nationkey AS ord, 'Level' || CAST(n_regionkey % 3 AS VARCHAR) || ' plan ' || n_name AS plan,
               CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_regionkey % 3 AS VARCHAR) ELSE 'x' || CAST(n_regionkey AS VARCHAR) END AS ftxt,
               CASE WHEN n_nationkey % 4 = 1 THEN 0.0 WHEN n_nationkey % 4 > 1 THEN 50.0 + 10.0 * n_nationkey END::DOUBLE AS width,
               CASE WHEN n_nationkey % 3 > 0 THEN 80.0 + n_nationkey END::DOUBLE AS height, CASE WHEN n_nationkey % 5 > 0 THEN 1.5 + n_nationkey % 3 END::DOUBLE AS gs,
               CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 1.5 ELSE n_nationkey + 0.5 END::DOUBLE AS ox, CASE WHEN n_nationkey % 3 = 1 THEN n_nationkey * 2.0 END::DOUBLE AS oy
        FROM nation),
recs AS (SELECT s_suppkey AS ord, CASE WHEN s_suppkey % 11 > 0 THEN CAST(s_suppkey % 4 + 1 AS INTEGER) END AS floor,
                CASE WHEN s_suppkey % 13 > 0 THEN s_nationkey - 12 + (s_suppkey % 2) * 0.5 END::DOUBLE AS x, (s_suppkey % 7 - 3)::DOUBLE AS y,
                CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 4 < 3 THEN s_nationkey + 20.5 END::DOUBLE AS cx,
                CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 4 < 3 THEN s_suppkey % 50 + 0.25 END::DOUBLE AS cy,
                CASE WHEN s_suppkey % 2 = 0 THEN 3.0 + s_suppkey % 3 END::DOUBLE AS gs,
                CASE WHEN s_suppkey % 5 = 0 THEN 'elevator' || CAST(s_suppkey AS VARCHAR) WHEN s_suppkey % 5 = 1 THEN 'stair' || CAST(s_suppkey AS VARCHAR)
                     ELSE '10.' || CAST(CAST(s_suppkey % 2 + 1 AS INTEGER) AS VARCHAR) || '.' || CAST(s_suppkey AS VARCHAR) END AS room_id
         FROM supplier),
fl AS (SELECT unnest({FLOORS}) AS floor, {W_SQL}::DOUBLE AS m),
tiers AS (
  SELECT f.floor, f.m, 1 AS tier, p.ord, p.width, p.height, p.gs, p.ox, p.oy FROM fl f JOIN man p
    ON coalesce(TRY_CAST(trim(ftxt) AS INTEGER), CASE WHEN contains(lower(plan), 'level1') THEN 1 WHEN contains(lower(plan), 'level2') THEN 2 END) = f.floor
  UNION ALL SELECT f.floor, f.m, 2, p.ord, p.width, p.height, p.gs, p.ox, p.oy FROM fl f JOIN man p ON contains(lower(plan || ' ' || ftxt), 'level' || CAST(f.floor AS VARCHAR))
  UNION ALL SELECT f.floor, f.m, 3, r.ord, f.m, f.m, r.gs, r.cx, r.cy FROM fl f JOIN recs r ON r.floor = f.floor WHERE r.cx IS NOT NULL AND r.cy IS NOT NULL),
first AS (SELECT * FROM tiers QUALIFY row_number() OVER (PARTITION BY floor ORDER BY tier, ord) = 1),
sized AS (SELECT *, coalesce(width, m) AS w, coalesce(height, m) AS h FROM first),
scaled AS (SELECT *, CASE WHEN w <> 0 THEN m / w ELSE 1.0::DOUBLE END AS sx, CASE WHEN h <> 0 THEN m / h ELSE 1.0::DOUBLE END AS sy FROM sized),
meta AS (SELECT floor, tier, coalesce(ox, w / 2) * sx AS origin_x, coalesce(oy, h / 2) * sy AS origin_y, coalesce(gs, 40.0::DOUBLE) * ((sx + sy) / 2.0::DOUBLE) AS spacing FROM scaled)
"""

_FREE_SQL = f"{PIX_SQL}, free AS (SELECT floor, y, x FROM wpix WHERE walkable)"


def _snap_sql(radius: int) -> str:
    return f"""
hits AS (SELECT p.floor, p.gy, p.gx, f.y, f.x, greatest(abs(f.y - p.gy), abs(f.x - p.gx)) AS cheb
         FROM (SELECT DISTINCT floor, gy, gx FROM starts WHERE error IS NULL) p
         JOIN free f ON f.floor = p.floor AND abs(f.y - p.gy) <= {radius} AND abs(f.x - p.gx) <= {radius}),
snap AS (SELECT floor, gy, gx, arg_min(y, (cheb, y, x)) AS cy, arg_min(x, (cheb, y, x)) AS cx FROM hits GROUP BY 1, 2, 3),
placed AS (SELECT s.*, n.cy, n.cx,
                  coalesce(s.error, CASE WHEN s.floor NOT IN (SELECT floor FROM wpix) THEN 'no_mask' WHEN n.cy IS NULL THEN 'blocked' END) AS reason
           FROM starts s LEFT JOIN snap n ON n.floor = s.floor AND n.gy = s.gy AND n.gx = s.gx)"""


@register("floor_meta", sql=f"""
WITH {META_SQL}
SELECT CAST(floor AS INTEGER) AS floor, tier, round(origin_x, 6) AS origin_x, round(origin_y, 6) AS origin_y, round(spacing, 6) AS spacing FROM meta
""")
def floor_meta(spark, sf):
    """J9 + P19: metadata of each floor by manifest floor, manifest text or first room with a centre; origin and spacing in mask pixels."""
    m = floor_places(spark, sf, maps.grid_width(spark, sf))
    return m.select("floor", "tier", *(r6(F.col(c)).alias(c) for c in ("origin_x", "origin_y", "spacing")))


def _divide_sql(a: str, b: str) -> str:
    q = f"(({a} - {a} % {b}) / {b} - CASE WHEN {a} % {b} <> 0 AND ({a} % {b} < 0) <> ({b} < 0) THEN 1.0 ELSE 0.0 END)"
    return f"CAST(floor({q} + CASE WHEN {q} - floor({q}) > 0.5 THEN 1.0 ELSE 0.0 END) AS INTEGER)"


@register("room_cells", sql=f"""
WITH {META_SQL}, {_FREE_SQL},
px AS (SELECT r.room_id, r.floor, m.floor AS mf, m.spacing, m.origin_x + coalesce(r.x, 0.0) * m.spacing AS px, m.origin_y + coalesce(r.y, 0.0) * m.spacing AS py
       FROM recs r LEFT JOIN meta m ON m.floor = r.floor),
starts AS (SELECT room_id, floor, CASE WHEN spacing <> 0 THEN {_divide_sql('py', 'spacing')} END AS gy, CASE WHEN spacing <> 0 THEN {_divide_sql('px', 'spacing')} END AS gx,
                  CASE WHEN floor IS NULL THEN 'bad_floor' WHEN mf IS NULL THEN 'no_meta' WHEN spacing = 0 THEN 'bad_spacing' END AS error FROM px),
{_snap_sql(80)}
SELECT room_id, floor, gy, gx, cy, cx, reason AS error FROM placed
""")
def room_cells(spark, sf):
    """P20 + G2: every room record's cell from its floor's origin and spacing, moved to the nearest free cell, or the reason why not."""
    w = maps.grid_width(spark, sf)
    cells = materialize(G.walkable_pixels(maps.pixels(spark, sf, w)))
    return G.room_cells(records(spark, sf).select("room_id", "floor", "x", "y"), materialize(floor_places(spark, sf, w)), cells)


@register("pose_cells", sql=f"""
WITH {_FREE_SQL},
poses AS (SELECT event_id, CASE WHEN event_id % 17 > 0 THEN CAST(event_id % 3 + 1 AS INTEGER) END AS floor,
                 CASE WHEN event_id % 19 > 0 THEN (event_id % 41) * 0.5 END::DOUBLE AS x, ((user_id % 37) * 0.5 - 2)::DOUBLE AS y FROM events),
starts AS (SELECT event_id, floor, CAST(round_even(y, 0) AS INTEGER) AS gy, CAST(round_even(x, 0) AS INTEGER) AS gx,
                  CASE WHEN floor IS NULL THEN 'bad_floor' WHEN x IS NULL OR y IS NULL THEN 'bad_pose' END AS error FROM poses),
{_snap_sql(100)}
SELECT event_id, floor, gy, gx, cy, cx, reason AS error FROM placed
""")
def pose_cells(spark, sf):
    """P21 + G2: poses to cells, halves to the even cell, then to the nearest free one.  Poses come from ``events``."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    poses = e.select(
        "event_id", F.when(k % 17 > 0, (k % 3 + 1).cast("int")).alias("floor"),
        F.when(k % 19 > 0, (k % 41) * 0.5).alias("x"), ((F.col("user_id") % 37) * 0.5 - 2).alias("y"),
    )
    cells = materialize(G.walkable_pixels(maps.pixels(spark, sf, maps.grid_width(spark, sf))))
    return G.pose_cells(poses, cells, "event_id")


# --- dictionaries -------------------------------------------------------------------------


@register("bssid_dictionary", sql="""
WITH heard AS (SELECT 'bssid-' || CAST(l_partkey AS VARCHAR) AS name, min(CASE WHEN l_linenumber <= 2 THEN 1 WHEN l_linenumber <= 4 THEN 2 ELSE 3 END) AS version
               FROM lineitem GROUP BY 1)
SELECT name, row_number() OVER (ORDER BY version, name) - 1 AS id, version FROM heard
""")
def bssid_dictionary(spark, sf):
    """Stable ids of BSSIDs over three loads (lines up to 2, up to 4, all); a later load never changes an id."""
    lines = table(spark, sf, "lineitem").select(F.concat(F.lit("bssid-"), F.col("l_partkey").cast("string")).alias("name"), "l_linenumber")
    known = None
    for version, most in enumerate((2, 4, 1 << 30), 1):
        known = materialize(D.extend_ids(known, lines.where(F.col("l_linenumber") <= most), version))
    return known.select("name", F.col("id").cast("long").alias("id"), F.col("version").cast("int").alias("version"))


_DEVICE_SQL = "c_mktsegment || '/' || CAST(c_nationkey % 4 AS VARCHAR)"


@register("device_features", sql=f"""
WITH d AS (SELECT c_custkey AS scan_id, CASE WHEN c_custkey % 23 > 0 THEN {_DEVICE_SQL} END AS device, c_nationkey % 4 < 3 AND c_custkey % 5 > 0 AS fitted FROM customer),
cats AS (SELECT device, row_number() OVER (ORDER BY count(*) DESC, device) - 1 AS idx FROM d WHERE fitted AND device IS NOT NULL GROUP BY 1)
SELECT scan_id, 'device=' || coalesce(c.device, '?') AS feature, CAST(51 + coalesce(idx, (SELECT count(*) FROM cats)) AS INTEGER) AS pos, 1.0::DOUBLE AS value, 0.0::DOUBLE AS fill
FROM d LEFT JOIN cats c ON c.device = d.device
""")
def device_features(spark, sf):
    """Device as a one-hot covariate: categories fitted on the training rows, a slot for unseen devices, sparse rows behind 50 features."""
    k, nation = F.col("c_custkey"), F.col("c_nationkey") % 4
    device = F.concat_ws("/", "c_mktsegment", nation.cast("string"))
    d = table(spark, sf, "customer").select(k.alias("scan_id"), F.when(k % 23 > 0, device).alias("device"), ((nation < 3) & (k % 5 > 0)).alias("fitted"))
    categories = materialize(D.fit_categories(d.where("fitted"), "device"))
    return D.category_features(d, "device", categories, 51, "device")
