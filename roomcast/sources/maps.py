"""Map sources: room records, walkable-mask pixels and mask manifests.

Two kinds of input:

* the reference's own JSON formats (room arrays per floor, manifests in
  three shapes) read with ``spark.read.text(wholetext=True)`` + ``from_json``
  and ``posexplode`` so the record ordinal survives (last-wins needs it);
* fixture tables derived from the driver's tables (rules below, identical in
  the SQL oracles):

  - pixels from ``part``: floor = ``p_partkey % 2 + 1``, cell id = ``p_partkey div 2``,
    width ``w = isqrt(count(part) div 2)``, y = id div w, x = id % w,
    grey = ``128 + p_size`` when ``p_size > 5`` else ``p_size``;
  - rooms from ``supplier``: floor = ``s_suppkey % 2 + 1``, type by ``s_suppkey % 5``
    (0 elevator, 1 stairway, else room), grid position
    ``y = (7 * s_suppkey) % w``, ``x = (13 * s_suppkey) % w``; stairways are not
    accessible; ids ``elevator<k>``, ``stair<k>``, ``10.<floor>.<k>``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomcast.sources.tables import table

ROOM_SCHEMA = T.StructType([
    T.StructField("room_id", T.StringType()),
    T.StructField("floor", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("accessible", T.BooleanType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("x1", T.DoubleType()),
    T.StructField("y1", T.DoubleType()),
    T.StructField("x2", T.DoubleType()),
    T.StructField("y2", T.DoubleType()),
    T.StructField("floor_plan", T.StringType()),
    T.StructField("center_x", T.DoubleType()),
    T.StructField("center_y", T.DoubleType()),
    T.StructField("grid_spacing", T.DoubleType()),
])

MANIFEST_ENTRY = T.StructType([
    T.StructField("floor_plan", T.StringType()),
    T.StructField("walkable_mask", T.StringType()),
    T.StructField("width", T.DoubleType()),
    T.StructField("height", T.DoubleType()),
    T.StructField("grid_spacing", T.DoubleType()),
    T.StructField("origin", T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])),
    T.StructField("origin_x", T.DoubleType()),
    T.StructField("origin_y", T.DoubleType()),
    T.StructField("floor", T.StringType()),
])


def read_floor_records(spark: SparkSession, paths_by_floor: dict[int, str]) -> DataFrame:
    """S3: JSON arrays of room records, floors ascending; ``(file_ord, pos, record...)``.

    A file that does not hold a JSON array raises.  Elements that are not objects are
    skipped; ``pos`` is the element's ordinal in the file.  ``floor`` is cast to int when
    it can be; ``room_id`` is trimmed.
    """
    frames = []
    for i, fl in enumerate(sorted(paths_by_floor)):
        txt = spark.read.text(paths_by_floor[fl], wholetext=True).select(F.trim(F.regexp_replace("value", r"^\s+", "")).alias("v"))
        items = F.when(F.col("v").startswith("["), F.from_json("v", T.ArrayType(T.StringType())))
        items = F.coalesce(items, F.raise_error(F.lit(f"room file of floor {fl} is not a JSON array")).cast("array<string>"))
        one = txt.select(F.lit(i).alias("file_ord"), F.posexplode(items).alias("pos", "item"))
        one = one.where(F.ltrim("item").startswith("{"))
        frames.append(one.select("file_ord", "pos", F.from_json("item", ROOM_SCHEMA).alias("r")))
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    return df.select(
        "file_ord", "pos", F.trim("r.room_id").alias("room_id"),
        F.trim("r.floor").try_cast("int").alias("floor"),
        F.lower("r.type").alias("type"), F.coalesce("r.accessible", F.lit(False)).alias("accessible"),
        "r.x", "r.y", "r.x1", "r.y1", "r.x2", "r.y2", "r.floor_plan", "r.center_x", "r.center_y", "r.grid_spacing",
    )


def read_manifests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union of manifest entries in file order; list, {floors: list}, {floors: dict} or dict of dicts."""
    frames = []
    for i, p in enumerate(sorted(paths)):
        txt = spark.read.text(p, wholetext=True).select(F.trim("value").alias("v"))
        as_list = F.from_json("v", T.ArrayType(MANIFEST_ENTRY))
        floors_list = F.from_json(F.get_json_object("v", "$.floors"), T.ArrayType(MANIFEST_ENTRY))
        floors_map = F.from_json(F.get_json_object("v", "$.floors"), T.MapType(T.StringType(), MANIFEST_ENTRY))
        bare_map = F.from_json("v", T.MapType(T.StringType(), MANIFEST_ENTRY))
        entries = (
            F.when(F.col("v").startswith("["), as_list)
            .when(floors_list.isNotNull(), floors_list)
            .when(floors_map.isNotNull(), F.map_values(floors_map))
            .otherwise(F.map_values(bare_map))
        )
        frames.append(txt.select(F.lit(i).alias("file_ord"), F.posexplode(entries).alias("pos", "m")))
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    return df.select("file_ord", "pos", "m.*")


# --- fixtures on the driver's tables ---------------------------------------------------


def grid_width(spark: SparkSession, sf: str) -> int:
    n = table(spark, sf, "part").count()
    return max(1, math.isqrt(n // 2))


def pixels(spark: SparkSession, sf: str, w: int) -> DataFrame:
    p = table(spark, sf, "part")
    cid = (F.col("p_partkey") / 2).cast("long")  # p_partkey div 2 (keys are non-negative)
    return p.select(
        (F.col("p_partkey") % 2 + 1).cast("int").alias("floor"),
        (cid / w).cast("long").cast("int").alias("y"),
        (cid % w).cast("int").alias("x"),
        F.when(F.col("p_size") > 5, F.col("p_size") + 128).otherwise(F.col("p_size")).cast("int").alias("grey"),
    )


def room_kind(k: Column) -> Column:
    return F.when(k % 5 == 0, F.lit("elevator")).when(k % 5 == 1, F.lit("stairway")).otherwise(F.lit("room"))


def room_id(k: Column) -> Column:
    """The id of the fixture's room number ``k``."""
    kind, floor = room_kind(k), (k % 2 + 1).cast("int")
    return (
        F.when(kind == "elevator", F.concat(F.lit("elevator"), k.cast("string")))
        .when(kind == "stairway", F.concat(F.lit("stair"), k.cast("string")))
        .otherwise(F.concat(F.lit("10."), floor.cast("string"), F.lit("."), k.cast("string")))
    )


def rooms(spark: SparkSession, sf: str, w: int) -> DataFrame:
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    kind, floor = room_kind(k), (k % 2 + 1).cast("int")
    return s.select(
        k.alias("ord"), room_id(k).alias("room_id"), floor.alias("floor"), kind.alias("type"),
        (kind != "stairway").alias("accessible"),
        ((k * 7) % w).cast("int").alias("y"), ((k * 13) % w).cast("int").alias("x"),
    )
