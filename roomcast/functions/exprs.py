"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for identical results.
RSSI_MISSING = -100.0  # sentinel for "AP not heard" in raw tables and requests
RSSI_FILL = -110.0  # value a missing reading becomes after cleaning
RSSI_MIN = -110.0
RSSI_MAX = -30.0
IMU_FILL = 0.0
IMU_COLUMNS = [
    "accel_x", "accel_y", "accel_z",
    "gyro_x", "gyro_y", "gyro_z",
    "mag_x", "mag_y", "mag_z", "mag_heading",
]
BUILDING_ID = 10
METERS_PER_STEP = 0.8
WALK_SPEED_MPS = 1.3
TRANSFER_SECONDS = {"elevator": 20.0, "stairway": 35.0}
TRANSFER_SECONDS_OTHER = 30.0
DEFAULT_ROOM_ALIASES = {"E1": "elevator1", "E2": "elevator2"}
CONFIDENCE_THRESHOLD = 0.60
TRANSITION_HITS_REQUIRED = 2


def clean_rssi(c: Column, missing=RSSI_MISSING, fill=RSSI_FILL, lo=RSSI_MIN, hi=RSSI_MAX) -> Column:
    """Null or the missing sentinel become ``fill``; then clip to [lo, hi].

    NaN is turned into null first: Spark orders NaN above every number, so an
    unwrapped clip would turn it into ``hi``.
    """
    v = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    filled = F.when(v.isNull() | (v == F.lit(missing)), F.lit(fill)).otherwise(v)
    return F.greatest(F.lit(lo), F.least(F.lit(hi), filled))


def ap_sort_key(name: Column) -> Column:
    """Order of AP feature names: numeric suffixes first, numerically, then the rest by name."""
    suffix = F.substring(name, 3, 1 << 20)
    is_num = suffix.rlike("^[0-9]+$")
    return F.struct(
        F.when(is_num, F.lit(0)).otherwise(F.lit(1)).alias("kind"),
        F.when(is_num, suffix.cast("decimal(38,0)")).alias("num"),
        F.when(~is_num, suffix).alias("text"),
    )


def connector_key(type_col: Column, id_col: Column) -> Column:
    """``type:digits`` of a connector id, ``type:id`` when it has no digit; lower case."""
    rid = F.lower(id_col.cast("string"))
    digits = F.regexp_replace(rid, "[^0-9]", "")
    return F.concat_ws(":", F.lower(type_col), F.coalesce(F.nullif(digits, F.lit("")), rid))


def floor_from_room_id(id_col: Column) -> Column:
    """Second dotted number of ids like ``10.2.15A``; null when absent."""
    grp = F.regexp_extract(id_col, r"^\d+\.(\d+)\.", 1)
    return F.nullif(grp, F.lit("")).try_cast("int")


def floor_from_plan_text(floor_col: Column, plan_col: Column) -> Column:
    """Explicit floor when castable, else ``level1``/``level 1`` -> 1, ``level2``/``level 2`` -> 2."""
    txt = F.lower(plan_col.cast("string"))
    by_text = (
        F.when(txt.contains("level1") | txt.contains("level 1"), F.lit(1))
        .when(txt.contains("level2") | txt.contains("level 2"), F.lit(2))
    )
    return F.coalesce(F.trim(floor_col.cast("string")).try_cast("int"), by_text)


def steps_distance(steps: Column) -> Column:
    return steps * F.lit(METERS_PER_STEP)


def steps_time(steps: Column) -> Column:
    return steps * F.lit(METERS_PER_STEP) / F.lit(WALK_SPEED_MPS)


def transfer_seconds(type_col: Column) -> Column:
    t = F.lower(type_col)
    expr = F.lit(TRANSFER_SECONDS_OTHER)
    for name, secs in TRANSFER_SECONDS.items():
        expr = F.when(t == name, F.lit(secs)).otherwise(expr)
    return expr


def r6(c: Column) -> Column:
    """Round to 6 places as ``floor(x * 1e6 + 0.5) / 1e6``.

    Summation order differs between engines, so compared outputs are rounded;
    this form is plain IEEE arithmetic, identical in every engine (``round``
    itself differs: Spark rounds the decimal string half-up).
    """
    return F.floor(c * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)
