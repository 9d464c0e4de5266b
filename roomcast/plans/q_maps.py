"""Room-map queries: last-wins index, id parsing, connector keys, manifest choice, ranked choice, label audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomcast.functions.exprs import connector_key, floor_from_plan_text, floor_from_room_id
from roomcast.plans.registry import register
from roomcast.sources import maps
from roomcast.sources.tables import table

W_SQL = "(SELECT CAST(floor(sqrt(count(*) // 2)) AS INTEGER) AS w FROM part)"

ROOMS_SQL = f"""
rooms AS (
  SELECT s_suppkey AS ord,
         CASE WHEN s_suppkey % 5 = 0 THEN 'elevator' || CAST(s_suppkey AS VARCHAR)
              WHEN s_suppkey % 5 = 1 THEN 'stair' || CAST(s_suppkey AS VARCHAR)
              ELSE '10.' || CAST(CAST(s_suppkey % 2 + 1 AS INTEGER) AS VARCHAR) || '.' || CAST(s_suppkey AS VARCHAR) END AS room_id,
         CAST(s_suppkey % 2 + 1 AS INTEGER) AS floor,
         CASE WHEN s_suppkey % 5 = 0 THEN 'elevator' WHEN s_suppkey % 5 = 1 THEN 'stairway' ELSE 'room' END AS type,
         s_suppkey % 5 <> 1 AS accessible,
         CAST((s_suppkey * 7) % {W_SQL} AS INTEGER) AS y, CAST((s_suppkey * 13) % {W_SQL} AS INTEGER) AS x
  FROM supplier)
"""

# Room records with colliding ids: id = '10.<floor>.<k % 50>' so later suppliers
# overwrite earlier ones (the duplicate-id case of the shipped map).
DUP_SQL = """
recs AS (SELECT s_suppkey AS ord, '10.' || CAST(s_suppkey % 2 + 1 AS VARCHAR) || '.' || CAST(s_suppkey % 50 AS VARCHAR) AS room_id,
                s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier)
"""


def _recs(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("ord"),
        F.concat(F.lit("10."), (k % 2 + 1).cast("string"), F.lit("."), (k % 50).cast("string")).alias("room_id"),
        F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"),
    )


@register("room_index_last_wins", sql=f"""
WITH {DUP_SQL}
SELECT room_id, arg_max(ord, ord) AS ord, arg_max(x, ord) AS x, arg_max(y, ord) AS y FROM recs
WHERE trim(room_id) <> '' GROUP BY 1
""")
def room_index_last_wins(spark, sf):
    """Room index by trimmed id; on duplicates the last record wins.

    ``max_by`` over the record ordinal is a partial aggregate, so a hot id never
    lands whole in one task.
    """
    r = _recs(spark, sf).withColumn("room_id", F.trim("room_id")).where(F.col("room_id") != "")
    last = r.groupBy("room_id").agg(F.max_by(F.struct("ord", "x", "y"), "ord").alias("r"))
    return last.select("room_id", "r.ord", "r.x", "r.y")


@register("floor_from_id", sql=f"""
WITH {ROOMS_SQL}
SELECT room_id, TRY_CAST(nullif(regexp_extract(room_id, '^\\d+\\.(\\d+)\\.', 1), '') AS INTEGER) AS parsed_floor FROM rooms
""")
def floor_from_id(spark, sf):
    """Floor parsed from ids like ``10.2.15``; null for connector ids."""
    r = maps.rooms(spark, sf, maps.grid_width(spark, sf))
    return r.select("room_id", floor_from_room_id(F.col("room_id")).alias("parsed_floor"))


@register("connector_key", sql=f"""
WITH {ROOMS_SQL}
SELECT room_id, type,
       lower(type) || ':' || coalesce(nullif(regexp_replace(lower(room_id), '[^0-9]', '', 'g'), ''), lower(room_id)) AS ckey
FROM rooms WHERE type IN ('elevator', 'stairway')
""")
def connector_key_q(spark, sf):
    """P15 + P17: connector keys (``type:digits``) of the elevator and stairway records."""
    r = maps.rooms(spark, sf, maps.grid_width(spark, sf)).where(F.col("type").isin("elevator", "stairway"))
    return r.select("room_id", "type", connector_key(F.col("type"), F.col("room_id")).alias("ckey"))


MANIFEST_SQL = """
man AS (SELECT n_nationkey AS ord,
               'Level' || CAST(n_regionkey % 3 AS VARCHAR) || ' plan ' || n_name AS floor_plan,
               CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_regionkey % 3 AS VARCHAR) ELSE 'x' || CAST(n_regionkey AS VARCHAR) END AS floor_txt
        FROM nation),
parsed AS (SELECT *, coalesce(TRY_CAST(trim(floor_txt) AS INTEGER),
                              CASE WHEN contains(lower(floor_plan), 'level1') OR contains(lower(floor_plan), 'level 1') THEN 1
                                   WHEN contains(lower(floor_plan), 'level2') OR contains(lower(floor_plan), 'level 2') THEN 2 END) AS pfloor
           FROM man),
want AS (SELECT unnest([1, 2, 3]) AS floor),
cand AS (SELECT w.floor, 1 AS tier, p.ord FROM want w JOIN parsed p ON p.pfloor = w.floor
         UNION ALL
         SELECT w.floor, 2, p.ord FROM want w JOIN parsed p
           ON contains(lower(p.floor_plan || ' ' || p.floor_txt), 'level' || CAST(w.floor AS VARCHAR)))
"""


@register("manifest_pick", sql=f"""
WITH {MANIFEST_SQL}
SELECT floor, arg_min(tier, (tier, ord)) AS tier, arg_min(ord, (tier, ord)) AS entry_ord FROM cand GROUP BY 1
""")
def manifest_pick(spark, sf):
    """J9 + P16: per floor the first manifest entry whose parsed floor matches, else the
    first whose text mentions ``level<floor>``; floors with neither are absent
    (the room-centre fallback then applies).

    Entries come from ``nation``: floor_plan ``Level<r%3> plan <name>``, an explicit
    floor only on even keys.
    """
    n = table(spark, sf, "nation")
    man = n.select(
        F.col("n_nationkey").alias("ord"),
        F.concat(F.lit("Level"), (F.col("n_regionkey") % 3).cast("string"), F.lit(" plan "), F.col("n_name")).alias("floor_plan"),
        F.when(F.col("n_nationkey") % 2 == 0, (F.col("n_regionkey") % 3).cast("string"))
        .otherwise(F.concat(F.lit("x"), F.col("n_regionkey").cast("string"))).alias("floor_txt"),
    )
    parsed = man.withColumn("pfloor", floor_from_plan_text(F.col("floor_txt"), F.col("floor_plan")))
    want = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    text = F.lower(F.concat_ws(" ", "floor_plan", "floor_txt"))
    tiers = parsed.select("ord", "pfloor", text.alias("txt"), want.alias("floor"))
    cand = tiers.where(F.col("pfloor") == F.col("floor")).select("floor", F.lit(1).alias("tier"), "ord").unionByName(
        tiers.where(F.col("txt").contains(F.concat(F.lit("level"), F.col("floor").cast("string")))).select(
            "floor", F.lit(2).alias("tier"), "ord"
        )
    )
    best = cand.groupBy("floor").agg(F.min(F.struct("tier", "ord")).alias("b"))
    return best.select("floor", F.col("b.tier").alias("tier"), F.col("b.ord").alias("entry_ord"))


@register("ranked_choice", sql="""
WITH c AS (SELECT p_brand, lower(p_name) AS name,
                  CASE WHEN lower(p_name) = 'red widget' THEN 1000 ELSE 0 END
                  + 10 * ((CASE WHEN contains(lower(p_name), 'red') THEN 1 ELSE 0 END)
                        + (CASE WHEN contains(lower(p_name), 'widget') THEN 1 ELSE 0 END)
                        + (CASE WHEN contains(lower(p_name), 'small') THEN 1 ELSE 0 END)) AS score
           FROM part)
SELECT p_brand, arg_min(name, (-score, name)) AS best_name, max(score) AS score FROM c GROUP BY 1
""")
def ranked_choice(spark, sf):
    """Per group the candidate with the highest score (+1000 exact preferred name,
    +10 per hint contained), ties to the smallest name.  Groups = brands, candidates = part names."""
    p = table(spark, sf, "part")
    name = F.lower("p_name")
    hints = ["red", "widget", "small"]
    score = F.when(name == "red widget", F.lit(1000)).otherwise(F.lit(0))
    for h in hints:
        score = score + F.when(name.contains(h), F.lit(10)).otherwise(F.lit(0))
    c = p.select("p_brand", name.alias("name"), score.alias("score"))
    best = c.groupBy("p_brand").agg(F.min(F.struct((-F.col("score")).alias("ns"), F.col("name"))).alias("b"), F.max("score").alias("score"))
    return best.select("p_brand", F.col("b.name").alias("best_name"), "score")


@register("label_coverage", sql=f"""
WITH {ROOMS_SQL},
labels AS (SELECT DISTINCT '10.' || CAST(n_nationkey % 2 + 1 AS VARCHAR) || '.' || CAST(n_nationkey AS VARCHAR) AS label FROM nation),
idx AS (SELECT DISTINCT trim(room_id) AS room_id FROM rooms)
SELECT l.label, l.label IN (SELECT room_id FROM idx) AS mapped FROM labels l
""")
def label_coverage(spark, sf):
    """U3 + J4: which model labels have a map record (semi join) and which never can (anti join)."""
    n = table(spark, sf, "nation")
    labels = n.select(
        F.concat(F.lit("10."), (F.col("n_nationkey") % 2 + 1).cast("string"), F.lit("."), F.col("n_nationkey").cast("string")).alias("label")
    ).distinct()
    idx = maps.rooms(spark, sf, maps.grid_width(spark, sf)).select(F.trim("room_id").alias("label")).distinct()
    mapped = labels.join(idx, "label", "left_semi").withColumn("mapped", F.lit(True))
    unmapped = labels.join(idx, "label", "left_anti").withColumn("mapped", F.lit(False))
    return mapped.unionByName(unmapped)
