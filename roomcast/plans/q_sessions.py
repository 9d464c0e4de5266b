"""Session queries: request / payload validation, candidate gate, confirmation decisions (batch + stream)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomcast.functions.exprs import DEFAULT_ROOM_ALIASES
from roomcast.operators import session as SS
from roomcast.operators.grid import best_routes
from roomcast.plans.q_routes import route_ctes, search
from roomcast.plans.registry import register
from roomcast.plans.sqlparts import CELLS
from roomcast.session import materialize, scalar
from roomcast.sources import maps
from roomcast.sources.tables import table

# --- fixture: events as localisation results --------------------------------------
# Fixed values of the fixture (room index and aliases), stated once:
ROOM_FLOOR = {"view": 1, "click": 1, "purchase": 2}  # 'signup' has no map record
ALIASES = dict(DEFAULT_ROOM_ALIASES, ERROR="purchase")  # caller-added alias on top of the defaults


def localisations(e):
    """Localisation results per event: top room = event type, confidence = least(value/100, 1),
    a second candidate ``view`` at least(value/200, 1); a value below 1 is a failed
    localisation; goal alternates with the hour; step-free access when value > 100."""
    conf = F.least(F.col("value") / 100.0, F.lit(1.0))
    cands = F.array(
        F.struct(F.col("event_type").alias("room_id"), conf.alias("probability")),
        F.struct(F.col("event_type").alias("room_id"), conf.alias("probability")),
        F.struct(F.lit("view").alias("room_id"), F.least(F.col("value") / 200.0, F.lit(1.0)).alias("probability")),
    )
    return e.select(
        F.col("user_id").alias("session_id"), "ts", "event_id",
        (F.col("value") < 1.0).alias("failed"), cands.alias("candidates"),
        F.when(F.hour("ts") % 2 == 0, F.lit("purchase")).otherwise(F.lit("view")).alias("goal"),
        (F.col("value") > 100.0).alias("accessible"),
    )


def gate(results):
    """Gated results; routing from ``click`` fails for step-free requests."""
    g = SS.candidate_gate(results, "candidates", ROOM_FLOOR, ALIASES)
    return g.withColumn("route_ok", ~((F.col("selected") == "click") & F.col("accessible")))


def gated_events(spark, sf):
    return gate(localisations(table(spark, sf, "events")))


GATE_SQL = """
ev AS (SELECT user_id AS session_id, ts, event_id, value < 1.0 AS failed,
              least(value / 100.0, 1.0) AS conf, least(value / 200.0, 1.0) AS conf2, event_type,
              CASE WHEN hour(ts) % 2 = 0 THEN 'purchase' ELSE 'view' END AS goal, value > 100.0 AS accessible
       FROM events),
cand AS (SELECT session_id, event_id, 1 AS ord, event_type AS room_id, conf AS prob FROM ev
         UNION ALL SELECT session_id, event_id, 2, event_type, conf FROM ev
         UNION ALL SELECT session_id, event_id, 3, 'view', conf2 FROM ev),
mapped AS (SELECT session_id, event_id, ord, prob,
                  CASE WHEN trim(room_id) = '' THEN trim(room_id)
                       ELSE coalesce(
                         CASE trim(room_id) WHEN 'E1' THEN 'elevator1' WHEN 'E2' THEN 'elevator2' WHEN 'ERROR' THEN 'purchase' END,
                         CASE upper(trim(room_id)) WHEN 'E1' THEN 'elevator1' WHEN 'E2' THEN 'elevator2' WHEN 'ERROR' THEN 'purchase' END,
                         trim(room_id)) END AS room_id
           FROM cand),
dedup AS (SELECT * FROM mapped QUALIFY row_number() OVER (PARTITION BY event_id, room_id, prob ORDER BY ord) = 1),
usable AS (SELECT *, CASE room_id WHEN 'view' THEN 1 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS rfloor
           FROM dedup WHERE room_id IN ('view', 'click', 'purchase')),
pick AS (SELECT event_id, count(*) AS n_usable,
                arg_min(CASE WHEN prob >= 0.6 THEN room_id END, CASE WHEN prob >= 0.6 THEN ord END) AS selected,
                arg_min(CASE WHEN prob >= 0.6 THEN prob END, CASE WHEN prob >= 0.6 THEN ord END) AS selected_prob,
                arg_min(CASE WHEN prob >= 0.6 THEN rfloor END, CASE WHEN prob >= 0.6 THEN ord END) AS selected_floor
         FROM usable GROUP BY 1),
gate AS (SELECT e.session_id, e.ts, e.event_id, e.failed, e.goal, e.accessible, p.selected, p.selected_prob, p.selected_floor,
                CASE WHEN coalesce(p.n_usable, 0) = 0 THEN 'no_mapped_candidate'
                     WHEN p.selected IS NULL THEN 'low_confidence' END AS reject,
                NOT (coalesce(p.selected = 'click', false) AND e.accessible) AS route_ok, true AS has_cell
         FROM ev e LEFT JOIN pick p USING (event_id))
"""


@register("candidate_gate", sql=f"""
WITH {GATE_SQL}
SELECT session_id, event_id, selected, round(selected_prob, 6) AS selected_prob, reject, selected_floor FROM gate
""")
def candidate_gate(spark, sf):
    """ST1 + P12 + W7: alias mapping, ordered de-duplication, first mapped candidate >= 0.60."""
    g = gated_events(spark, sf)
    from roomcast.functions.exprs import r6

    return g.select("session_id", "event_id", "selected", r6(F.col("selected_prob")).alias("selected_prob"), "reject", "selected_floor")


_STEPS_SQL = """
seq AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS rn FROM gate),
st AS (
  SELECT session_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS status,
         CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS selected_room_id, CAST(NULL AS INTEGER) AS selected_floor,
         false AS rerouted, CAST(NULL AS VARCHAR) AS active, CAST(NULL AS INTEGER) AS active_floor,
         CAST(NULL AS VARCHAR) AS pend, CAST(NULL AS INTEGER) AS pend_floor, 0 AS hits, CAST(NULL AS VARCHAR) AS last_goal
  FROM (SELECT DISTINCT session_id FROM seq)
  UNION ALL
  SELECT session_id, rn, event_id,
    CASE WHEN r1 OR r4 THEN 'error' WHEN r23 THEN 'hold' WHEN r6 THEN 'ok' WHEN r8 THEN 'hold' WHEN route_ok THEN 'ok' ELSE 'error' END,
    CASE WHEN r1 THEN 'localization_error' WHEN r23 THEN reject WHEN r4 THEN 'routing_error' WHEN r6 THEN 'rerouted' WHEN r8 THEN 'awaiting_confirmation'
         WHEN route_ok THEN 'rerouted' ELSE 'routing_error' END,
    CASE WHEN r1 OR r23 THEN NULL WHEN r6 THEN active ELSE sel END,
    CASE WHEN r1 OR r23 OR r4 THEN NULL WHEN r6 THEN active_floor WHEN r8 THEN sel_floor WHEN route_ok THEN sel_floor ELSE NULL END,
    (NOT r1 AND NOT r23 AND NOT r4 AND NOT r6 AND NOT r8 AND route_ok),
    CASE WHEN (r5 OR r7 OR r9) AND route_ok THEN sel ELSE active END,
    CASE WHEN (r5 OR r7 OR r9) AND route_ok THEN sel_floor ELSE active_floor END,
    CASE WHEN r1 OR r23 OR r4 THEN pend WHEN r5 THEN (CASE WHEN route_ok THEN NULL ELSE pend END) WHEN r6 OR r7 THEN NULL
         WHEN r8 THEN sel WHEN route_ok THEN NULL ELSE sel END,
    CASE WHEN r1 OR r23 OR r4 THEN pend_floor WHEN r5 THEN (CASE WHEN route_ok THEN NULL ELSE pend_floor END) WHEN r6 OR r7 THEN NULL
         WHEN r8 THEN sel_floor WHEN route_ok THEN NULL ELSE sel_floor END,
    CASE WHEN r1 OR r23 OR r4 THEN hits WHEN r5 THEN (CASE WHEN route_ok THEN 0 ELSE hits END) WHEN r6 OR r7 THEN 0
         WHEN r8 THEN nh WHEN route_ok THEN 0 ELSE nh END,
    CASE WHEN (r5 OR r7 OR r9) AND route_ok THEN goal ELSE last_goal END
  FROM (
    SELECT s.session_id, e.rn, e.event_id, e.reject, e.route_ok, e.goal, e.selected AS sel, e.selected_floor AS sel_floor,
           s.active, s.active_floor, s.pend, s.pend_floor, s.hits, s.last_goal,
           e.failed AS r1,
           (NOT e.failed AND e.selected IS NULL) AS r23,
           (NOT e.failed AND e.selected IS NOT NULL AND NOT e.has_cell) AS r4,
           (NOT e.failed AND e.selected IS NOT NULL AND e.has_cell AND s.active IS NULL) AS r5,
           (NOT e.failed AND e.selected IS NOT NULL AND e.has_cell AND s.active IS NOT NULL AND e.selected = s.active
                AND s.last_goal IS NOT NULL AND s.last_goal = e.goal) AS r6,
           (NOT e.failed AND e.selected IS NOT NULL AND e.has_cell AND s.active IS NOT NULL AND e.selected = s.active
                AND NOT (s.last_goal IS NOT NULL AND s.last_goal = e.goal)) AS r7,
           CASE WHEN s.pend = e.selected AND s.pend_floor = e.selected_floor THEN s.hits + 1 ELSE 1 END AS nh,
           (NOT e.failed AND e.selected IS NOT NULL AND e.has_cell AND s.active IS NOT NULL AND e.selected <> s.active
                AND (CASE WHEN s.pend = e.selected AND s.pend_floor = e.selected_floor THEN s.hits + 1 ELSE 1 END) < 2) AS r8,
           (NOT e.failed AND e.selected IS NOT NULL AND e.has_cell AND s.active IS NOT NULL AND e.selected <> s.active
                AND (CASE WHEN s.pend = e.selected AND s.pend_floor = e.selected_floor THEN s.hits + 1 ELSE 1 END) >= 2) AS r9
    FROM st s JOIN seq e ON e.session_id = s.session_id AND e.rn = s.rn + 1
  ) x
)
SELECT session_id, event_id, status, reason, selected_room_id, selected_floor, rerouted,
       active AS active_room_id, pend AS pending_room_id, CAST(hits AS INTEGER) AS pending_hits
FROM st WHERE rn > 0
"""

DECIDE_SQL = f"WITH RECURSIVE {GATE_SQL}, {_STEPS_SQL}"


@register("session_decisions", sql=DECIDE_SQL)
def session_decisions(spark, sf):
    """ST2 batch: per-event decisions of the confirmation filter (2 hits), sessions in time order."""
    return SS.decide_sorted(gated_events(spark, sf))


@register("session_stream", sql=DECIDE_SQL)
def session_stream(spark, sf):
    """ST2 stream: the same decisions from a Structured Streaming query (file source,
    ``availableNow``), state per session in the state store."""
    from roomcast.streaming.session_stream import run_decisions_stream

    return run_decisions_stream(spark, sf)


# --- decisions on real routes (J10) ----------------------------------------------------

#: Fixed value of the fixture: an alias that the caller adds.
ROUTE_ALIASES = {"E1": "elevator5"}


def _room_sql(k: str) -> str:
    return (f"CASE WHEN {k} % 5 = 0 THEN 'elevator' || CAST({k} AS VARCHAR) WHEN {k} % 5 = 1 THEN 'stair' || CAST({k} AS VARCHAR) "
            f"ELSE '10.' || CAST(CAST({k} % 2 + 1 AS INTEGER) AS VARCHAR) || '.' || CAST({k} AS VARCHAR) END")


def room_localisations(e, n):
    """Localisation results on the map of ``n`` rooms: the top room moves among three near the user's own one, which is the last
    candidate; errors name an alias, signups no room; the goal changes with the hour; step-free access when value > 100."""
    own, near = F.col("user_id") % n, (F.col("user_id") + F.floor(F.col("event_id") / 7) % 3) % n
    top = F.when(F.col("event_type") == "error", " e1 ").when(F.col("event_type") == "signup", "nowhere").otherwise(maps.room_id(near))
    conf = F.least(F.col("value") / 100.0, F.lit(1.0))
    first = F.struct(top.alias("room_id"), conf.alias("probability"))
    last = F.struct(maps.room_id(own).alias("room_id"), F.least(F.col("value") / 200.0, F.lit(1.0)).alias("probability"))
    goal = (F.col("user_id") * 3 + F.hour("ts") % 2) % n
    return e.select(
        F.col("user_id").alias("session_id"), "ts", "event_id", (F.col("value") < 1.0).alias("failed"),
        F.array(first, first, last).alias("candidates"), maps.room_id(goal).alias("goal"), goal.alias("goal_ord"),
        (F.col("value") > 100.0).alias("accessible"),
    )


_ROOM_GATE_SQL = f"""
ev AS (SELECT user_id AS session_id, ts, event_id, value < 1.0 AS failed, least(value / 100.0, 1.0) AS conf, least(value / 200.0, 1.0) AS conf2,
              value > 100.0 AS accessible, event_type, user_id % n AS own, (user_id + (event_id // 7) % 3) % n AS near_ord, (user_id * 3 + hour(ts) % 2) % n AS goal_ord
       FROM events, (SELECT max(s_suppkey) + 1 AS n FROM supplier)),
g_cand AS (SELECT event_id, 1 AS ord, CASE event_type WHEN 'error' THEN 'elevator5' WHEN 'signup' THEN 'nowhere' ELSE {_room_sql('near_ord')} END AS room_id, conf AS prob FROM ev
           UNION ALL SELECT event_id, 2, {_room_sql('own')}, conf2 FROM ev),
g_dedup AS (SELECT * FROM g_cand QUALIFY row_number() OVER (PARTITION BY event_id, room_id, prob ORDER BY ord) = 1),
g_usable AS (SELECT c.event_id, c.ord, c.prob, c.room_id, m.floor, m.ord AS room_ord FROM g_dedup c JOIN rooms m ON m.room_id = c.room_id),
g_pick AS (SELECT event_id, min(CASE WHEN prob >= 0.6 THEN ord END) AS ord FROM g_usable GROUP BY 1),
picked AS (SELECT e.session_id, e.ts, e.event_id, e.failed, {_room_sql('e.goal_ord')} AS goal, e.goal_ord, e.accessible, u.room_id AS selected, u.floor AS selected_floor,
                  u.room_ord AS selected_ord, CASE WHEN p.event_id IS NULL THEN 'no_mapped_candidate' WHEN p.ord IS NULL THEN 'low_confidence' END AS reject
           FROM ev e LEFT JOIN g_pick p USING (event_id) LEFT JOIN g_usable u ON u.event_id = p.event_id AND u.ord = p.ord),
wanted AS (SELECT DISTINCT selected_ord, goal_ord, accessible FROM picked WHERE selected IS NOT NULL),
rq AS (SELECT row_number() OVER (ORDER BY selected_ord, goal_ord, accessible) AS req, selected_ord AS start_ord, goal_ord, accessible FROM wanted)"""

ROUTED_SQL = f"""{route_ctes(_ROOM_GATE_SQL)},
gate AS (SELECT p.*, coalesce(o.status = 'ok', false) AS route_ok, s.room_id IS NOT NULL AS has_cell
         FROM picked p LEFT JOIN rq q ON q.start_ord = p.selected_ord AND q.goal_ord = p.goal_ord AND q.accessible = p.accessible
         LEFT JOIN routes o ON o.req = q.req LEFT JOIN snap s ON s.room_id = p.selected),
{_STEPS_SQL}"""


class RouteIndex:
    """The room index and the routes between all rooms that events may ask for, as tables."""

    def __init__(self, spark, sf):
        self.n = int(scalar(table(spark, sf, "supplier").agg(F.max("s_suppkey") + 1)))
        self.rooms, self.snapped, self.field = search(spark, sf)
        self.index = materialize(self.rooms.select("room_id", "floor", "ord"))

    def gated(self, results):
        """Results of ``room_localisations`` with the selected room, whether it has a cell, and which route would be asked for."""
        g = SS.gate_by_index(results, "candidates", self.index, ROUTE_ALIASES)
        cells = self.snapped.select(F.col("room_id").alias("selected"), F.lit(True).alias("has_cell"))
        return g.join(cells, "selected", "left").withColumn("has_cell", F.coalesce("has_cell", F.lit(False)))

    def statuses(self, gated):
        """Route status of every distinct (selected room, goal, access) of gated events: ``(selected, goal, accessible, route_ok)``."""
        asked = gated.where(F.col("selected").isNotNull()).select("selected", "selected_ord", "goal", "goal_ord", "accessible").distinct()
        asked = materialize(asked.withColumn("req", F.monotonically_increasing_id()))
        routes = best_routes(asked.select("req", F.col("selected_ord").alias("start_ord"), "goal_ord", "accessible"), self.rooms, self.snapped, self.field)
        return materialize(asked.join(routes.select("req", (F.col("status") == "ok").alias("route_ok")), "req").select("selected", "goal", "accessible", "route_ok"))

    def routed(self, gated, statuses):
        return gated.join(statuses, ["selected", "goal", "accessible"], "left").withColumn("route_ok", F.coalesce("route_ok", F.lit(False)))


@register("session_routes", sql=ROUTED_SQL)
def session_routes(spark, sf):
    """J10 + ST1 + ST2: decisions on the map: the gate joins the room index, and a change is confirmed only if the route
    from the selected room to the session's goal exists."""
    index = RouteIndex(spark, sf)
    gated = materialize(index.gated(room_localisations(table(spark, sf, "events"), index.n)))
    return SS.decide_sorted(index.routed(gated, index.statuses(gated)))


@register("session_routes_stream", sql=ROUTED_SQL)
def session_routes_stream(spark, sf):
    """J10 as a stream: gate and state run on the stream; the statuses of all routes that the events ask for are a static table."""
    from roomcast.streaming.session_stream import decisions_stream, events_stream, run_stream, stream_base

    index = RouteIndex(spark, sf)
    statuses = index.statuses(index.gated(room_localisations(table(spark, sf, "events"), index.n)))
    # on a stream an aggregate would wait for a watermark: each candidate meets the index and the statuses, the session's state picks
    cells = index.snapped.select("room_id", F.lit(True).alias("has_cell"))
    rooms = materialize(index.index.select("room_id", "floor").join(cells, "room_id", "left").withColumn("has_cell", F.coalesce("has_cell", F.lit(False))))
    if rooms.where("room_id is null").limit(1).count() or rooms.groupBy("room_id").count().where("count > 1").limit(1).count():
        raise ValueError("room ids must be there and distinct")
    rows = SS.candidate_rows(room_localisations(events_stream(spark, sf), index.n), "candidates", rooms, ROUTE_ALIASES)
    rows = index.routed(rows.withColumn("selected", F.col("room_id")), statuses)
    return run_stream(spark, decisions_stream(rows, candidates=True), stream_base(spark))


# --- validation -------------------------------------------------------------------

# Payload variants, selected by the ``k`` of ``events.props`` (k modulo their number); $EVENT and $USER are the row's ids:
PAYLOADS = [
    '{"floor": $EVENT, "room_id": "user-$USER", "candidates": [{"room_id": "user-$USER", "probability": 0.$EVENT}], '
    '"building": $USER, "confidence_room": 0.$EVENT}',
    '{"floor": $EVENT, "room_id": "user-$USER"}',
    '{"floor": "first", "room_id": "a", "candidates": []}',
    '{"floor": 2, "room_id": "  ", "candidates": []}',
    '{"floor": 2, "room_id": "x", "candidates": {"room_id": "x"}}',
    '{"floor": 1, "room_id": "x", "candidates": [{"room_id": "x", "probability": 0.5}, {"room_id": "y"}]}',
    '{"floor": 1, "room_id": "x", "candidates": [{"room_id": "x", "probability": "high"}]}',
    '{"floor": 1, "room_id": "x", "candidates": [], "confidence_room": "n/a"}',
    '[1, 2]',
    '{"floor": 1.0, "room_id": 5, "candidates": [{"room_id": null, "probability": "0.5"}], "building": 10.5, "confidence_floor": true}',
    '{"floor": true, "room_id": "x", "candidates": [{"room_id": "y", "probability": true}], "building": "10", "confidence_floor": "high"}',
    '{"floor": "1.5", "room_id": "x", "candidates": []}',
    '{"floor": null, "room_id": "x", "candidates": []}',
    '{"floor": " 2 ", "room_id": "\\t", "candidates": []}',
    '{"floor": 2, "room_id": "x", "candidates": [{"room_id": "y", "probability": null}]}',
    '{"floor": 2, "room_id": "x", "candidates": [], "building": "ten"}',
    '{"floor": 2, "room_id": "x", "candidates": [], "building": null, "confidence_room": null, "confidence_floor": "1e-3"}',
]


def _payloads(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    arr = F.array(*[F.lit(p) for p in PAYLOADS])
    text = F.try_element_at(arr, (F.pmod(k, F.lit(len(PAYLOADS))) + 1).cast("int"))
    for mark, col in (("$EVENT", "event_id"), ("$USER", "user_id")):
        text = F.replace(text, F.lit(mark), F.col(col).cast("string"))
    return e.select("event_id", text.alias("payload"))


def _type_is(path: str, pattern: str, of: str = "payload") -> str:
    """Whether a part of a JSON text is a number, a truth value or a text of the pattern."""
    return (f"(json_type({of}, '{path}') IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN') OR "
            f"(json_type({of}, '{path}') = 'VARCHAR' AND regexp_full_match(json_extract_string({of}, '{path}'), '{pattern}')))")


_INT = r"\s*[+-]?[0-9]+\s*"
_NUM = r"(?i)\s*[+-]?([0-9]+\.?[0-9]*(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?|inf|infinity|nan)\s*"


def _blank_sql(of: str) -> str:
    return f"(json_type({of}, '$.room_id') = 'VARCHAR' AND regexp_full_match(json_extract_string({of}, '$.room_id'), '\\s*'))"


def _bad_number_sql(key: str, pattern: str) -> str:
    return f"list_contains(keys, '{key}') AND json_type(payload, '$.{key}') <> 'NULL' AND NOT {_type_is('$.' + key, pattern)}"


@register("payload_validate", sql="""
WITH p AS (SELECT event_id,
                  replace(replace(([""" + ", ".join("'" + p.replace("'", "''") + "'" for p in PAYLOADS) + f"""])[(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % {len(PAYLOADS)}) + 1], '$EVENT', CAST(event_id AS VARCHAR)), '$USER', CAST(user_id AS VARCHAR)) AS payload
           FROM events),
j AS (SELECT event_id, payload, json_type(payload) AS jt,
             CASE WHEN json_type(payload) = 'OBJECT' THEN json_keys(payload) END AS keys FROM p),
c AS (SELECT *,
        CASE WHEN json_type(payload, '$.candidates') = 'ARRAY'
             THEN CAST(json_extract(payload, '$.candidates') AS JSON[]) END AS cands FROM j),
e AS (SELECT *,
        list_filter(list_transform(cands, lambda x:
            CASE WHEN json_type(x) <> 'OBJECT' THEN 'candidate_not_object'
                 WHEN NOT (list_contains(json_keys(x), 'room_id') AND list_contains(json_keys(x), 'probability')) THEN 'candidate_missing_keys'
                 WHEN {_blank_sql('x')} THEN 'candidate_empty_room'
                 WHEN NOT {_type_is('$.probability', _NUM, 'x')} THEN 'candidate_bad_probability' END),
          lambda y: y IS NOT NULL) AS cerr FROM c)
SELECT event_id,
  CASE WHEN jt IS NULL OR jt <> 'OBJECT' THEN 'not_object'
       WHEN NOT (list_contains(keys, 'floor') AND list_contains(keys, 'room_id') AND list_contains(keys, 'candidates')) THEN 'missing_keys'
       WHEN NOT {_type_is('$.floor', _INT)} THEN 'bad_floor'
       WHEN {_blank_sql('payload')} THEN 'empty_room'
       WHEN cands IS NULL THEN 'candidates_not_list'
       WHEN len(cerr) > 0 THEN cerr[1]
       WHEN {_bad_number_sql('building', _INT)} THEN 'bad_building'
       WHEN {_bad_number_sql('confidence_room', _NUM)} OR {_bad_number_sql('confidence_floor', _NUM)} THEN 'bad_confidence'
       ELSE 'ok' END AS error_code
FROM e
""")
def payload_validate(spark, sf):
    """Strict reply validation, first failure wins, one ``error_code`` per payload."""
    from roomcast.operators.validate import payload_error

    p = _payloads(spark, sf)
    return p.select("event_id", payload_error(F.col("payload")).alias("error_code"))


@register("request_validate", sql=f"""
WITH {CELLS},
rs AS (SELECT scan_id, count(CASE WHEN rssi_raw IS NOT NULL THEN 1 END) AS n_rssi FROM cells GROUP BY 1),
im AS (SELECT l_orderkey AS scan_id, count(CASE WHEN NOT (l_linestatus = 'O' AND l_returnflag = 'A') AND l_linenumber <= 7 THEN 1 END) AS n_imu
       FROM lineitem GROUP BY 1),
r AS (SELECT rs.scan_id, CAST(rs.scan_id % 12 AS INTEGER) - 1 AS top_k, rs.n_rssi, im.n_imu FROM rs JOIN im USING (scan_id))
SELECT scan_id, top_k, CASE WHEN top_k < 1 OR top_k > 10 THEN 'bad_top_k'
                            WHEN n_rssi = 0 AND n_imu = 0 THEN 'empty_request' ELSE 'ok' END AS error_code
FROM r
""")
def request_validate(spark, sf):
    """P10: 1 <= top_k <= 10 and at least one of rssi / imu non-empty; top_k = scan % 12 - 1."""
    from roomcast.plans import common as C
    from roomcast.sources import fingerprints as fp

    li = C.lineitem(spark, sf)
    rs = fp.scan_cells(li).groupBy("scan_id").agg(F.count("rssi_raw").alias("n_rssi"))
    im = fp.imu_readings(li).groupBy("scan_id").agg(F.count(F.when(F.col("imu_name").isNotNull(), F.col("value"))).alias("n_imu"))
    r = rs.join(im, "scan_id").withColumn("top_k", ((F.col("scan_id") % 12) - 1).cast("int"))
    code = (F.when((F.col("top_k") < 1) | (F.col("top_k") > 10), F.lit("bad_top_k"))
            .when((F.col("n_rssi") == 0) & (F.col("n_imu") == 0), F.lit("empty_request")).otherwise(F.lit("ok")))
    return r.select("scan_id", "top_k", code.alias("error_code"))
