"""Candidate gate and confirmation state machine: the reference's scenarios plus derived ones."""

from pyspark.sql import functions as F

from roomcast.operators import session as SS
from roomcast.operators.session import EMPTY_STATE, candidate_gate, transition
from roomcast.streaming.session_stream import decisions_stream, run_stream

IDX = {"10.1.17": 1, "10.1.18": 1, "elevator1": 1, "10.2.63": 2}
ALIASES = {"E1": "elevator1", "E2": "elevator2"}


def _gate(spark, cands):
    df = spark.createDataFrame([(1, cands)], "id int, c array<struct<room_id:string, probability:double>>")
    return candidate_gate(df, "c", IDX, ALIASES).first()


def test_gate_alias(spark):
    r = _gate(spark, [("E1", 0.9), ("E1", 0.9)])
    assert r["selected"] == "elevator1"


def test_gate_first_mapped_candidate(spark):
    r = _gate(spark, [("unknown", 0.95), ("unknown", 0.95), ("E1", 0.84), ("10.1.17", 0.80)])
    assert r["selected"] == "elevator1" and abs(r["selected_prob"] - 0.84) < 1e-12


def test_gate_low_confidence_and_unmapped(spark):
    assert _gate(spark, [("10.1.17", 0.35)])["reject"] == "low_confidence"
    assert _gate(spark, [("unknown", 0.9), ("unknown2", 0.8)])["reject"] == "no_mapped_candidate"


def _run(events):
    s, out = dict(EMPTY_STATE), []
    for ev in events:
        base = {"failed": False, "reject": None, "goal": "G", "route_ok": True}
        base.update(ev)
        d, s = transition(s, base)
        out.append((d["status"], d["reason"], s["active"]))
    return out


def test_confirmation_sequence():
    ev = [{"selected": "A", "selected_floor": 1}, {"selected": "B", "selected_floor": 1}, {"selected": "B", "selected_floor": 1}]
    assert _run(ev) == [("ok", "rerouted", "A"), ("hold", "awaiting_confirmation", "A"), ("ok", "rerouted", "B")]


def test_low_confidence_keeps_counter():
    ev = [{"selected": "A", "selected_floor": 1}, {"selected": "B", "selected_floor": 1},
          {"selected": None, "reject": "low_confidence"}, {"selected": "B", "selected_floor": 1}]
    assert _run(ev)[-1] == ("ok", "rerouted", "B")


def test_alternating_never_switches():
    ev = [{"selected": x, "selected_floor": 1} for x in "ABAB"]
    assert [o[2] for o in _run(ev)] == ["A", "A", "A", "A"]


def test_new_pending_resets():
    ev = [{"selected": x, "selected_floor": 1} for x in "ABCC"]
    assert _run(ev)[-1] == ("ok", "rerouted", "C")


def test_failed_confirmation_retries():
    ev = [{"selected": "A", "selected_floor": 1}, {"selected": "B", "selected_floor": 1},
          {"selected": "B", "selected_floor": 1, "route_ok": False}, {"selected": "B", "selected_floor": 1}]
    out = _run(ev)
    assert out[2] == ("error", "routing_error", "A") and out[3] == ("ok", "rerouted", "B")


def test_same_room_new_goal_reroutes_and_localization_error():
    ev = [{"selected": "A", "selected_floor": 1}, {"selected": "A", "selected_floor": 1, "goal": "H"},
          {"failed": True, "selected": None}]
    assert _run(ev) == [("ok", "rerouted", "A"), ("ok", "rerouted", "A"), ("error", "localization_error", "A")]


def test_all_transitions_on_routes(spark):
    """The nine outcomes of the filter, from events gated by the room index."""
    index = spark.createDataFrame([("r1", 1), ("r2", 1), ("r3", 2), ("walled", 2)], "room_id string, floor int")
    ask = [  # failed, room, probability, goal
        (True, "r1", 0.9, "g"), (False, "nowhere", 0.9, "g"), (False, "r1", 0.3, "g"), (False, "walled", 0.9, "g"),
        (False, "r1", 0.9, "far"), (False, "r1", 0.9, "g"), (False, "r1", 0.9, "g"), (False, "r1", 0.9, "h"),
        (False, "r2", 0.9, "h"), (False, "r2", 0.9, "far"), (False, "r2", 0.9, "h"), (False, " e9 ", 0.9, "h"), (False, "r3", 0.9, "h"),
    ]
    rows = [(7, i, i, f, [(room, p), (room, p)], goal) for i, (f, room, p, goal) in enumerate(ask)]
    events = spark.createDataFrame(rows, "session_id long, ts long, event_id long, failed boolean, candidates array<struct<room_id:string,probability:double>>, goal string")
    events = events.withColumn("ts", F.timestamp_seconds("ts"))
    gated = SS.gate_by_index(events, "candidates", index, {"E9": "r3"})
    gated = gated.withColumn("route_ok", F.col("goal") != "far").withColumn("has_cell", F.col("selected") != "walled")
    got = [(r.status, r.reason, r.selected_room_id, r.selected_floor, r.rerouted, r.active_room_id, r.pending_hits) for r in SS.decide_sorted(gated).orderBy("event_id").collect()]
    assert got == [
        ("error", "localization_error", None, None, False, None, 0), ("hold", "no_mapped_candidate", None, None, False, None, 0),
        ("hold", "low_confidence", None, None, False, None, 0), ("error", "routing_error", "walled", None, False, None, 0),
        ("error", "routing_error", "r1", None, False, None, 0), ("ok", "rerouted", "r1", 1, True, "r1", 0),
        ("ok", "rerouted", "r1", 1, False, "r1", 0), ("ok", "rerouted", "r1", 1, True, "r1", 0),
        ("hold", "awaiting_confirmation", "r2", 1, False, "r1", 1), ("error", "routing_error", "r2", None, False, "r1", 2),
        ("ok", "rerouted", "r2", 1, True, "r2", 0), ("hold", "awaiting_confirmation", "r3", 2, False, "r2", 1), ("ok", "rerouted", "r3", 2, True, "r3", 0),
    ]


def test_idle_sessions_end_on_a_stream(spark, tmp_path):
    """A session that is silent for longer than the limit starts anew: its first room is taken without confirmation."""
    schema = "session_id long, ts timestamp, event_id long, failed boolean, selected string, reject string, selected_floor int, goal string, route_ok boolean"
    for n, (s, sec, room) in enumerate([(1, 0, "a"), (2, 5000, "z"), (2, 5001, "z"), (1, 9000, "b")]):
        df = spark.createDataFrame([(s, 10**9 + sec, n, False, room, None, 1, "g", True)], schema.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = run_stream(spark, decisions_stream(source), str(tmp_path / "kept"))
    ended = run_stream(spark, decisions_stream(source, late="1 second", idle_ms=600_000), str(tmp_path / "ended"))
    assert {r.event_id: r.reason for r in kept.collect()}[3] == "awaiting_confirmation"
    assert {r.event_id: r.reason for r in ended.collect()} == {i: "rerouted" for i in range(4)}
