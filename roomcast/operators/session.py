"""Location decisions: candidate gate (ST1) and the confirmation state machine (ST2).

The gate is vectorised Spark SQL (array higher-order functions).  The state
machine is sequential per session, so it runs over partitions hash-split by
session and sorted by ``(session, ts, id)``: ``mapInPandas`` walks the Arrow
batches in order and carries one session's state across batch boundaries.
Memory stays one batch whatever the session size; no session is collected.
The streaming form (``roomcast.streaming.session_stream``) uses the same
``transition`` with the state kept in the state store.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomcast.functions.exprs import CONFIDENCE_THRESHOLD, TRANSITION_HITS_REQUIRED

STATE_FIELDS = ["active", "active_floor", "pend", "pend_floor", "hits", "last_goal"]
EMPTY_STATE = {"active": None, "active_floor": None, "pend": None, "pend_floor": None, "hits": 0, "last_goal": None}

DECISION_SCHEMA = (
    "session_id long, event_id long, status string, reason string, selected_room_id string, "
    "selected_floor int, rerouted boolean, active_room_id string, pending_room_id string, pending_hits int"
)


def map_room(c: Column, aliases: dict[str, str]) -> Column:
    """Trim; exact alias; else upper-cased alias; else unchanged."""
    clean = F.trim(c)
    if not aliases:
        return clean
    amap = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.lit(v))])
    return F.when(clean == "", clean).otherwise(
        F.coalesce(F.try_element_at(amap, clean), F.try_element_at(amap, F.upper(clean)), clean)
    )


def candidate_gate(events: DataFrame, cand_col: str, room_floor: dict[str, int], aliases: dict[str, str],
                   threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """ST1 + W7: map, de-duplicate (first of each (room, probability)), keep mapped, take the
    first candidate whose probability reaches the threshold.

    ``cand_col`` is ``ARRAY<STRUCT<room_id, probability>>`` in rank order (top
    prediction first).  Adds ``selected``, ``selected_prob``, ``reject``, ``selected_floor``.
    ``room_floor`` is the room index (a bounded dimension) as a literal map.
    """
    idx = F.create_map(*[x for k, v in room_floor.items() for x in (F.lit(k), F.lit(int(v)))])
    mapped = F.transform(F.col(cand_col), lambda c: F.struct(map_room(c["room_id"], aliases).alias("room_id"), c["probability"].alias("probability")))
    dedup = F.array_distinct(mapped)
    usable = F.filter(dedup, lambda c: (c["room_id"] != "") & F.try_element_at(idx, c["room_id"]).isNotNull())
    passing = F.filter(usable, lambda c: c["probability"].isNotNull() & (c["probability"] >= F.lit(threshold)))
    first = F.try_element_at(passing, F.lit(1))
    out = events.withColumn("_usable", usable).withColumn("_first", first)
    return out.select(
        *events.columns,
        F.col("_first.room_id").alias("selected"),
        F.col("_first.probability").alias("selected_prob"),
        F.when(F.size("_usable") == 0, F.lit("no_mapped_candidate"))
        .when(F.col("_first").isNull(), F.lit("low_confidence")).alias("reject"),
        F.try_element_at(idx, F.col("_first.room_id")).alias("selected_floor"),
    )


def candidate_rows(events: DataFrame, cand_col: str, index: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """One row per candidate of every event, joined with the room index ``(room_id, floor, ...)``: no aggregate, so that it also runs on a stream.

    ``event_key`` is equal for equal events only, ``pos`` the candidate's place (null for an event without any), ``known`` says
    whether the index has the room.  ``room_id`` must be unique in the index.
    """
    kept = [c for c in events.columns if c != cand_col]
    mapped = F.transform(F.col(cand_col), lambda c: F.struct(map_room(c["room_id"], aliases).alias("room_id"), c["probability"].alias("probability")))
    rows = events.select(*kept, F.xxhash64(*kept, cand_col).alias("event_key"), F.posexplode_outer(F.array_distinct(mapped)).alias("pos", "c"))
    rows = rows.select(*kept, "event_key", "pos", "c.*").join(index.withColumn("known", F.lit(True)), "room_id", "left")
    return rows.withColumn("known", F.coalesce("known", F.lit(False)) & (F.col("room_id") != ""))


def fold_candidates(rows: list[dict], threshold: float = CONFIDENCE_THRESHOLD) -> list[dict]:
    """Events as ``transition`` reads them from their ``candidate_rows``, in the order of their first rows: the gate's choice.

    An event that came several times is there as often.
    """
    held: dict = {}
    for r in rows:
        key = (r["event_id"], r["event_key"])
        ev = held.get(key)
        if ev is None:
            ev = {c: r[c] for c in ("session_id", "ts", "event_id", "failed", "goal")}
            ev |= {"selected": None, "reject": "no_mapped_candidate", "selected_floor": None, "route_ok": False, "has_cell": False}
            held[key] = ev = {"event": ev, "at": None, "times": 0}
        if pd.isna(r["pos"]) or r["pos"] == 0:
            ev["times"] += 1
        if not r["known"]:
            continue
        if ev["event"]["reject"] == "no_mapped_candidate":
            ev["event"]["reject"] = "low_confidence"
        p = r["probability"]
        if p is not None and p >= threshold and (ev["at"] is None or r["pos"] < ev["at"]):
            ev["at"] = r["pos"]
            ev["event"].update(selected=r["room_id"], reject=None, selected_floor=r["floor"], route_ok=bool(r["route_ok"]), has_cell=bool(r["has_cell"]))
    return [dict(ev["event"]) for ev in held.values() for _ in range(ev["times"])]


def gate_by_index(events: DataFrame, cand_col: str, index: DataFrame, aliases: dict[str, str],
                  threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """ST1 + J4 + W7 against the room index as a table ``(room_id, floor, ...)``: as ``candidate_gate``.

    ``event_id`` must be unique.  The index columns of the selected room come along as ``selected_<column>``.
    """
    more = [c for c in index.columns if c != "room_id"]
    mapped = F.transform(F.col(cand_col), lambda c: F.struct(map_room(c["room_id"], aliases).alias("room_id"), c["probability"].alias("probability")))
    rows = events.select("event_id", F.posexplode(F.array_distinct(mapped)).alias("pos", "c")).select("event_id", "pos", "c.*")
    usable = rows.where("room_id <> ''").join(index, "room_id")
    first = F.min(F.when(F.col("probability") >= threshold, F.struct("pos", "room_id", "probability", *more))).alias("first")
    picked = usable.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_usable"), first)
    out = events.join(picked, "event_id", "left")
    reject = F.when(F.col("n_usable").isNull(), "no_mapped_candidate").when(F.col("first").isNull(), "low_confidence")
    return out.select(
        *events.columns, F.col("first.room_id").alias("selected"), F.col("first.probability").alias("selected_prob"), reject.alias("reject"),
        *(F.col(f"first.{c}").alias(f"selected_{c}") for c in more),
    )


def transition(state: dict, ev: dict, required: int = TRANSITION_HITS_REQUIRED):
    """One step of the confirmation filter.  Returns (decision dict, new state).

    ``ev`` keys: ``failed``, ``selected``, ``reject``, ``selected_floor``, ``goal``,
    ``route_ok``, ``has_cell``.
    """
    if required < 1:
        raise ValueError("transition_hits_required must be at least 1")
    s = dict(state)
    out = {"status": None, "reason": None, "selected_room_id": None, "selected_floor": None, "rerouted": False}
    if ev["failed"]:
        out.update(status="error", reason="localization_error")
        return out, s
    sel = ev["selected"]
    if sel is None:
        out.update(status="hold", reason=ev["reject"])
        return out, s
    floor = ev["selected_floor"]
    out.update(selected_room_id=sel)
    if not ev.get("has_cell", True):
        out.update(status="error", reason="routing_error")
        return out, s

    def route(clear_on_fail: bool):
        if ev["route_ok"]:
            s.update(active=sel, active_floor=floor, last_goal=ev["goal"], pend=None, pend_floor=None, hits=0)
            out.update(status="ok", reason="rerouted", selected_floor=floor, rerouted=True)
        else:
            out.update(status="error", reason="routing_error")

    if s["active"] is None:
        route(False)
        return out, s
    if sel == s["active"]:
        s.update(pend=None, pend_floor=None, hits=0)
        if s["last_goal"] is not None and s["last_goal"] == ev["goal"]:
            out.update(status="ok", reason="rerouted", selected_room_id=s["active"], selected_floor=s["active_floor"], rerouted=False)
            return out, s
        route(True)
        return out, s
    if s["pend"] == sel and s["pend_floor"] == floor:
        s["hits"] = s["hits"] + 1
    else:
        s.update(pend=sel, pend_floor=floor, hits=1)
    if s["hits"] < required:
        out.update(status="hold", reason="awaiting_confirmation", selected_floor=floor)
        return out, s
    route(False)
    return out, s


def _decision_row(key, event_id, out, s):
    return {
        "session_id": key, "event_id": event_id, "status": out["status"], "reason": out["reason"],
        "selected_room_id": out["selected_room_id"], "selected_floor": out["selected_floor"],
        "rerouted": bool(out["rerouted"]), "active_room_id": s["active"], "pending_room_id": s["pend"],
        "pending_hits": int(s["hits"]),
    }


EVENT_COLS = ["session_id", "ts", "event_id", "failed", "selected", "reject", "selected_floor", "goal", "route_ok", "has_cell"]


CANDIDATE_COLS = ["session_id", "ts", "event_id", "failed", "goal", "event_key", "pos", "room_id", "probability", "known", "floor", "route_ok", "has_cell"]


def event_rows(gated: DataFrame) -> DataFrame:
    """The columns that the state machine reads; rooms have a cell unless ``has_cell`` says otherwise."""
    has_cell = F.col("has_cell") if "has_cell" in gated.columns else F.lit(True)
    return gated.withColumn("has_cell", has_cell).select(*EVENT_COLS)


def decide_sorted(gated: DataFrame, required: int = TRANSITION_HITS_REQUIRED, partitions: int | None = None) -> DataFrame:
    """Batch ST2: decisions for every event, sessions processed in ``(ts, event_id)`` order."""
    n = partitions or int(gated.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = event_rows(gated).repartition(n, "session_id").sortWithinPartitions("session_id", "ts", "event_id")

    def run(batches):
        key, state = None, dict(EMPTY_STATE)
        for pdf in batches:
            rows = []
            for ev in pdf.to_dict("records"):
                if ev["session_id"] != key:
                    key, state = ev["session_id"], dict(EMPTY_STATE)
                ev = {k: (None if (isinstance(v, float) and pd.isna(v)) else v) for k, v in ev.items()}
                if ev.get("selected_floor") is not None:
                    ev["selected_floor"] = int(ev["selected_floor"])
                out, state = transition(state, ev, required)
                rows.append(_decision_row(key, ev["event_id"], out, state))
            if rows:
                yield pd.DataFrame(rows)

    return ordered.mapInPandas(run, DECISION_SCHEMA)
