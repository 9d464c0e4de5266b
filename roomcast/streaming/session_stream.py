"""Streaming confirmation filter: ``applyInPandasWithState`` keyed by session.

The gate is stateless and runs in the stream before the shuffle; the state
machine keeps ``(active, pending, hits, last goal)`` per session in the state
store.  Inside a micro-batch a session's events are put in ``(ts, event_id)``
order; across micro-batches the source order is kept.  The micro-batch size
(trigger limits of the source) bounds the rows one key sees at once.  With ``idle`` a session's
state is dropped once the watermark is that much behind its last event, so the state store
holds the sessions that are still going on.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupStateTimeout

from roomcast.operators import session as SS
from roomcast.session import checkpoint_dir

STATE_SCHEMA = "active string, active_floor int, pend string, pend_floor int, hits int, last_goal string"


def _state_fn(required: int, idle_ms: int | None, candidates: bool = False):
    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            a, af, p, pf, h, g = state.get
            st = {"active": a, "active_floor": af, "pend": p, "pend_floor": pf, "hits": h, "last_goal": g}
        else:
            st = dict(SS.EMPTY_STATE)
        batch = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
        rows = []
        events = batch.to_dict("records")
        for ev in SS.fold_candidates(events) if candidates else events:
            ev = {k: (None if (isinstance(v, float) and pd.isna(v)) else v) for k, v in ev.items()}
            if ev.get("selected_floor") is not None:
                ev["selected_floor"] = int(ev["selected_floor"])
            out, st = SS.transition(st, ev, required)
            rows.append(SS._decision_row(key[0], ev["event_id"], out, st))
        state.update((st["active"], st["active_floor"], st["pend"], st["pend_floor"], int(st["hits"]), st["last_goal"]))
        if idle_ms is not None:
            last = int(batch["ts"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(rows)

    return fn


def decisions_stream(
    gated_stream: DataFrame, required: int = SS.TRANSITION_HITS_REQUIRED, late: str | None = None, idle_ms: int | None = None,
    candidates: bool = False,
) -> DataFrame:
    """Streaming DataFrame of decisions from a streaming DataFrame of gated events, or of their ``candidates`` as rows.

    ``late`` (a watermark delay) with ``idle_ms`` ends sessions without events; without them a session never ends.
    """
    if (late is None) != (idle_ms is None):
        raise ValueError("late and idle_ms go together")
    rows = gated_stream.select(*SS.CANDIDATE_COLS) if candidates else SS.event_rows(gated_stream)
    if late is not None:
        rows = rows.withWatermark("ts", late)
    timeout = GroupStateTimeout.NoTimeout if late is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("session_id").applyInPandasWithState(
        _state_fn(required, idle_ms, candidates), SS.DECISION_SCHEMA, STATE_SCHEMA, "append", timeout
    )


def run_stream(spark: SparkSession, decisions: DataFrame, base: str) -> DataFrame:
    """Runs decisions over what the source holds into a Parquet sink and returns the sink's rows."""
    q = (
        decisions.writeStream.format("parquet")
        .option("path", base + "/out").option("checkpointLocation", base + "/chk")
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(SS.DECISION_SCHEMA).parquet(base + "/out")


def events_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a file stream; the glob filter keeps only that table of the folder."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def stream_base(spark: SparkSession) -> str:
    """A new folder for sink and checkpoint under the shared checkpoint folder."""
    return checkpoint_dir(spark).rstrip("/") + f"/session-stream-{uuid.uuid4().hex}"


def run_decisions_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The confirmation filter as a stream over ``events`` (``availableNow``)."""
    from roomcast.plans import q_sessions as QS

    gated = QS.gate(QS.localisations(events_stream(spark, sf)))
    return run_stream(spark, decisions_stream(gated), stream_base(spark))
