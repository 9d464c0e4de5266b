"""Scalar rules: cleaning, id parsing, connector keys, alias mapping, validation."""

from pyspark.sql import functions as F

from roomcast.functions.exprs import clean_rssi, connector_key, floor_from_room_id
from roomcast.operators.session import map_room
from roomcast.operators.validate import payload_error


def test_clean_rssi_rules(spark):
    df = spark.createDataFrame([(None,), (-100.0,), (-20.0,), (-120.0,), (float("nan"),), (-65.0,)], "v double")
    got = [r[0] for r in df.select(clean_rssi(F.col("v"))).collect()]
    assert got == [-110.0, -110.0, -30.0, -110.0, -110.0, -65.0]


def test_floor_from_room_id(spark):
    df = spark.createDataFrame([("10.2.15A",), ("10.1.17",), ("elevator1",), ("x.1.2",)], "id string")
    got = [r[0] for r in df.select(floor_from_room_id(F.col("id"))).collect()]
    assert got == [2, 1, None, None]


def test_connector_key(spark):
    df = spark.createDataFrame([("Elevator", "elevator1"), ("stairway", "Stair4"), ("elevator", "lift")], "t string, id string")
    got = [r[0] for r in df.select(connector_key(F.col("t"), F.col("id"))).collect()]
    assert got == ["elevator:1", "stairway:4", "elevator:lift"]


def test_map_room_aliases(spark):
    df = spark.createDataFrame([(" E1 ",), ("e2",), ("10.1.17",), ("",)], "id string")
    got = [r[0] for r in df.select(map_room(F.col("id"), {"E1": "elevator1", "E2": "elevator2"})).collect()]
    assert got == ["elevator1", "elevator2", "10.1.17", ""]


def test_payload_first_failure_wins(spark):
    cases = [
        ('{"floor": 1, "room_id": "10.1.17", "candidates": [{"room_id": "10.1.17", "probability": 0.92}]}', "ok"),
        ('{"floor": 1, "room_id": "10.1.17"}', "missing_keys"),
        ('[1]', "not_object"),
        ('{"floor": "x", "room_id": " ", "candidates": 3}', "bad_floor"),
        ('{"floor": 1, "room_id": " ", "candidates": 3}', "empty_room"),
        ('{"floor": 1, "room_id": "a", "candidates": {"room_id": "a"}}', "candidates_not_list"),
        ('{"floor": 1, "room_id": "a", "candidates": [5]}', "candidate_not_object"),
        ('{"floor": 1, "room_id": "a", "candidates": [{"room_id": "a", "probability": "p"}, {"room_id": "b"}]}',
         "candidate_bad_probability"),
        ('{"floor": 1, "room_id": "a", "candidates": [], "building": "ten"}', "bad_building"),
    ]
    df = spark.createDataFrame(cases, "p string, want string")
    for row in df.select(payload_error(F.col("p")).alias("got"), "want").collect():
        assert row["got"] == row["want"]
