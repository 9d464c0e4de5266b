"""Spark-side building blocks shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomcast.functions.exprs import IMU_COLUMNS
from roomcast.operators import features as feat
from roomcast.sources import fingerprints as fp
from roomcast.sources.tables import table


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


def scans(spark: SparkSession, sf: str) -> DataFrame:
    return lineitem(spark, sf).select(F.col("l_orderkey").alias("scan_id")).distinct()


def clean_cells(spark: SparkSession, sf: str) -> DataFrame:
    return fp.clean_cells(lineitem(spark, sf))


def apdim(spark: SparkSession, sf: str) -> DataFrame:
    """The AP schema; names come from the raw readings, as cleaning drops none."""
    return feat.ap_dimension(fp.raw_readings(lineitem(spark, sf)))


def imu_filled(spark: SparkSession, sf: str) -> DataFrame:
    li = lineitem(spark, sf)
    readings = fp.imu_readings(li)
    return feat.imu_impute(scans(spark, sf), readings, feat.imu_medians(readings), IMU_COLUMNS)


def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    return feat.feature_long(clean_cells(spark, sf), apdim(spark, sf), imu_filled(spark, sf), IMU_COLUMNS)


def n_scans(spark: SparkSession, sf: str) -> int:
    return scans(spark, sf).count()


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """``(vec_id, label, vec ARRAY<DOUBLE>)``."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def scan_labels(spark: SparkSession, sf: str) -> DataFrame:
    """``(scan_id, room_id, floor)`` of every scan that has readings."""
    labels = fp.scan_labels(table(spark, sf, "orders"))
    return labels.join(scans(spark, sf), "scan_id", "left_semi")
