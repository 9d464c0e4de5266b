"""Shared CTE text for the DuckDB oracles (the same fixture rules as the Spark side)."""

from roomcast.functions.exprs import IMU_COLUMNS

IMU_LIST = "[" + ", ".join(f"'{c}'" for c in IMU_COLUMNS) + "]"

CELLS = """
cells AS (
  SELECT l_orderkey AS scan_id,
         'AP' || CAST(CAST(l_suppkey % 40 + 1 AS INTEGER) AS VARCHAR) AS ap_id,
         CAST(l_suppkey % 40 + 1 AS INTEGER) AS ap_ord,
         max(CASE WHEN l_linenumber = 7 THEN NULL
                  WHEN l_returnflag = 'R' THEN -100.0
                  ELSE -30.0 - 2.0 * l_quantity END) AS rssi_raw
  FROM lineitem GROUP BY 1, 2, 3),
clean AS (
  SELECT *, greatest(-110.0, least(-30.0,
           CASE WHEN rssi_raw IS NULL OR isnan(rssi_raw) OR rssi_raw = -100.0 THEN -110.0
                ELSE rssi_raw END)) AS rssi
  FROM cells),
scans AS (SELECT DISTINCT l_orderkey AS scan_id FROM lineitem),
apdim AS (
  SELECT ap_id, CAST(row_number() OVER (
           ORDER BY CASE WHEN regexp_full_match(substr(ap_id, 3), '[0-9]+') THEN 0 ELSE 1 END,
                    TRY_CAST(substr(ap_id, 3) AS HUGEINT) NULLS FIRST,
                    CASE WHEN regexp_full_match(substr(ap_id, 3), '[0-9]+') THEN NULL ELSE substr(ap_id, 3) END NULLS FIRST,
                    ap_id) AS INTEGER) AS ap_pos
  FROM (SELECT DISTINCT ap_id FROM clean) WHERE starts_with(ap_id, 'AP')),
dense AS (
  SELECT s.scan_id, a.ap_pos, a.ap_id, coalesce(c.rssi, -110.0) AS rssi
  FROM scans s CROSS JOIN apdim a
  LEFT JOIN clean c ON c.scan_id = s.scan_id AND c.ap_id = a.ap_id)
"""

IMU = f"""
imu AS (
  SELECT l_orderkey AS scan_id, ({IMU_LIST})[l_linenumber] AS imu_name,
         CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN NULL
              ELSE l_extendedprice / l_quantity / 1000.0 END AS value
  FROM lineitem),
imu_med AS (SELECT imu_name, median(value) AS median FROM imu WHERE imu_name IS NOT NULL GROUP BY 1),
imu_vals AS (SELECT scan_id, imu_name, max(value) AS value FROM imu GROUP BY 1, 2),
imu_filled AS (
  SELECT g.scan_id, g.imu_name, coalesce(v.value, m.median, 0.0) AS value
  FROM (SELECT scan_id, unnest({IMU_LIST}) AS imu_name FROM (SELECT DISTINCT l_orderkey AS scan_id FROM lineitem)) g
  LEFT JOIN imu_vals v ON v.scan_id = g.scan_id AND v.imu_name = g.imu_name
  LEFT JOIN imu_med m ON m.imu_name = g.imu_name)
"""

FEATURES = """
feat AS (
  SELECT scan_id, ap_id AS feature, ap_pos AS pos, rssi AS value, -110.0 AS fill FROM dense
  UNION ALL
  SELECT f.scan_id, f.imu_name, CAST((SELECT max(ap_pos) FROM apdim) + list_position(""" + IMU_LIST + """, f.imu_name) AS INTEGER),
         f.value, 0.0
  FROM imu_filled f),
scaler AS (
  SELECT feature, pos, fill,
         quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median,
         quantile_cont(value, 0.75) AS q75
  FROM feat GROUP BY 1, 2, 3),
scaler2 AS (
  SELECT *, q75 - q25 AS iqr, coalesce(nullif(q75 - q25, 0.0), 1.0) AS scale FROM scaler)
"""

LABELS = """
scan_labels AS (SELECT o_orderkey AS scan_id, o_orderpriority AS room_id, o_orderstatus AS floor FROM orders)
"""
