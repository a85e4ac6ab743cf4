"""The matcher's and report's inputs, derived from the star-schema tables in SQL that Spark and other engines read alike."""

from __future__ import annotations

import re
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_TENANT = "'T' || CAST(CAST(floor(p_partkey / 500) AS INT) AS STRING)"
_CODE = "'P-' || lpad(CAST(p_partkey AS STRING), 6, '0') || CASE WHEN p_partkey % 41 = 0 THEN '-OLD' ELSE '' END"
_SIZE = "CAST((p_size % 3) * 10 + 10 AS STRING)"
_NAME = f"p_name || ' ' || {_SIZE} || ' mm'"
_BARCODE = "lpad(CAST(p_partkey * 7919 AS STRING), 10, '0')"

SQL = {
    "catalogue": f"""SELECT {_TENANT} AS tenant, {_CODE} AS item_code,
  CASE WHEN p_partkey % 97 = 5 THEN 'Delivery Fee' WHEN p_partkey % 10 = 3 THEN {_NAME} || ' bulk' ELSE {_NAME} END AS item_name,
  CASE WHEN p_partkey % 17 = 0 THEN '1' ELSE '0' END AS disabled,
  CASE WHEN p_partkey % 3 = 0 THEN {_BARCODE} ELSE '' END AS barcode, '' AS description,
  CASE WHEN p_partkey % 2 = 0 THEN 'BrandA' ELSE 'BrandB' END AS brand, 'Nos' AS stock_uom,
  '[{{"uom":"Nos","conversion_factor":1.0}},{{"uom":"Carton","conversion_factor":' || CASE WHEN p_partkey % 10 = 3 THEN '144.0' ELSE '10.0' END || '}}]' AS uom_conversions
FROM part""",
    "lines": f"""SELECT 'L' || lpad(CAST(p_partkey AS STRING), 7, '0') AS line_id,
  CASE WHEN p_partkey % 45 = 7 THEN 'T9999' ELSE {_TENANT} END AS tenant,
  'C' || CAST(p_partkey % 20 AS STRING) AS customer_id,
  CASE WHEN p_partkey % 60 = 6 THEN 'soon' ELSE '2024-03-15' END AS order_date,
  CASE WHEN p_partkey % 50 = 49 THEN 'Delivery Charge' WHEN p_partkey % 50 = 48 THEN '???'
    WHEN p_partkey % 8 = 0 THEN {_NAME} WHEN p_partkey % 8 = 1 THEN {_CODE} || ' ' || {_NAME}
    WHEN p_partkey % 8 = 2 THEN upper(p_name) || ' ' || {_SIZE} || 'mm' WHEN p_partkey % 8 = 3 THEN substr(p_name, 1, length(p_name) - 2) || ' ' || {_SIZE} || 'mm'
    WHEN p_partkey % 8 = 4 THEN 'stainless ' || {_NAME} || ' branda' WHEN p_partkey % 8 = 5 THEN p_name || ' not bulk'
    WHEN p_partkey % 8 = 6 THEN p_name || ' standard' ELSE {_SIZE} || ' mm ' || p_name END AS raw_text,
  '' AS channel, '' AS qty, CASE WHEN p_partkey % 5 = 0 THEN 'carton' ELSE '' END AS uom_text, '' AS unit_price,
  CASE WHEN p_partkey % 6 = 0 THEN 'S' || CAST(p_partkey % 40 AS STRING) ELSE '' END AS buyer_sku,
  CASE WHEN p_partkey % 8 = 6 AND p_partkey % 3 = 0 THEN {_BARCODE} WHEN p_partkey % 70 = 9 THEN '0000' ELSE '' END AS raw_barcode, '' AS notes
FROM part""",
    "texts": f"""SELECT 'X' || lpad(CAST(p_partkey AS STRING), 7, '0') AS line_id, CASE p_partkey % 16
  WHEN 0 THEN 'S/S ' || p_name || ' 3/4"' WHEN 1 THEN 'SS304 ' || p_name || ' M' || {_SIZE} || 'x50' WHEN 2 THEN p_name || ' z.p. class B ' || {_SIZE} || ' cm' WHEN 3 THEN 'ZP ' || p_name || ' 1.5kg'
  WHEN 4 THEN 'SDS ' || upper(p_name) || ' 1-1/2"' WHEN 5 THEN 'skru/' || p_name || '/' || {_SIZE} || 'mm' WHEN 6 THEN 'Ayam 250 g ' || p_name WHEN 7 THEN 'SUSU 1.5 l, ' || p_name || ' 500ml'
  WHEN 8 THEN p_name || ' 2″ flap / cutting' WHEN 9 THEN p_name || ' 7''''  ss 316' WHEN 10 THEN 'Große ' || p_name || ' 1/2/3 HDG' WHEN 11 THEN p_name || ' 10 mm 1 cm black PVC' WHEN 12 THEN 's s ' || p_name || ' stainless 410 0.5 kg 500 g'
  WHEN 13 THEN p_name || ' 1/0 mm brass class a class c' WHEN 14 THEN p_name || ' grinding disc ' || {_SIZE} || ' inch green' ELSE p_name END AS raw_text
FROM part""",
    "aliases": f"""SELECT {_TENANT} AS tenant, 'C' || CAST(p_partkey % 20 AS STRING) AS customer_id, 'S' || CAST(p_partkey % 40 AS STRING) AS customer_sku, {_CODE} AS item_code,
  CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 12 = 2 THEN '2024-04-01' ELSE '2024-01-01' END AS valid_from,
  CASE WHEN p_partkey % 8 = 0 THEN '' WHEN p_partkey % 24 = 10 THEN '2023-12-31' WHEN p_partkey % 100 = 30 THEN 'never' ELSE '2024-12-31' END AS valid_to,
  CASE WHEN p_partkey % 7 = 0 THEN 'inferred_match' ELSE 'confirmed_order' END AS source,
  CASE WHEN p_partkey % 9 = 0 THEN '0.8' WHEN p_partkey % 90 = 11 THEN 'high' ELSE '1' END AS confidence
FROM part WHERE p_partkey % 500 < 60""",
    "labels_of_lines": f"""SELECT 'L' || lpad(CAST(p_partkey AS STRING), 7, '0') AS line_id, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE {_CODE} END AS label FROM part""",
    "policy": """SELECT 'identifier' AS bucket, true AS enabled, 0.94 AS probability UNION ALL SELECT 'lexical_exact', false, 0.7
UNION ALL SELECT 'lexical_high', true, 0.97 UNION ALL SELECT 'lexical_other', true, 0.98 UNION ALL SELECT 'blocked', false, 0.43""",
    "records": """SELECT CAST(o_orderkey AS STRING) AS line_id, o_orderpriority AS tenant,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'P' || CAST(o_custkey % 50 AS STRING) END AS label,
  CASE WHEN o_orderstatus = 'F' THEN 'auto' WHEN o_orderstatus = 'O' THEN 'review' ELSE 'reject' END AS decision,
  CASE WHEN o_orderstatus = 'F' THEN 'P' || CAST((o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) % 50 AS STRING) ELSE '' END AS item_code,
  CAST(CASE o_orderkey % 5 WHEN 0 THEN 0.4 WHEN 1 THEN 0.9 WHEN 2 THEN 0.94 WHEN 3 THEN 0.98 ELSE 1.0 END AS DOUBLE) AS confidence,
  'P' || CAST((o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) % 50 AS STRING) AS first_code, 'P' || CAST((o_custkey + 2) % 50 AS STRING) AS second_code,
  o_orderkey % 3 AS n_candidates, CASE WHEN o_custkey % 3 = 0 THEN 'identifier' WHEN o_custkey % 3 = 1 THEN 'lexical_high' ELSE 'no_candidate' END AS bucket,
  o_orderkey AS position
FROM orders""",
    "day_lines": """SELECT CAST(event_id AS STRING) AS line_id, 'T' || CAST(user_id % 10 AS STRING) AS tenant_id, CAST(user_id AS STRING) AS customer_id, event_type AS channel, substr(CAST(ts AS STRING), 1, 10) AS day FROM events""",
    "day_events": """SELECT CAST(event_id AS STRING) AS line_id, 'T' || CAST(user_id % 10 AS STRING) AS tenant_id, 'I' || regexp_replace(props, '[^0-9]', '', 'g') AS item_code, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END AS accepted, value AS score, value AS latency_ms, substr(CAST(ts AS STRING), 1, 10) AS day FROM events""",
    "day_tenants": """SELECT DISTINCT 'T' || CAST(user_id % 10 AS STRING) AS tenant_id, CASE WHEN user_id % 10 < 5 THEN 'starter' ELSE 'growth' END AS plan FROM events""",
    "day_items": """SELECT DISTINCT 'T' || CAST(user_id % 10 AS STRING) AS tenant_id, 'I' || regexp_replace(props, '[^0-9]', '', 'g') AS item_code, CASE WHEN CAST(regexp_replace(props, '[^0-9]', '', 'g') AS INT) % 10 = 0 THEN 1 ELSE 0 END AS disabled FROM events""",
    "month_lines": """SELECT CAST(o_orderkey AS STRING) AS line_id, CAST(c_nationkey AS STRING) AS tenant_id, CAST(o_custkey AS STRING) AS customer_id, o_orderpriority AS channel, substr(CAST(o_orderdate AS STRING), 1, 7) AS day FROM orders JOIN customer ON o_custkey = c_custkey""",
    "month_events": """SELECT CAST(l_orderkey AS STRING) AS line_id, CAST(s_nationkey AS STRING) AS tenant_id, CAST(l_partkey AS STRING) AS item_code, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS accepted, l_discount AS score, l_quantity AS latency_ms, substr(CAST(l_shipdate AS STRING), 1, 7) AS day FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "month_tenants": """SELECT CAST(n_nationkey AS STRING) AS tenant_id, r_name AS plan FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "month_items": """SELECT CAST(n_nationkey AS STRING) AS tenant_id, CAST(p_partkey AS STRING) AS item_code, CASE WHEN p_size % 10 = 0 THEN 1 ELSE 0 END AS disabled FROM part JOIN nation ON p_size % 10 = 0""",
    "changes": """SELECT 'U' || CAST(user_id AS STRING) AS external_id, '{"k":' || regexp_replace(props, '[^0-9]', '', 'g') || '}' AS payload, event_id AS version, substr(CAST(ts AS STRING), 1, 19) AS updated_at FROM events""",
    "local_records": """SELECT 'U' || CAST(user_id AS STRING) AS id, '{"k":' || CAST(max(event_id) % 100 AS STRING) || '}' AS payload, CASE WHEN user_id % 5 = 0 THEN max(event_id) ELSE min(event_id) END AS version, '' AS updated_utc, user_id % 3 = 0 AS dirty FROM events WHERE user_id % 11 <> 0 GROUP BY user_id""",
    "local_outbox": """SELECT 'op' || CAST(user_id AS STRING) AS op, 'U' || CAST(user_id AS STRING) AS id, '{"k":1}' AS payload, min(event_id) AS base, CASE WHEN user_id % 2 = 0 THEN 'pending' ELSE 'done' END AS state, 'key' || CAST(user_id AS STRING) AS "key" FROM events WHERE user_id % 6 = 0 GROUP BY user_id""",
}
# Aliases of every part, and lines whose buyers' codes meet them: more distinct codes, so that keys stay as ambiguous.
SQL["aliases_all"] = SQL["aliases"].replace("p_partkey % 40 ", "p_partkey % 340 ").removesuffix(" WHERE p_partkey % 500 < 60")
SQL["lines_all"] = SQL["lines"].replace("p_partkey % 40 ", "p_partkey % 340 ")
WHOLE = {"aliases": "aliases_all", "lines": "lines_all"}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


_whole: ContextVar[bool] = ContextVar("whole", default=False)


@contextmanager
def whole_aliases():
    token = _whole.set(True)
    try:
        yield
    finally:
        _whole.reset(token)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input as a DataFrame; within whole_aliases() those of WHOLE stand for the inputs they name."""
    sql = SQL[WHOLE.get(name, name) if _whole.get() else name].replace(", 'g')", ")").replace('"key"', "`key`")
    return spark.sql(_placed(sql), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in sql})


def _placed(sql: str) -> str:
    """Table names as placeholders of the session's own reader; no view is left behind."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    return re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2}", sql)


def ctes(*names: str) -> str:
    """The same inputs as common table expressions."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
