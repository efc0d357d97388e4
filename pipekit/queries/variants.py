"""Records of mixed JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pipekit.operators import variants
from pipekit.queries.registry import Tables, query

# A field that is a number, a text, an object or null, one that is not always there, and broken records.
RECORD = """
    CASE WHEN event_id % 101 = 0 THEN '{"id":'
         WHEN event_id % 103 = 0 THEN '[1, 2]'
         ELSE concat('{"id":', event_id, ',"user name":', user_id,
                     CASE WHEN event_id % 2 = 0 THEN ',"even":true' ELSE '' END, ',"v":',
                     CASE event_id % 5 WHEN 0 THEN CAST(user_id AS STRING) WHEN 1 THEN concat('"', event_type, '"')
                                       WHEN 2 THEN concat('"', user_id, '"') WHEN 3 THEN 'null' ELSE props END, '}') END
"""


def _objects(table: Tables) -> DataFrame:
    return _records(table).where("event_id % 103 <> 0 OR event_id % 101 = 0")


def _records(table: Tables) -> DataFrame:
    return table("events").select("event_id", F.expr(RECORD).alias("record"))


KINDS_SQL = """
    WITH good AS (SELECT * FROM events WHERE event_id % 101 <> 0 AND event_id % 103 <> 0),
    kinds AS (
        SELECT 'id' AS field, 'bigint' AS kind FROM good
        UNION ALL SELECT 'user name', 'bigint' FROM good
        UNION ALL SELECT 'even', 'boolean' FROM good WHERE event_id % 2 = 0
        UNION ALL SELECT 'v', CASE event_id % 5 WHEN 0 THEN 'bigint' WHEN 3 THEN 'void' WHEN 4 THEN 'object' ELSE 'string' END FROM good
        UNION ALL SELECT NULL, CASE WHEN event_id % 101 = 0 THEN 'malformed' ELSE 'array' END FROM events
                  WHERE event_id % 101 = 0 OR event_id % 103 = 0)
"""


@query("json_kinds", KINDS_SQL + "SELECT field, kind, count(*) AS n FROM kinds GROUP BY field, kind")
def json_kinds(table: Tables) -> DataFrame:
    return variants.json_kinds(_records(table), "record")


@query(
    "json_fields",
    KINDS_SQL
    + """
    SELECT CAST(row_number() OVER (ORDER BY field) - 1 AS INTEGER) AS ordinal, field, type FROM (
        SELECT field, CASE WHEN count(DISTINCT kind) FILTER (kind <> 'void') = 1 THEN max(kind) ELSE 'variant' END AS type
        FROM kinds WHERE field IS NOT NULL GROUP BY field)
    """,
)
def json_fields(table: Tables) -> DataFrame:
    return variants.json_fields(_objects(table), "record")


@query(
    "json_records",
    """
    SELECT event_id, CASE WHEN good THEN event_id END AS id, CASE WHEN good THEN user_id END AS user_id,
           CASE WHEN good AND event_id % 2 = 0 THEN true END AS even,
           CASE WHEN good AND event_id % 5 = 0 THEN user_id END AS v_number,
           CASE WHEN good AND event_id % 5 = 1 THEN event_type WHEN good AND event_id % 5 = 2 THEN CAST(user_id AS VARCHAR) END AS v_text,
           CASE WHEN good AND event_id % 5 = 4 THEN CAST(regexp_extract(props, '[0-9]+') AS BIGINT) END AS v_k
    FROM (SELECT *, event_id % 101 <> 0 AS good FROM events) WHERE event_id % 103 <> 0 OR NOT good
    """,
)
def json_records(table: Tables) -> DataFrame:
    parsed = variants.parse_records(_objects(table), "record")
    record, v = F.col("record"), F.col("record.v")
    return parsed.select(
        "event_id",
        record["id"].alias("id"),
        record["user name"].alias("user_id"),
        record["even"].alias("even"),
        variants.variant_value(v, "integer").alias("v_number"),
        variants.variant_value(v, "string").alias("v_text"),
        variants.variant_value(v, "integer", "$.k").alias("v_k"),
    )
