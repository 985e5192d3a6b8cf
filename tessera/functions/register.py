"""Scalar functions for SQL text: temporary functions of the session, inlined by Catalyst."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (parameters, type, body). A backslash is written as SQL text needs it.
FUNCTIONS = {
    "collapse": ("s STRING", "STRING", r"trim(regexp_replace(s, '\\s+', ' '))"),
    "raw_token_count": ("s STRING", "BIGINT", r"CAST(regexp_count(coalesce(s, ''), '\\S+') AS BIGINT)"),
    "doi_key": ("s STRING", "STRING", r"nullif(lower(regexp_replace(trim(s), '(?i)^https?://(dx\\.)?doi\\.org/', '')), '')"),
    "title_key": ("s STRING", "STRING", r"trim(regexp_replace(regexp_replace(lower(coalesce(s, '')), '(?U)[^\\w\\s]', ' '), '(?U)\\s+', ' '))"),
    "coerce_year": ("s STRING", "INT", r"CASE WHEN trim(s) RLIKE '^\\d{4}' THEN CAST(substring(trim(s), 1, 4) AS INT) END"),
    "trimf": (
        "x DOUBLE, a DOUBLE, b DOUBLE, c DOUBLE", "DOUBLE",
        "CASE WHEN x = b THEN 1D WHEN a < b AND x > a AND x < b THEN (x - a) / (b - a) WHEN b < c AND x > b AND x < c THEN (c - x) / (c - b) ELSE 0D END",
    ),
    "trapmf": (
        "x DOUBLE, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE", "DOUBLE",
        "CASE WHEN x >= b AND x <= c THEN 1D WHEN a < b AND x > a AND x < b THEN (x - a) / (b - a) WHEN a = b AND x < b THEN 1D "
        "WHEN c < d AND x > c AND x < d THEN (d - x) / (d - c) WHEN c = d AND x > c THEN 1D ELSE 0D END",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
