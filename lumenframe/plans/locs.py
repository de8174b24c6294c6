"""Localisations derived from the ``events`` table by whole-number arithmetic.

One SQL text runs on Spark and on DuckDB.  Fields of view have 2500 rows in
500 frames; a molecule shines in ten consecutive frames around a fixed place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FOV_SIZE = 256.0

LOCS_SQL = """
SELECT loc_id, fov_index, frame, molecular_index,
  CAST((molecular_index * 7919) % 241 + 8 AS DOUBLE) + CAST((loc_id * 37) % 65 - 32 AS DOUBLE) / CAST(256 AS DOUBLE) AS xc,
  CAST((molecular_index * 104729) % 241 + 8 AS DOUBLE) + CAST((loc_id * 53) % 65 - 32 AS DOUBLE) / CAST(256 AS DOUBLE) AS yc,
  CAST(1 + loc_id % 31 AS DOUBLE) / CAST(256 AS DOUBLE) AS xc_err, CAST(1 + loc_id % 29 AS DOUBLE) / CAST(256 AS DOUBLE) AS yc_err,
  CAST(1 + loc_id * 37 % 101 AS DOUBLE) AS A_R, CAST(1 + loc_id * 53 % 103 AS DOUBLE) AS A_G, CAST(1 + loc_id * 71 % 107 AS DOUBLE) AS A_B,
  CAST(1 + loc_id % 7 AS DOUBLE) / CAST(64 AS DOUBLE) AS A_R_err, CAST(1 + loc_id % 11 AS DOUBLE) / CAST(64 AS DOUBLE) AS A_G_err, CAST(1 + loc_id % 13 AS DOUBLE) / CAST(64 AS DOUBLE) AS A_B_err,
  CAST(1 + loc_id * 3 % 17 AS DOUBLE) AS bg_R, CAST(1 + loc_id * 5 % 19 AS DOUBLE) AS bg_G, CAST(1 + loc_id * 7 % 23 AS DOUBLE) AS bg_B,
  CAST(1 + loc_id % 5 AS DOUBLE) / CAST(64 AS DOUBLE) AS bg_R_err, CAST(1 + loc_id % 3 AS DOUBLE) / CAST(64 AS DOUBLE) AS bg_G_err, CAST(1 + loc_id % 9 AS DOUBLE) / CAST(64 AS DOUBLE) AS bg_B_err,
  CAST(1 AS DOUBLE) + CAST(loc_id * 11 % 64 AS DOUBLE) / CAST(64 AS DOUBLE) AS s_x, CAST(1 AS DOUBLE) + CAST(loc_id * 13 % 64 AS DOUBLE) / CAST(64 AS DOUBLE) AS s_y,
  CAST(1 + loc_id % 15 AS DOUBLE) / CAST(64 AS DOUBLE) AS s_x_err, CAST(1 + loc_id % 21 AS DOUBLE) / CAST(64 AS DOUBLE) AS s_y_err,
  chi_sqr
FROM (
  SELECT event_id AS loc_id, value AS chi_sqr,
    CAST(FLOOR(event_id / CAST(2500 AS DOUBLE)) AS INT) AS fov_index,
    CAST(FLOOR((event_id % 2500) / CAST(5 AS DOUBLE)) AS INT) AS frame,
    CAST(FLOOR(event_id / CAST(50 AS DOUBLE)) AS BIGINT) * 5 + event_id % 5 AS molecular_index
  FROM {events}) AS numbered
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def locs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LOCS_SQL, events=table(spark, sf_dir, "events"))


def with_locs(sql: str) -> str:
    """SQL over the derived table for an engine that has ``events``."""
    return f"WITH RECURSIVE locs AS ({LOCS_SQL.format(events='events')})\n{sql}"
