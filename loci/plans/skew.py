"""Per-project results under skew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loci.operators import skew
from loci.runtime import table

SHARES = (0.5, 0.9, 0.99)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_values(table(spark, d, "memories", "project_id", "type"), "project_id", "type", 0.04).select("project_id")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return skew.key_counts(table(spark, d, "memories", "project_id", "access_count"), "project_id", "access_count")


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return skew.key_percentiles(table(spark, d, "memories", "project_id", "access_count"), "project_id", "access_count", SHARES)


QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts, "p5_percentiles": p5_percentiles}

ORACLES = {
    "p5_found": """
SELECT project_id FROM memories WHERE project_id IS NOT NULL GROUP BY project_id
HAVING count(*) >= 0.04 * (SELECT count(*) FROM memories)""",
    "p5_counts": """
WITH f AS (SELECT project_id, access_count AS v, count(*) AS n FROM memories GROUP BY 1, 2)
SELECT project_id, sum(n)::BIGINT AS n_rows, count(v) AS n_distinct,
  max(n) FILTER (v IS NOT NULL) AS mode_rows,
  (list(v ORDER BY n DESC, v) FILTER (v IS NOT NULL))[1] AS mode
FROM f GROUP BY project_id""",
    "p5_percentiles": """
WITH o AS (
  SELECT project_id, access_count::DOUBLE AS v, row_number() OVER (PARTITION BY project_id ORDER BY access_count) AS r, count(*) OVER (PARTITION BY project_id) AS n
  FROM memories WHERE access_count IS NOT NULL)
SELECT project_id, q::DOUBLE AS share, v AS percentile FROM o, (VALUES (0.5), (0.9), (0.99)) t(q)
WHERE r = greatest(1, ceil(q::DOUBLE * n)::BIGINT)""",
}
