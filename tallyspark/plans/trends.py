"""Trend of the gap between adjacent periods of a line item."""

from __future__ import annotations

from tallyspark.operators import gap as ops

from .ledger import ADJ_SQL, gaps, start_year
from .prices import FACTORS_SQL, factors


def c05_trend(spark, sf_dir):
    return ops.trend(gaps(spark, sf_dir), factors(spark, sf_dir), start_year())


QUERIES = {"c05_trend": c05_trend}
ORACLES = {
    "c05_trend": f"""WITH {ADJ_SQL}, {FACTORS_SQL}, t AS (SELECT adj.*, f0.factor AS f0, f1.factor AS f1 FROM adj LEFT JOIN factors f0 ON adj.period = f0.period LEFT JOIN factors f1 ON adj.to_period = f1.period WHERE to_period IS NOT NULL),
s AS (SELECT *, CASE WHEN status <> 'computed' THEN status WHEN to_status <> 'computed' THEN to_status WHEN f0 IS NULL OR f1 IS NULL THEN 'refused' ELSE 'computed' END AS trend_status FROM t)
SELECT item, period, to_period, trend_status,
  CASE WHEN status <> 'computed' THEN 'from_' || reason_code WHEN to_status <> 'computed' THEN 'to_' || to_reason WHEN f0 IS NULL OR f1 IS NULL THEN 'period_not_in_index' END AS trend_reason,
  CASE WHEN trend_status = 'computed' THEN to_variance - variance_cents END AS nominal_change_cents,
  CASE WHEN trend_status = 'computed' THEN CAST(round(to_variance * f1) AS BIGINT) - CAST(round(variance_cents * f0) AS BIGINT) END AS real_change_cents FROM s""",
}
