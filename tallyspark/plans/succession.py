"""Lineage, namesakes and promotion over the driver's tables and records written for every supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import lineage, promote

from . import fixtures as fx
from .ledger import table

STATUS = ["active", "superseded", "retired", "restructured", "active"]
ROWS = fx.Copied("ext", "row_id int, code string, fiscal_year string, stage string, amount_cents bigint, source string", [
    (1, "2@", "FY2034", "as-enacted", 100, "book"), (2, "3@", "FY2034", "as-enacted", 200, "book"), (3, "2", "FY2034", "as-enacted", 300, "book"), (4, "2@", "FY2038", "as-enacted", 400, "book"),
    (5, "2@", "FY2034", "as-enacted", 500, "synthetic-fixture"), (6, "9@", "FY2034", "introduced", 600, "gone"), (7, "6@", "FY2034", "as-enacted", 700, "gone"), (8, "2", "FY2035", "as-enacted", 1, "book"),
], ("row_id", "amount_cents"))
ITEMS = fx.Copied("items", "item string, pos int, current_code string, historical_codes string", [("parks/@", 0, "2@", "3@; 4@"), ("second/@", 1, "2@", "3@"), ("lakes/@", 2, "6@", "x3@2 6@-321"), ("none/@", 3, "", "")], ("pos",))
APPR = fx.Copied("appr", "path string, pos int, item string, fiscal_year string, stage string, is_open boolean", [
    ("a/@-1.yml", 0, "parks/@", "FY2034", "as-enacted", True), ("a/@-2.yml", 1, "parks/@", "FY2034", "as-enacted", False), ("a/@-3.yml", 2, "second/@", "FY2034", "as-enacted", True), ("a/@-4.yml", 3, "lakes/@", "FY2035", "as-enacted", True),
], ("pos",))
SOURCES = fx.Rows("src", "slug string, content_committed boolean", [("book", True), ("other", False)])


def items(spark, sf_dir):
    """Line items: distinct part names; status, agency and periods follow from the name's length and numbers. Suppliers share one token and have no periods, so nothing succeeds them."""
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_size").alias("size"), F.min("p_brand").alias("agency"))
    k = F.pmod(F.length("p_name"), F.lit(5))
    retired = F.element_at(F.array(*map(F.lit, ("retired", "superseded", "active"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("first_period", "last_period")]
    others = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("item"), F.col("s_name").alias("name"), retired.alias("status"), F.lit("C").alias("agency"), *nothing)
    return others.unionByName(names.select(F.col("p_name").alias("item"), F.col("p_name").alias("name"), F.element_at(F.array(*map(F.lit, STATUS)), (k + 1).cast("int")).alias("status"), F.when(F.pmod(F.length("p_name"), F.lit(2)) == 0, "A").otherwise("B").alias("agency"),
                        F.when(k > 0, "FY2010").alias("first_period"), F.when(k < 3, "FY2020").otherwise("[open]").alias("last_period")))


def links(spark):
    return spark.createDataFrame([("A", "B")], "old string, new string"), spark.createDataFrame([("red bolt", "blue gear"), ("hot gear", "small ring")], "pred string, succ string")


def c18(spark, sf_dir):
    return lineage.propose(items(spark, sf_dir), *links(spark))


def c19(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("agency"), F.col("s_suppkey").alias("code"), F.concat(F.lit("School Fund "), F.substring("s_name", -1, 1), F.when(F.col("s_suppkey") % 3 == 0, " Audit").when(F.col("s_suppkey") % 3 == 1, " Extra").otherwise("")).alias("name"), F.round(F.col("s_acctbal") * 100).cast("bigint").alias("cents"))
    return lineage.slices(rows)


def c21(spark, sf_dir):
    return promote.propose(ROWS.frame(spark, sf_dir), ITEMS.frame(spark, sf_dir), APPR.frame(spark, sf_dir), SOURCES.frame(spark, sf_dir))


QUERIES = {
    "c18_lineage": c18,
    "j29_unresolved": lambda s, d: lineage.unresolved(items(s, d), c18(s, d)),
    "c19_slices": c19,
    "c21_promote": c21,
    "j15_priority_match": lambda s, d: promote.match_codes(ROWS.frame(s, d), ITEMS.frame(s, d)).select("row_id", "item", "by_current"),
    "j30_still_open": lambda s, d: promote.still_open(APPR.frame(s, d), c21(s, d)),
    "a22_topk_unmatched": lambda s, d: promote.unmatched(c21(s, d)),
}

_ITEMS = """it AS (SELECT p_name AS item, ['active', 'superseded', 'retired', 'restructured', 'active'][length(p_name) % 5 + 1] AS status, CASE WHEN length(p_name) % 2 = 0 THEN 'A' ELSE 'B' END AS agency,
  length(p_name) % 5 > 0 AS has_first, length(p_name) % 5 < 3 AS has_last, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: strlen(x) > 2) AS tok FROM (SELECT DISTINCT p_name FROM part)
  UNION ALL SELECT s_name, ['retired', 'superseded', 'active'][s_suppkey % 3 + 1], 'C', false, false, list_filter(regexp_split_to_array(lower(s_name), '[^a-z0-9]+'), lambda x: strlen(x) > 2) FROM supplier),
st AS (SELECT * FROM (VALUES ('red bolt', 'blue gear'), ('hot gear', 'small ring')) v(pred, succ)),
pr AS (SELECT p.item AS pred, s.item AS succ, p.agency = 'A' AND s.agency = 'B' AS moved, st.pred IS NOT NULL AS asserted, len(list_filter(p.tok, lambda x: list_contains(s.tok, x))) AS sh, len(p.tok) AS np, len(s.tok) AS ns, p.has_last AND s.has_first AS both_
  FROM it p JOIN it s ON p.item <> s.item LEFT JOIN st ON st.pred = p.item AND st.succ = s.item WHERE p.status IN ('superseded', 'retired', 'restructured')),
sc AS (SELECT pred, succ, asserted, least(1.0, round(CAST(0.2 AS DOUBLE) + CAST(0.4 AS DOUBLE) * CASE WHEN np = 0 OR ns = 0 THEN 0 ELSE CAST(sh AS DOUBLE) / (np + ns - sh) END + CASE WHEN moved THEN CAST(0.3 AS DOUBLE) ELSE 0 END + CASE WHEN both_ THEN CAST(0.1 AS DOUBLE) ELSE 0 END, 9)) AS confidence FROM pr),
prop AS (SELECT pred, succ, CAST(confidence AS DOUBLE) AS confidence, asserted, true AS requires_confirmation FROM sc WHERE confidence >= 0.35 OR asserted)"""
_MATCH = f"""{ROWS.sql()}, {ITEMS.sql()}, {APPR.sql()}, {SOURCES.sql()}, cand AS (SELECT current_code AS code, 1 AS p, -pos AS r, item FROM items WHERE current_code <> '' UNION ALL SELECT unnest(regexp_split_to_array(historical_codes, '[^A-Za-z0-9]')), 0, pos, item FROM items),
best AS (SELECT code, arg_max(item, (p, r)) AS item, max(p) = 1 AS by_current FROM cand WHERE code <> '' GROUP BY code), mt AS (SELECT ext.*, item, by_current FROM ext LEFT JOIN best USING (code)),
fa AS (SELECT item, fiscal_year, stage, arg_min(path, pos) AS path FROM appr GROUP BY ALL),
pro AS (SELECT row_id, code, mt.fiscal_year, mt.stage, amount_cents, CASE WHEN source = 'synthetic-fixture' THEN 'refused_synthetic' WHEN mt.item IS NULL THEN 'unmatched_code' WHEN fa.path IS NULL THEN 'unmatched_figure' ELSE 'proposed' END AS outcome, fa.path AS fp, by_current, coalesce(content_committed, false) AS may_mark_verified
  FROM mt LEFT JOIN fa ON mt.item = fa.item AND mt.fiscal_year = fa.fiscal_year AND mt.stage = fa.stage LEFT JOIN src ON src.slug = mt.source),
prop2 AS (SELECT row_id, code, fiscal_year, stage, amount_cents, outcome, CASE WHEN outcome = 'proposed' THEN fp END AS path, CASE WHEN outcome = 'proposed' THEN NOT by_current END AS needs_review, may_mark_verified FROM pro)"""
ORACLES = {
    "c18_lineage": f"WITH {_ITEMS} SELECT * FROM prop",
    "j29_unresolved": f"WITH {_ITEMS} SELECT item, status FROM it WHERE status IN ('superseded', 'retired') AND item NOT IN (SELECT pred FROM prop)",
    "c19_slices": """WITH b AS (SELECT s_nationkey AS agency, s_suppkey AS code, 'School Fund ' || right(s_name, 1) || CASE s_suppkey % 3 WHEN 0 THEN ' Audit' WHEN 1 THEN ' Extra' ELSE '' END AS name, CAST(round(s_acctbal * 100) AS BIGINT) AS cents FROM supplier),
f AS (SELECT a.*, o.cents AS c2 FROM b a JOIN b o ON a.agency = o.agency AND a.code <> o.code AND NOT regexp_matches(lower(o.name), 'program support|administration|oversight|fraud|audit|reconciliation') AND
  CASE WHEN strlen(a.name) <= strlen(o.name) THEN starts_with(lower(o.name), lower(a.name)) ELSE starts_with(lower(a.name), lower(o.name)) END)
SELECT agency, code, name, cents AS own_cents, count(*) AS siblings, CAST(sum(c2) AS BIGINT) AS sibling_cents, round(CAST(cents AS DOUBLE) / nullif(CAST(cents + sum(c2) AS DOUBLE), 0), 6) AS own_share FROM f GROUP BY agency, code, name, cents""",
    "c21_promote": f"WITH {_MATCH} SELECT * FROM prop2",
    "j15_priority_match": f"WITH {_MATCH} SELECT row_id, item, by_current FROM mt",
    "j30_still_open": f"WITH {_MATCH} SELECT path FROM appr WHERE is_open AND path NOT IN (SELECT path FROM prop2 WHERE path IS NOT NULL)",
    "a22_topk_unmatched": f"WITH {_MATCH} SELECT code, count(*) AS n FROM prop2 WHERE outcome LIKE 'unmatched%' GROUP BY code ORDER BY n DESC, code LIMIT 12",
}
