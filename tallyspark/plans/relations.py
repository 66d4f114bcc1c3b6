"""Backlinks, funders, single-stage tables and restated years over the driver's tables.

Line item: supplier. An order is an appropriation, a part a program; order lines link them. A wide table is a supplier's order lines
with quantities and prices as the cells of two fiscal years.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.functions.numbers import cents_of
from tallyspark.operators import deflate, extract, feed, gap, localfin

from .ledger import period, table


def backlinks(spark, sf_dir):
    """Order lines: the fourth flag-like state of a line names the class; every thirteenth points to nothing."""
    rows = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "N", "appropriation").when(F.col("l_linestatus") == "F", "program").otherwise("act")
    return rows.select(F.col("l_suppkey").alias("item"), kind.alias("class"), F.when(F.col("l_orderkey") % 13 == 0, -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey")).alias("slug"))


def appropriations(spark, sf_dir):
    stage = F.when(F.col("o_orderpriority").startswith("1"), " as-enacted ").when(F.col("o_orderpriority").startswith("2"), "as-enacted").otherwise("as-introduced")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slug"), stage.alias("stage"), F.when(F.col("o_orderstatus") == "P", " ").otherwise(period(F.col("o_orderdate"))).alias("period"), F.when(F.col("o_totalprice") > 20000, cents_of(F.col("o_totalprice"))).alias("cents"))


def nodes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.explode(F.array(*map(F.lit, ("appropriation", "program", "act")))).alias("class"), F.col("o_orderkey").alias("slug"))


def citing(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.lit("appropriation").alias("class"), F.col("l_orderkey").alias("slug"), F.when(F.col("l_returnflag") == "R", "catalog").otherwise("node").alias("kind"), F.col("l_suppkey").alias("target"))
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), F.when(F.col("s_acctbal") > 2000, "parsed").otherwise("unparsed").alias("state"))
    return feed.citing_nodes(rows, sources)


BASIS = "CASE p_size % 5 WHEN 0 THEN 'Not formula driven' WHEN 1 THEN 'Foundation formula' WHEN 2 THEN 'Per pupil [open]' WHEN 3 THEN concat(p_name, ' caseload') END"
MATCH = "CASE p_size % 7 WHEN 0 THEN '  None' WHEN 1 THEN 'FMAP 60%' WHEN 2 THEN 'Unknown [open]' WHEN 3 THEN 'none stated' END"


def funders(spark, sf_dir):
    programs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("program"), F.when(F.col("p_size") % 3 > 0, F.col("p_type")).alias("policy_area"), F.expr(BASIS).alias("formula_basis"), F.expr(MATCH).alias("federal_participation"))
    links = table(spark, sf_dir, "lineitem").where("l_discount > 0.04 AND l_tax < 0.01 AND l_returnflag = 'R'").select(F.col("l_partkey").alias("program"), F.col("l_orderkey").alias("item"))
    return gap.funders(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item")), programs, links)


# Headings of the wide tables, by supplier; both engines read the conditions.
HEADERS = ["CASE WHEN doc % 9 = 4 THEN 'Bureau' ELSE 'Agency' END", "'Fund  Group'", "CASE WHEN doc % 2 = 0 THEN 'ALI' ELSE 'Line-Item Code' END", "'Title'", "CASE WHEN doc % 11 = 5 THEN 'Last year' ELSE 'FY 2024' END", "'Notes'", "CASE WHEN doc % 11 = 5 THEN 'This year' ELSE 'fy2025 approp' END"]
CELLS = ["concat('AG', l_partkey % 3)", "'GRF'", "CAST(l_partkey AS VARCHAR(20))", "concat('Item ', l_linenumber)", "CASE CAST(floor(l_quantity) AS INT) % 6 WHEN 0 THEN '' WHEN 1 THEN ' - ' WHEN 2 THEN 'n/a' WHEN 3 THEN concat('(', CAST(CAST(floor(l_quantity) AS INT) AS VARCHAR(20)), '.25)') ELSE concat('$', CAST(CAST(floor(l_quantity) AS INT) AS VARCHAR(20)), ',000.50') END", "'see text'", "concat(CAST(l_orderkey AS VARCHAR(20)), '.00')"]
ORDER = "l_orderkey, l_linenumber, l_partkey, l_extendedprice"


def wide(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.expr(f"named_struct('a', l_orderkey, 'b', l_linenumber, 'c', l_partkey, 'd', l_extendedprice)").alias("row_idx"), F.array(*map(F.expr, CELLS)).alias("cells"))
    headers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc")).select("doc", F.posexplode(F.array(*map(F.expr, HEADERS))).alias("col_idx", "header"))
    return rows, extract.map_columns(headers)


def outcomes(spark, sf_dir):
    return extract.single_stage(*wide(spark, sf_dir)).withColumn("row_idx", F.concat_ws("/", *[F.col(f"row_idx.{c}").cast("string") for c in "abc"]))


def listed(spark, sf_dir):
    allowed = spark.createDataFrame([("AG0", str(k)) for k in range(0, 90, 3)], "agency string, code string")
    rows = outcomes(spark, sf_dir).where("outcome = 'row'")
    return extract.listed_only(rows, allowed).groupBy("code", "fiscal_year").agg(F.count("*").alias("rows"), F.sum("amount_cents").alias("cents"))


def years(spark, sf_dir):
    """Fiscal years of the orders: categories are priorities, the actual is the share of finished orders, every fourth year has no restated sums."""
    o = table(spark, sf_dir, "orders").select("*", period(F.col("o_orderdate")).alias("period"), cents_of(F.col("o_totalprice")).alias("c"), F.substring("o_orderpriority", 1, 1).alias("p"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0)).cast("bigint")
    rows = o.groupBy("period").agg(
        total(F.col("p") == "1").alias("nominal_shared_cents"), total(F.col("p") == "2").alias("nominal_reimbursement_cents"), F.sum(F.when((F.col("p") == "1") & (F.col("o_orderstatus") == "F"), F.col("c"))).alias("actual_shared_cents"),
        F.sum(F.when((F.col("p") == "2") & (F.col("o_orderstatus") == "F"), F.col("c"))).alias("actual_reimbursement_cents"), total(F.col("p") == "3").alias("own"), total(F.col("p") == "4").alias("found"),
    )
    number = F.substring("period", 3, 4).cast("int")
    real = lambda c: F.when(number % 4 != 0, F.col(c) + F.expr("CAST(substring(period, 3, 4) AS INT) * 7"))
    return rows.select("*", real("own").alias("real_own_source_cents"), real("nominal_shared_cents").alias("real_shared_cents"), real("nominal_reimbursement_cents").alias("real_reimbursement_cents"), real("found").alias("real_foundation_cents"))


def nominal(spark, sf_dir):
    purpose = F.element_at(F.array(*map(F.lit, ("Debt Service on ", "general ", "BONDED ", "Statutory threshold "))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", deflate.is_nominal(F.concat(purpose, "p_name")).alias("nominal"))


QUERIES = {
    "j33_enacted_by_period": lambda s, d: feed.enacted_by_period(backlinks(s, d), appropriations(s, d)),
    "a35_related_nodes": lambda s, d: feed.related_nodes(backlinks(s, d), nodes(s, d)),
    "j35_citing_nodes": citing,
    "p09_funders": funders,
    "c24_single_stage": outcomes,
    "c24_stage_coverage": lambda s, d: extract.stage_coverage(outcomes(s, d)),
    "c24_mapped_columns": lambda s, d: wide(s, d)[1].withColumn("years", F.array_join(F.transform("years", lambda y: F.concat_ws("=", y["col_idx"].cast("string"), y["fiscal_year"])), ",")),
    "p13_listed_rows": listed,
    "c32_local_points": lambda s, d: localfin.points(years(s, d)),
    "p19_nominal_by_nature": nominal,
}

_BACK = """bl AS (SELECT l_suppkey AS item, CASE WHEN l_returnflag = 'N' THEN 'appropriation' WHEN l_linestatus = 'F' THEN 'program' ELSE 'act' END AS class, CASE WHEN l_orderkey % 13 = 0 THEN -l_orderkey - 1 ELSE l_orderkey END AS slug FROM lineitem)"""
_PERIOD = "'FY' || (year(o_orderdate) + CASE WHEN month(o_orderdate) >= 7 THEN 1 ELSE 0 END)"
_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_OUT = f"""hd AS (SELECT s_suppkey AS doc, unnest([{', '.join(x.replace('doc', 's_suppkey') for x in HEADERS)}]) AS header, unnest(range(7)) AS col_idx FROM supplier),
pl AS (SELECT *, trim(regexp_replace(lower(header), '[^a-z0-9]+', ' ', 'g')) AS plain, regexp_extract(trim(regexp_replace(lower(header), '[^a-z0-9]+', ' ', 'g')), '\\bfy ?([0-9]{{4}})\\b', 1) AS y FROM hd),
mp AS (SELECT doc, min(col_idx) FILTER (plain IN ('agency code', 'agency', 'agy')) AS agency_at, min(col_idx) FILTER (plain IN ('ali', 'line item code', 'ali code', 'code')) AS code_at, min(col_idx) FILTER (plain IN ('line item name', 'line item', 'ali name', 'title', 'name')) AS name_at,
  min(col_idx) FILTER (plain IN ('fund group', 'group')) AS fund_group_at, min(col_idx) FILTER (plain IN ('fund', 'fund code')) AS fund_at, coalesce(string_agg(col_idx || '=FY' || y, ',' ORDER BY col_idx) FILTER (y <> ''), '') AS years FROM pl GROUP BY doc),
mc AS (SELECT *, CASE WHEN agency_at IS NULL THEN 'no_agency' WHEN code_at IS NULL THEN 'no_code' WHEN name_at IS NULL THEN 'no_name' WHEN years = '' THEN 'no_fiscal_year' END AS refused FROM mp),
wd AS (SELECT l_suppkey AS doc, l_orderkey || '/' || l_linenumber || '/' || l_partkey AS row_idx, [{', '.join(CELLS)}] AS cells FROM lineitem),
oc AS (SELECT wd.doc, row_idx, cells[agency_at + 1] AS agency, cells[code_at + 1] AS code, cells[name_at + 1] AS name, coalesce(cells[fund_group_at + 1], '[open]') AS fund_group, CASE WHEN fund_at IS NULL THEN '[open]' ELSE cells[fund_at + 1] END AS fund, 'FY' || y AS fiscal_year, trim(cells[col_idx + 1]) AS raw
  FROM wd JOIN mc ON mc.doc = wd.doc AND refused IS NULL JOIN pl ON pl.doc = wd.doc AND y <> ''),
oo AS (SELECT doc, row_idx, agency, code, name, fund_group, fund, fiscal_year, CASE WHEN raw IN ('', '-') THEN 'blank' WHEN regexp_full_match(raw, '[$]?[0-9,]+[.][0-9]{{2}}|[(][0-9]+[.][0-9]{{2}}[)]') THEN 'row' ELSE 'unparsed' END AS outcome, raw FROM oc),
ou AS (SELECT * EXCLUDE (raw), CASE WHEN outcome = 'row' THEN CAST(regexp_replace(raw, '[^0-9]', '', 'g') AS BIGINT) * CASE WHEN raw LIKE '(%' THEN -1 ELSE 1 END END AS amount_cents, CASE WHEN outcome = 'unparsed' THEN raw END AS raw FROM oo)"""
ORACLES = {
    "j33_enacted_by_period": f"""WITH {_BACK}, ap AS (SELECT o_orderkey AS slug, {_PERIOD} AS period, {_CENTS} AS cents FROM orders WHERE left(o_orderpriority, 1) IN ('1', '2') AND o_orderstatus <> 'P' AND o_totalprice > 20000)
SELECT item, period, cents, bl.slug, CAST(row_number() OVER (PARTITION BY item ORDER BY CAST(right(period, 4) AS INTEGER), bl.slug, cents) AS INTEGER) AS place FROM bl JOIN ap ON ap.slug = bl.slug WHERE class = 'appropriation'""",
    "a35_related_nodes": f"WITH {_BACK}, n AS (SELECT item, class, count(*) AS nodes FROM bl WHERE slug IN (SELECT o_orderkey FROM orders) GROUP BY item, class) SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY nodes DESC, class) AS INTEGER) AS place FROM n",
    "j35_citing_nodes": "SELECT DISTINCT 'appropriation' AS class, l_orderkey AS slug, l_suppkey AS source FROM lineitem JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 2000 WHERE l_returnflag = 'R'",
    "p09_funders": f"""WITH k AS (SELECT DISTINCT l_orderkey AS item, l_partkey FROM lineitem WHERE l_discount > 0.04 AND l_tax < 0.01 AND l_returnflag = 'R'), p AS (SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_type END AS area, {BASIS} AS b, {MATCH} AS m FROM part),
f AS (SELECT item, count(area) AS areas, coalesce(bool_or(b NOT LIKE '%Not formula%' AND b NOT LIKE '%[open]%'), false) AS formula, coalesce(bool_or(ltrim(m) NOT LIKE 'None%' AND m NOT LIKE '%[open]%'), false) AS matched FROM k JOIN p USING (l_partkey) GROUP BY item)
SELECT o_orderkey AS item, coalesce(areas, 0) AS policy_areas, coalesce(formula, false) AS formula_driven, coalesce(matched, false) AS federally_matched, CASE WHEN matched THEN 'entitlement' WHEN formula THEN 'formula' ELSE 'unclassified' END AS character FROM orders LEFT JOIN f ON item = o_orderkey""".replace("USING (l_partkey)", "ON p_partkey = l_partkey"),
    "c24_single_stage": f"WITH {_OUT}, rs AS (SELECT *, CASE WHEN outcome = 'unparsed' THEN 'not_money' END AS reason FROM ou) SELECT * FROM rs",
    "c24_stage_coverage": f"WITH {_OUT} SELECT doc, count(*) FILTER (outcome = 'row') AS rows, count(*) FILTER (outcome = 'blank') AS blanks, count(*) FILTER (outcome = 'unparsed') AS unparsed, count(*) AS cells FROM ou GROUP BY doc",
    "c24_mapped_columns": f"WITH {_OUT} SELECT * FROM mc",
    "p13_listed_rows": f"WITH {_OUT} SELECT code, fiscal_year, count(*) AS rows, CAST(sum(amount_cents) AS BIGINT) AS cents FROM ou WHERE outcome = 'row' AND agency = 'AG0' AND TRY_CAST(code AS INTEGER) IN (SELECT unnest(range(0, 90, 3))) GROUP BY code, fiscal_year",
    "c32_local_points": f"""WITH o AS (SELECT *, {_PERIOD} AS period, {_CENTS} AS c, left(o_orderpriority, 1) AS p FROM orders),
y AS (SELECT period, CAST(right(period, 4) AS INTEGER) AS n, coalesce(sum(c) FILTER (p = '1'), 0) AS ns, coalesce(sum(c) FILTER (p = '2'), 0) AS nr, sum(c) FILTER (p = '1' AND o_orderstatus = 'F') + sum(c) FILTER (p = '2' AND o_orderstatus = 'F') AS paid,
  coalesce(sum(c) FILTER (p = '3'), 0) AS own, coalesce(sum(c) FILTER (p = '4'), 0) AS found FROM o GROUP BY period)
SELECT period, CAST(own + 7 * n AS BIGINT) AS own_source, CAST(ns + 7 * n AS BIGINT) AS shared, CAST(nr + 7 * n AS BIGINT) AS reimbursement, CAST(ns + nr + 14 * n AS BIGINT) AS state_money, CAST(found + 7 * n AS BIGINT) AS school_foundation, CAST(ns + nr + found + 21 * n AS BIGINT) AS state_money_wide,
  CASE WHEN ns + nr <> 0 THEN CAST((2 * paid::HUGEINT * (ns + nr + 14 * n)::HUGEINT + (ns + nr)) // (2 * (ns + nr)) AS BIGINT) END AS state_money_paid FROM y WHERE n % 4 <> 0""",
    "p19_nominal_by_nature": "SELECT p_partkey, p_partkey % 4 <> 1 OR regexp_matches(lower(p_name), 'debt service|bond|statutory threshold|principal and interest') AS nominal FROM part",
}
