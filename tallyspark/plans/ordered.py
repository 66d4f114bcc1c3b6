"""Reports in their published order, with each row's place, their labels and formats, and the derived fields that travel with records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import numbers
from tallyspark.functions.numbers import parse_money_strict
from tallyspark.operators import comparison, feed, localfin, stages
from tallyspark.operators.deflate import deflate, period_kind

from . import comparing, graphs, movement, prices, relations, site, succession
from .ledger import start_year, table


def findings(spark, sf_dir):
    """Errors before warnings, then by path and rule."""
    rows = graphs.v_rules(spark, sf_dir).withColumn("level", F.when(F.col("severity") == "error", 0).otherwise(1))
    return feed.placed(rows, ["level", "path"], [F.asc("rule")]).drop("level")


def candidates(spark, sf_dir):
    return feed.placed(succession.c18(spark, sf_dir), ["-confidence"], [F.asc("succ"), F.asc("pred")])


def nodes(spark, sf_dir):
    return feed.placed(site.views(spark, sf_dir).select("class", "slug", "path", "n_links"), ["class"], [F.asc("slug"), F.asc("path")])


def points(spark, sf_dir):
    rows = prices.nation_points(spark, sf_dir).withColumn("start", start_year())
    return feed.placed(rows.withColumn("kind", period_kind(F.col("period"))), ["item"], [F.asc("start"), F.asc("period")])


def classes(spark, sf_dir):
    rows = relations.backlinks(spark, sf_dir).groupBy("item", "class").agg(F.count("*").alias("nodes"))
    return feed.placed(rows, ["-nodes"], [F.asc("class"), F.asc("item")])


def slices(spark, sf_dir):
    return feed.placed(succession.c19(spark, sf_dir).select("agency", "code", "name", "siblings"), ["agency"], [F.asc("code")])


def ownership(spark, sf_dir):
    number = F.regexp_extract("p_brand", r"([0-9]+)$", 1).cast("int")
    kinds = table(spark, sf_dir, "part").select(F.col("p_brand").alias("code"), F.element_at(F.array(*map(F.lit, movement.CATEGORIES)), number % 4 + 1).alias("category")).distinct()
    return localfin.by_ownership(movement.cells(spark, sf_dir), kinds)


def line_tests(spark, sf_dir):
    rows = comparing.lines(spark, sf_dir)
    cells = F.col("cells")
    return rows.select(
        "doc", "page", "line_no", comparison.is_blank(cells).alias("blank"), (F.size(F.flatten(F.transform(cells, lambda c: comparison.struck(c)["spans"]))) > 0).alias("struck"),
        F.exists(F.transform(cells, lambda c: F.concat(F.regexp_extract(c, "[0-9]+", 0), F.lit(".00"))), lambda c: parse_money_strict(c).isNotNull()).alias("money"),
    )


def amounts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(site.CENTS).cast("bigint").alias("cents"), F.expr(PCT).alias("pct"), F.expr("o_custkey * 10 + 3").alias("whole"))


def labels(spark, sf_dir):
    """Parts as line items: every third has no node of its own, every fifth node is another class's."""
    slug = F.replace(F.concat_ws("-", "p_name", "p_partkey"), F.lit(" "), F.lit("-"))
    rows = table(spark, sf_dir, "part").select("p_partkey", slug.alias("slug"), F.element_at(F.array(*map(F.lit, STAGES)), (F.col("p_partkey") % len(STAGES) + 1).cast("int")).alias("stage"))
    nodes = table(spark, sf_dir, "part").where("p_partkey % 3 > 0").select(F.when(F.col("p_partkey") % 5 == 0, "program").otherwise("line-item").alias("class"), slug.alias("slug"), F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("label"))
    return feed.with_item_labels(rows, nodes).select("p_partkey", "label", feed.stage_label(F.col("stage")).alias("stage"))


def changes(spark, sf_dir):
    rows = prices.nation_points(spark, sf_dir).join(prices.factors(spark, sf_dir), "period")
    return feed.series_change(rows.withColumn("real_cents", deflate(F.col("cents"), F.col("factor"))), start_year()).withColumns({c: F.round(c, 6) for c in ("nominal_pct", "real_pct")})


def figures(spark, sf_dir):
    nodes = relations.nodes(spark, sf_dir).withColumn("has_figure", (F.col("slug") % 4 > 0) & (F.col("class") != "act"))
    return feed.related_figures(relations.backlinks(spark, sf_dir), nodes)


def lookups(spark, sf_dir):
    nodes = relations.nodes(spark, sf_dir).where("class <> 'act'").withColumn("path", F.concat_ws("/", "class", "slug"))
    return feed.node_of(nodes, relations.backlinks(spark, sf_dir).select("class", "slug").distinct())


#: A percentage of an order, null for every eighth; the last digit keeps it off the halves.
PCT = "CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST((o_custkey * 10 + 3) * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS DOUBLE) / 1000 END"
STAGES = [*feed.STAGE_LABELS, "committee"]

QUERIES = {
    "f04_money_labels": lambda s, d: amounts(s, d).select("o_orderkey", numbers.dollars(F.col("cents")).alias("dollars"), numbers.exact(F.col("cents")).alias("exact"), numbers.delta(F.col("cents")).alias("delta"), numbers.percent_label(F.col("pct")).alias("pct")),
    "f35_item_and_stage_labels": labels,
    "f39_report_formats": lambda s, d: amounts(s, d).select("o_orderkey", numbers.billions(F.col("cents")).alias("billions"), numbers.share_label(F.abs("cents") % 1000, F.when(F.col("o_orderkey") % 6 > 0, F.col("whole"))).alias("share"), feed.severity_label(F.when(F.col("o_orderkey") % 2 == 0, "error").otherwise("warn")).alias("severity")),
    "w07_series_change": changes,
    "j34_related_figures": figures,
    "p35_node_of": lookups,
    "o01_findings_in_order": findings,
    "o02_candidates_in_order": candidates,
    "o04_nodes_in_order": nodes,
    "o05_points_in_order": points,
    "o10_classes_in_order": classes,
    "o11_slices_in_order": slices,
    "p39_line_tests": line_tests,
    "p40_by_ownership": ownership,
    "p42_readings": lambda s, d: stages.with_readings(movement.c12(s, d)),
}
_KINDS = "[" + ", ".join(f"'{c}'" for c in movement.CATEGORIES) + "]"
ORACLES = {
    "o01_findings_in_order": f"SELECT *, row_number() OVER (ORDER BY severity, path, rule) AS place FROM ({graphs.ORACLES['v_rules']})",
    "o02_candidates_in_order": f"SELECT *, row_number() OVER (ORDER BY confidence DESC, succ, pred) AS place FROM ({succession.ORACLES['c18_lineage']})",
    "o04_nodes_in_order": f"SELECT class, slug, path, n_links, row_number() OVER (ORDER BY class, slug, path) AS place FROM ({site.ORACLES['c30_node_views']})",
    "o05_points_in_order": f"""WITH {prices.POINTS_SQL}, s AS (SELECT *, CAST(substr(period, 3, 4) AS INTEGER) AS start, CASE WHEN regexp_matches(period, '^[^-]*-[0-9]+$') THEN 'biennial' ELSE 'annual' END AS kind FROM points)
SELECT *, row_number() OVER (ORDER BY item, start, period) AS place FROM s""",
    "o10_classes_in_order": f"WITH {relations._BACK}, n AS (SELECT item, class, count(*) AS nodes FROM bl GROUP BY item, class) SELECT *, row_number() OVER (ORDER BY nodes DESC, class, item) AS place FROM n",
    "o11_slices_in_order": f"SELECT agency, code, name, siblings, row_number() OVER (ORDER BY agency, code) AS place FROM ({succession.ORACLES['c19_slices']})",
    "p39_line_tests": f"""WITH {comparing.PRINTED}, line AS (SELECT doc, page, k AS line_no, [{comparing.FIRST}, {comparing.SECOND}, {comparing.THIRD}] AS cells FROM printed)
SELECT doc, page, line_no, trim(array_to_string(cells, '')) = '' AS blank, contains(array_to_string(cells, ' '), '[***VETOED:') AS struck, regexp_matches(array_to_string(cells, ' '), '[0-9]') AS money FROM line""",
    "p40_by_ownership": f"""WITH {movement.CELLS}, k AS (SELECT DISTINCT p_brand AS code, {_KINDS}[CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) % 4 + 1] AS category FROM part)
SELECT measure, year, CAST(coalesce(sum(cents) FILTER (category <> 'own_source'), 0) AS BIGINT) AS state_cents, CAST(coalesce(sum(cents) FILTER (category IN ('shared', 'reimbursement')), 0) AS BIGINT) AS narrow_cents, CAST(sum(cents) AS BIGINT) AS all_cents FROM cells JOIN k USING (code) GROUP BY measure, year""",
    "p42_readings": f"WITH c AS ({movement.ORACLES['c12_decompose']}) SELECT *, bool_and(skipped = '') OVER (PARTITION BY item, period) AS is_complete FROM c",
    "f04_money_labels": f"""WITH a AS (SELECT o_orderkey, CAST({site.CENTS} AS BIGINT) AS cents, {PCT} AS p FROM orders),
b AS (SELECT *, abs(cents) AS n, CASE WHEN abs(cents) >= 100000000000 THEN printf('%.2fB', abs(cents) / 100000000000.0::DOUBLE) WHEN abs(cents) >= 100000000 THEN printf('%.1fM', abs(cents) / 100000000.0::DOUBLE) WHEN abs(cents) >= 100000 THEN printf('%.0fK', abs(cents) / 100000.0::DOUBLE) ELSE printf('%.0f', abs(cents) / 100.0::DOUBLE) END AS short FROM a)
SELECT o_orderkey, CASE WHEN cents < 0 THEN '-$' WHEN cents IS NOT NULL THEN '$' END || format('{{:,}}', (n + 50) // 100) AS dollars, CASE WHEN cents < 0 THEN '-$' WHEN cents IS NOT NULL THEN '$' END || format('{{:,}}', n // 100) || '.' || lpad(CAST(n % 100 AS VARCHAR), 2, '0') AS exact,
  CASE WHEN cents = 0 THEN '$0' ELSE CASE WHEN cents > 0 THEN '+$' WHEN cents < 0 THEN '−$' END || short END AS delta, CASE WHEN p IS NULL THEN 'no authority to take a share of' ELSE CASE WHEN p > 0 THEN '+' WHEN p < 0 THEN '−' ELSE '' END || printf('%.2f', abs(p)) || '%' END AS pct FROM b""",
    "f35_item_and_stage_labels": f"""WITH s AS (SELECT p_partkey, replace(p_name || '-' || p_partkey, ' ', '-') AS slug, [{', '.join(f"'{feed.STAGE_LABELS.get(x, x)}'" for x in STAGES)}][CAST(p_partkey % {len(STAGES)} AS INTEGER) + 1] AS stage, p_name, p_brand FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 5 > 0 THEN p_name || ' (' || p_brand || ')' ELSE upper(left(replace(slug, '-', ' '), 1)) || substr(replace(slug, '-', ' '), 2) END AS label, stage FROM s""",
    "f39_report_formats": f"""WITH a AS (SELECT o_orderkey, CAST({site.CENTS} AS BIGINT) AS cents, CASE WHEN o_orderkey % 6 > 0 THEN o_custkey * 10 + 3 END AS whole FROM orders)
SELECT o_orderkey, CASE WHEN cents IS NOT NULL THEN printf('%7.2f', cents / 100000000000.0::DOUBLE) END AS billions, CASE WHEN whole > 0 AND cents IS NOT NULL THEN printf('%5.1f%%', CAST(abs(cents) % 1000 AS DOUBLE) / whole * 100.0::DOUBLE) ELSE '    —' END AS share, CASE WHEN o_orderkey % 2 = 0 THEN 'error' ELSE ' warn' END AS severity FROM a""",
    "w07_series_change": f"""WITH {prices.FACTORS_SQL}, {prices.POINTS_SQL}, p AS (SELECT item, period, cents, CAST(round(cents * factor) AS BIGINT) AS real, CAST(substr(period, 3, 4) AS INTEGER) AS start FROM points JOIN factors USING (period)),
e AS (SELECT item, count(*) AS n, arg_min(period, (start, period)) AS p0, arg_max(period, (start, period)) AS p1, arg_min(cents, (start, period)) AS c0, arg_max(cents, (start, period)) AS c1, arg_min(real, (start, period)) AS r0, arg_max(real, (start, period)) AS r1 FROM p GROUP BY item),
g AS (SELECT item, p0 AS from_period, p1 AS to_period, (CAST(c1 AS DOUBLE) / c0 - 1) * 100 AS nominal_pct, (CAST(r1 AS DOUBLE) / r0 - 1) * 100 AS real_pct FROM e WHERE n > 1 AND c0 <> 0 AND r0 <> 0)
SELECT item, from_period, to_period, round(nominal_pct, 6) AS nominal_pct, round(real_pct, 6) AS real_pct, sign(nominal_pct) <> sign(real_pct) AS reverses_sign FROM g""",
    "j34_related_figures": f"WITH {relations._BACK} SELECT item, count(*) AS related, count(*) FILTER (class <> 'act' AND slug % 4 > 0 AND slug IN (SELECT o_orderkey FROM orders)) AS figures FROM bl GROUP BY item",
    "p35_node_of": f"WITH {relations._BACK} SELECT DISTINCT class, slug, CASE WHEN class <> 'act' AND slug IN (SELECT o_orderkey FROM orders) THEN class || '/' || slug END AS path FROM bl",
}
