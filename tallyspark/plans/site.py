"""Feed views and label functions over the driver's tables and texts written from their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import numbers, text
from tallyspark.operators import feed, lineage, stages
from tallyspark.operators.deflate import period_kind

from . import fixtures as fx
from . import graphs, movement, prices
from .ledger import GAP_SQL, gaps, start_year, table

#: Amounts of every size and sign; the last digit keeps them off the halves that the two engines round apart.
CENTS = "CASE o_orderkey % 7 WHEN 0 THEN 3 * (o_custkey % 30) WHEN 1 THEN -(o_custkey * 10 + 3) WHEN 2 THEN o_custkey * 1000 + 7 WHEN 3 THEN -(o_custkey * 100000 + 13) WHEN 4 THEN o_custkey * 10000000 + 33 WHEN 5 THEN o_custkey * 1000000000 + 57 END"
PERIODS = fx.Drawn("periods", "id int, period string", list(enumerate(["FY2#", "FY2#-25", "FYFY2#", "1#", "FY", "Biennium", "FY2# est", "FY2#-b"])))
LABELS = fx.Drawn("labels_", "id int, label string", list(enumerate(["As Introduced", "introduced", "House  Passed", "Conference", "Executive", "As Passed by House", "final", "Governor Recommended", "As Enacted after Governor's Vetoes", "Draft #", "conference-#"])))
PAIRS = fx.Drawn("pairs", "id int, a string, b string", [(i, *t) for i, t in enumerate([("Shared Fund # of Parks", "Shared Fund #"), ("Aid to aid #", "AID"), ("of it", "aid"), ("School Safety Grants #", "# Grants for Safety"), ("River Fund # Upkeep", "River fund # upkeep - All"), ("  Lake Fund #", "Lake Fund # and more")])])


def f09(spark, sf_dir):
    rows = LABELS.frame(spark, sf_dir).withColumn("plain", text.normalised(F.col("label")))
    sheet, paper = text.spelling_table(spark, text.STAGE_SPELLINGS, "plain", "sheet_stage"), text.spelling_table(spark, text.DOCUMENT_SPELLINGS, "plain", "document_stage")
    return rows.join(sheet, "plain", "left").join(paper, "plain", "left").select("id", "label", "sheet_stage", "document_stage")


def u04(spark, sf_dir):
    a, b = text.title_tokens(F.col("a")), text.title_tokens(F.col("b"))
    return PAIRS.frame(spark, sf_dir).select("id", "a", "b", F.round(text.title_overlap(a, b), 9).alias("overlap"), lineage.is_namesake(F.col("a"), F.col("b")).alias("namesake"))


def c20(spark, sf_dir):
    return feed.real_categories(movement.a13(spark, sf_dir), prices.factors(spark, sf_dir), movement.CATEGORIES)


def views(spark, sf_dir):
    return feed.node_views(graphs.NODES.frame(spark, sf_dir), graphs.LINKS.frame(spark, sf_dir), graphs.PROPS.frame(spark, sf_dir))


def o09(spark, sf_dir):
    """Customers as subjects: gaps of their items, their stage series, their orders as related nodes."""
    own = gaps(spark, sf_dir).withColumn("item", F.substring_index("item", "/", 1))
    series = stages.series(movement.points(spark, sf_dir), movement.STAGES).withColumn("item", F.col("item").cast("string"))
    related = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("item")).agg(F.count("*").alias("n_related"))
    return feed.top(feed.subjects(own, series, related), 8, F.desc("figures"), F.desc("n_related"), F.asc("item"))


QUERIES = {
    "f04_money_formats": lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(CENTS).alias("cents")).select("id", numbers.format_money(F.col("cents")).alias("plain"), numbers.compact(F.col("cents")).alias("compact")),
    "f09_stage_labels": f09,
    "f13_period_start": lambda s, d: PERIODS.frame(s, d).select("id", "period", start_year().alias("start"), period_kind(F.col("period")).alias("kind")),
    "u04_token_overlap": u04,
    "c20_local_finance": c20,
    "c30_node_views": views,
    "a20_class_counts": lambda s, d: feed.class_counts(views(s, d), graphs.CLASSES.frame(s, d)),
    "o09_subjects_top8": o09,
}

_STAGES = ", ".join(f"('{x}', '{n}')" for n, xs in text.STAGE_SPELLINGS.items() for x in xs)
_PAPER = ", ".join(f"('{x}', '{n}')" for n, xs in text.DOCUMENT_SPELLINGS.items() for x in xs)
_VIEWS = f"""{graphs.NODES.sql()}, {graphs.LINKS.sql()}, {graphs.PROPS.sql()}, {graphs.CLASSES.sql()}, views AS (SELECT path, class, regexp_extract(path, '([^/]+?)(\\.yml|\\.md)?$', 1) AS slug,
  concat_ws(',', CASE WHEN contains(b, '[verified]') THEN 'verified' END, CASE WHEN contains(b, '[inference]') THEN 'inference' END, CASE WHEN contains(b, '[open]') THEN 'open' END) AS claims, label LIKE '?%' AS is_question,
  (SELECT count(*) FROM links l WHERE l.path = n.path AND relationship <> 'instance-of') AS n_links, (SELECT count(*) FROM props p WHERE p.path = n.path AND key = 'amount' AND text LIKE '$%') AS n_figures,
  (SELECT CAST(sum(CAST(replace(text, '$', '') AS DOUBLE) * 100) AS BIGINT) FROM props p WHERE p.path = n.path AND key = 'amount' AND text LIKE '$%') AS figure_cents FROM (SELECT *, concat_ws(' ', label, description) AS b FROM nodes) n)"""
_REAL = ", ".join(f"CASE WHEN ok THEN CAST(round({c} * factor) AS BIGINT) END AS real_{c}" for c in movement.CATEGORIES)
_ALL = " AND ".join(f"{c} IS NOT NULL" for c in movement.CATEGORIES)
ORACLES = {
    "f04_money_formats": f"""WITH amounts AS (SELECT o_orderkey AS id, {CENTS} AS cents FROM orders) SELECT id, CASE WHEN cents < 0 THEN '-' WHEN cents IS NOT NULL THEN '' END || '$' || (abs(cents) // 100) || '.' || lpad(CAST(abs(cents) % 100 AS VARCHAR), 2, '0') AS plain,
  CASE WHEN cents < 0 THEN '−' WHEN cents IS NOT NULL THEN '' END || '$' || CASE WHEN abs(cents) >= 100000000000 THEN printf('%.2fB', abs(cents) / 100000000000.0::DOUBLE) WHEN abs(cents) >= 100000000 THEN printf('%.1fM', abs(cents) / 100000000.0::DOUBLE) WHEN abs(cents) >= 100000 THEN printf('%.0fK', abs(cents) / 100000.0::DOUBLE) ELSE printf('%.0f', abs(cents) / 100.0::DOUBLE) END AS compact FROM amounts""",
    "f09_stage_labels": f"""WITH {LABELS.sql()}, n AS (SELECT label, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS p, id FROM labels_), s(p, sheet_stage) AS (VALUES {_STAGES}), d(p, document_stage) AS (VALUES {_PAPER})
SELECT id, label, sheet_stage, document_stage FROM n LEFT JOIN s ON n.p = s.p LEFT JOIN d ON n.p = d.p""",
    "f13_period_start": f"WITH {PERIODS.sql()} SELECT id, period, coalesce(TRY_CAST(nullif(regexp_extract(period, '^(?:FY)*([0-9]+)(?:[- ].*)?$', 1), '') AS INTEGER), 2147483647) AS start, CASE WHEN regexp_matches(period, '^[^-]*-[0-9]+$') THEN 'biennial' ELSE 'annual' END AS kind FROM periods",
    "u04_token_overlap": f"""WITH {PAIRS.sql()}, t AS (SELECT id, a, b, list_filter(regexp_split_to_array(lower(a), '[^a-z0-9]+'), lambda x: strlen(x) > 2) AS ta, list_filter(regexp_split_to_array(lower(b), '[^a-z0-9]+'), lambda x: strlen(x) > 2) AS tb,
  CASE WHEN strlen(trim(a)) <= strlen(trim(b)) THEN lower(trim(a)) ELSE lower(trim(b)) END AS short, CASE WHEN strlen(trim(a)) <= strlen(trim(b)) THEN lower(trim(b)) ELSE lower(trim(a)) END AS long FROM pairs),
o AS (SELECT *, len(list_filter(ta, lambda x: list_contains(tb, x))) AS shared FROM t)
SELECT id, a, b, CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0::DOUBLE ELSE round(CAST(shared AS DOUBLE) / (len(ta) + len(tb) - shared), 9) END AS overlap, strlen(short) >= 12 AND len(regexp_split_to_array(short, '\\s+')) >= 2 AND starts_with(long, short) AS namesake FROM o""",
    "c20_local_finance": f"""WITH {prices.FACTORS_SQL}, totals AS ({movement.ORACLES['a13_category_totals']}), t AS (SELECT totals.*, factor, factor IS NOT NULL AND {_ALL} AS ok FROM totals LEFT JOIN factors ON period = 'FY' || year)
SELECT measure, year, {_REAL}, ok AS is_restated FROM t""",
    "c30_node_views": f"WITH {_VIEWS} SELECT * FROM views",
    "a20_class_counts": f"WITH {_VIEWS} SELECT c.class, count(v.path) AS nodes, count(v.path) FILTER (contains(claims, 'verified')) AS verified, count(v.path) FILTER (contains(claims, 'open')) AS open FROM classes c LEFT JOIN views v ON v.class = c.class GROUP BY c.class",
    "o09_subjects_top8": f"""WITH {GAP_SQL}, {movement.POINTS}, g AS (SELECT split_part(item, '/', 1) AS item, count(*) AS n_gaps FROM gap WHERE status = 'computed' GROUP BY 1), sr AS (SELECT CAST(item AS VARCHAR) AS item, count(DISTINCT period) AS n_series FROM steps GROUP BY 1),
r AS (SELECT CAST(o_custkey AS VARCHAR) AS item, count(*) AS n_related FROM orders GROUP BY 1), allsub AS (SELECT item, coalesce(n_gaps, 0) AS n_gaps, coalesce(n_series, 0) AS n_series, coalesce(n_related, 0) AS n_related FROM g FULL JOIN sr USING (item) FULL JOIN r USING (item))
SELECT *, n_gaps + n_series AS figures FROM allsub WHERE n_gaps > 0 OR n_series > 0 OR n_related >= 4 ORDER BY figures DESC, n_related DESC, item LIMIT 8""",
}
