"""Printed tables: a brand of parts is a document, forty parts a page; every page is a JSON record, some of them broken."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.operators import documents
from tallyspark.sources import pages as src

from .ledger import table

PER_PAGE = 40
# Both engines read these expressions: agency, fund, code and name; original, final, actual and variance, every sixth of these amiss.
NAME = "concat(p_type, ' GRF ', lpad(CAST(p_partkey % 1000000 AS {}), 6, '0'), ' ', p_name)".format("VARCHAR(20)")
AMOUNTS = ["p_size * 100", "p_size * 100 + 100", "p_size % 7 * 100 + 50", "p_size * 100 + 100 - (p_size % 7 * 100 + 50) + CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 0 END"]
MONEY = "concat(CAST(floor(({0}) / 100) AS INT), '.', lpad(CAST(({0}) % 100 AS VARCHAR(20)), 2, '0'))"


def records(spark, sf_dir):
    """Pages as text; every eleventh is cut off, every seventh without glyphs, every fifth has one row only."""
    rows = table(spark, sf_dir, "part").withColumn("i", F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) - 1)
    rows = rows.withColumn("page", F.expr(f"i div {PER_PAGE} + 1").cast("int")).withColumn("k", F.expr(f"i % {PER_PAGE}")).where("page % 5 <> 0 OR k = 0")
    y = F.expr("760.0D - 12 * k")
    glyph = lambda x, dy, text: F.struct(F.lit(float(x)).alias("x"), (y - dy).alias("y"), (F.length(text) * 6.0).alias("advance"), F.lit(10.0).alias("font_size"), text.alias("text"))
    words = [glyph(50, 0.0, F.expr(NAME)), *[glyph(460 + 60 * n, 0.1 * n, F.expr(MONEY.format(cents))) for n, cents in enumerate(AMOUNTS)]]
    glyphs = F.array(*words)
    page = rows.groupBy(F.col("p_brand").alias("doc"), "page").agg(F.flatten(F.array_sort(F.collect_list(F.when(F.col("page") % 7 != 0, glyphs)))).alias("glyphs"))
    line = F.to_json(F.struct("doc", "page", "glyphs"))
    return page.select(F.when(F.col("page") % 11 == 0, F.concat(F.lit("{"), F.substring(line, 1, 40))).otherwise(line).alias("value"), F.concat(F.lit("/pages/"), "doc", F.lit(".jsonl")).alias("file"))


def pages(spark, sf_dir):
    return src.parse_pages(records(spark, sf_dir))


QUERIES = {
    "s18_page_tables": lambda s, d: src.page_tables(pages(s, d)),
    "s19_budget_tables": lambda s, d: src.budget_tables(src.page_tables(pages(s, d))),
    "s25_page_dump": lambda s, d: src.page_dump(src.page_glyphs(pages(s, d))),
    "w11_rivers": lambda s, d: documents.rivers(src.page_glyphs(pages(s, d))),
}
_WORDS = ", ".join(f"{{'x': {460 + 60 * n}.0, 'y': 760.0 - 12 * k - {0.1 * n}::DOUBLE, 'adv': 6.0 * length({MONEY.format(c)}), 't': {MONEY.format(c)}}}" for n, c in enumerate(AMOUNTS))
# Baselines of a row lie within half a point by construction of the page, which the recursion over tops checks.
WITH = f"""WITH RECURSIVE p AS (SELECT *, CAST(i // {PER_PAGE} + 1 AS INTEGER) AS page, i % {PER_PAGE} AS k FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part)),
kept AS (SELECT p_brand AS doc, * FROM p WHERE page % 5 <> 0 OR k = 0),
g AS (SELECT doc, page, unnest(w, recursive := true) FROM (SELECT doc, page, unnest([{{'x': 50.0::DOUBLE, 'y': (760.0 - 12 * k)::DOUBLE, 'adv': 6.0::DOUBLE * length({NAME}), 't': {NAME}}}, {_WORDS}]) AS w FROM kept WHERE page % 7 <> 0 AND page % 11 <> 0)),
used AS (SELECT DISTINCT doc, page, unnest(range(CAST(floor(x / 0.1) AS BIGINT), CAST(ceil((x + adv) / 0.1) AS BIGINT))) AS bin FROM g),
edge AS (SELECT doc, page, CAST(floor(min(x) / 0.1) AS BIGINT) AS lo, CAST(ceil(max(x + adv) / 0.1) AS BIGINT) AS hi FROM g GROUP BY doc, page),
free AS (SELECT doc, page, bin FROM (SELECT doc, page, unnest(range(lo, hi)) AS bin FROM edge) ANTI JOIN used USING (doc, page, bin)),
river AS (SELECT doc, page, round(min(bin) * 0.1, 6) AS "left", round((max(bin) + 1) * 0.1, 6) AS "right" FROM (SELECT *, bin - row_number() OVER (PARTITION BY doc, page ORDER BY bin) AS island FROM free) GROUP BY doc, page, island HAVING (max(bin) - min(bin) + 1) * 0.1 >= 12.0),
ys AS (SELECT DISTINCT doc, page, y FROM g),
tops AS (SELECT doc, page, max(y) AS top, 0 AS "row" FROM ys GROUP BY doc, page UNION ALL SELECT t.doc, t.page, max(y), any_value(t."row") + 1 FROM tops t JOIN ys ON ys.doc = t.doc AND ys.page = t.page AND t.top - ys.y > 0.5 GROUP BY t.doc, t.page, t.top),
placed AS (SELECT g.*, (SELECT max("row") FROM tops t WHERE t.doc = g.doc AND t.page = g.page AND t.top >= g.y) AS "row", (SELECT count(*) FROM river r WHERE r.doc = g.doc AND r.page = g.page AND (r."left" + r."right") / 2 <= g.x + g.adv / 2) AS col FROM g),
pieces AS (SELECT *, CASE WHEN x - lag(x + adv) OVER (PARTITION BY doc, page, "row", col ORDER BY x) > 2.5 THEN ' ' || t ELSE t END AS piece FROM placed),
cell AS (SELECT doc, page, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, string_agg(piece, '' ORDER BY x) AS text FROM pieces GROUP BY doc, page, "row", col),
height AS (SELECT doc, page, max("row") + 1 AS n FROM cell GROUP BY doc, page),
tbl AS (SELECT cell.*, CAST(NULL AS VARCHAR) AS error FROM cell JOIN height USING (doc, page) WHERE n > 1
  UNION ALL SELECT doc, page, NULL, NULL, NULL, 'too_few_rows' FROM height WHERE n < 2
  UNION ALL SELECT DISTINCT doc, CASE WHEN page % 11 <> 0 THEN page END, CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR), CASE WHEN page % 11 = 0 THEN 'unreadable' ELSE 'no_glyphs' END FROM (SELECT DISTINCT doc, page FROM kept) WHERE page % 11 = 0 OR page % 7 = 0)"""
ORACLES = {
    "s18_page_tables": f"{WITH} SELECT * FROM tbl",
    "w11_rivers": f'{WITH} SELECT doc, page, "left", "right" FROM river',
    "s25_page_dump": f"""{WITH}, l AS (SELECT doc, page, "row", string_agg(t, ' ' ORDER BY x, t) AS line FROM placed GROUP BY doc, page, "row") SELECT doc, page, string_agg(line, chr(10) ORDER BY "row") AS dump FROM l GROUP BY doc, page""",
    "s19_budget_tables": f"""{WITH}, r AS (SELECT doc, page, "row", list(text ORDER BY col) AS c FROM tbl WHERE error IS NULL GROUP BY doc, page, "row"),
m AS (SELECT *, CASE WHEN len(c) >= 4 THEN list_transform(c[len(c) - 3:], lambda x: CASE WHEN regexp_full_match(x, '[0-9]+[.][0-9][0-9]') THEN CAST(replace(x, '.', '') AS BIGINT) END) END AS money, list_filter(string_split(array_to_string(c[:greatest(len(c) - 4, 0)], ' '), ' '), lambda t: t <> '') AS tokens FROM r),
k AS (SELECT *, len(money) = 4 AND len(list_filter(money, lambda x: x IS NULL)) = 0 AS known, list_position(list_transform(tokens, lambda t: regexp_full_match(t, '[A-Za-z0-9]{{6}}') AND regexp_matches(t, '[0-9]')), true) AS pos FROM m),
o AS (SELECT *, CASE WHEN known IS NOT TRUE THEN 'skipped' WHEN money[4] <> money[2] - money[3] THEN 'problem' WHEN coalesce(pos, 0) < 2 THEN 'skipped' ELSE 'row' END AS outcome FROM k)
SELECT doc, page, "row", outcome, CASE WHEN outcome = 'row' THEN array_to_string(tokens[:pos - 2], ' ') END AS agency, CASE WHEN outcome = 'row' THEN tokens[pos - 1] END AS fund, CASE WHEN outcome = 'row' THEN tokens[pos] END AS code,
  CASE WHEN outcome = 'row' THEN array_to_string(tokens[pos + 1:], ' ') END AS name, CASE WHEN outcome = 'row' THEN money[1] END AS original_cents, CASE WHEN outcome = 'row' THEN money[2] END AS final_cents, CASE WHEN outcome = 'row' THEN money[3] END AS actual_cents,
  CASE WHEN outcome = 'row' THEN money[2] - money[3] END AS unspent_cents FROM o""",
}
