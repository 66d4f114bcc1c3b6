"""Comparison documents printed from the driver's tables.

A document is a supplier, its lines the order lines in order, forty a page; quantity and part decide what a line
is: heading, citation, section, the first line of an entry, or text that goes on. The same rows, drawn as glyphs and rules, feed the
geometry queries.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.operators import comparison as ops

from .ledger import table

ORDER = "l_orderkey, l_linenumber, l_partkey, l_extendedprice"
LINES_PER_PAGE = 40

# Both engines read these expressions: columns of lineitem, k (place on the page), q (whole quantity) and r (what the line is).
TITLE = "CASE q % 4 WHEN 0 THEN concat(' Title ', q) WHEN 1 THEN 'Title' WHEN 2 THEN ' **VETOED** Title' ELSE concat(' **PARTIALLY VETOED**Title ', q) END"
FIRST = f"""CASE WHEN k = 1 THEN concat('Budget comparison page ', page) WHEN k = 2 THEN 'Executive' WHEN q = 50 THEN ' ' WHEN r = 0 THEN concat('PRV', l_partkey % 900 + 1, {TITLE}) WHEN r = 1 THEN concat('Section ', l_partkey % 7)
  WHEN r = 2 THEN concat('R.C. ', q) ELSE concat('w', l_partkey, CASE WHEN q % 5 = 0 THEN '-' ELSE '' END) END"""
SECOND = """CASE WHEN k = 1 THEN '' WHEN k = 2 THEN 'As Passed  by House' WHEN q = 50 OR r < 2 THEN '' WHEN r = 2 THEN concat('R.C. ', l_partkey) WHEN q % 3 = 0 THEN ''
  WHEN q % 3 = 1 THEN 'Same as the Executive.' ELSE concat('x [***VETOED: struck  ', q, CASE WHEN q % 2 = 0 THEN ' ***] y' ELSE '' END) END"""
THIRD = "CASE WHEN k = 1 THEN '' WHEN k = 2 THEN (CASE WHEN doc % 5 = 0 THEN 'Fiscal effect' ELSE 'Enacted' END) WHEN q = 50 OR r < 3 THEN '' WHEN l_partkey % 2 = 0 THEN '(1) Same as the House' ELSE concat('set to ', q) END"
STARTS = "k > 2 AND (r = 3 OR r = 4)"
SIZE = "CASE WHEN k > 2 AND r < 3 THEN 9.0D ELSE 10.5D END"


def _printed(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("*", F.col("l_suppkey").alias("doc"))
    place = F.row_number().over(W.partitionBy("doc").orderBy(*ORDER.split(", "))) - 1
    return rows.withColumn("at", place).withColumns({"page": F.expr(f"at div {LINES_PER_PAGE} + 1").cast("int"), "k": F.expr(f"at % {LINES_PER_PAGE} + 1"), "q": F.expr("CAST(l_quantity AS INT)"), "r": F.expr("(l_partkey * 7 + l_linenumber) % 11")})


def lines(spark, sf_dir):
    rows = _printed(spark, sf_dir).select("doc", "page", F.col("k").alias("line_no"), F.expr("760.0D - 12 * k").alias("y"), F.array(*map(F.expr, (FIRST, SECOND, THIRD))).alias("cells"), F.expr(STARTS).alias("starts_entry"), F.expr(SIZE).alias("font_size"))
    return rows.withColumn("text", F.array_join("cells", ""))


def assembled(spark, sf_dir):
    own = lines(spark, sf_dir)
    marked, columns = ops.roles(own), ops.document_columns(own)
    return ops.provisions(marked), ops.positions(marked, columns), columns


def rows(spark, sf_dir):
    return ops.provision_rows(*assembled(spark, sf_dir)).withColumn("vetoed_spans", F.array_join("vetoed_spans", "|"))


def headed(spark, sf_dir):
    return ops.provisions(ops.roles(lines(spark, sf_dir))).withColumn("citations", F.array_join("citations", "|"))


def covered(spark, sf_dir):
    return ops.coverage(*assembled(spark, sf_dir)).withColumn("unmapped", F.array_join("unmapped", "|"))


def changed(spark, sf_dir):
    """Entries that a later stage changes, by provision."""
    return rows(spark, sf_dir).where("changed").groupBy("doc", "code").agg(F.count_distinct("entry_index").alias("entries"), F.count_if(~F.col("concurs")).alias("statements"))


def enacted(spark, sf_dir):
    """What the last stage says on one provision; null in documents without that column."""
    own, found, columns = assembled(spark, sf_dir)
    return ops.position_of(found, own, columns, "PRV1", "as-enacted")


def glyphs(spark, sf_dir):
    """Words, cell by cell, with their baselines slightly off; rules under the lines that begin an entry, except on every third page; a stroke among the words of each head."""
    at = lambda x, text, dy="0.0D": F.struct(F.lit(float(x)).alias("x"), F.expr(f"y - {dy}").alias("y"), (F.length(F.expr(text)) * 6.0).alias("advance"), F.expr(SIZE).alias("font_size"), F.expr(text).alias("text"))
    words = F.array(
        at(50, "concat('a', l_partkey)"), F.struct(F.expr("50 + 6 * length(concat('a', l_partkey)) + CASE WHEN q % 2 = 0 THEN 1.0D ELSE 5.0D END").alias("x"), F.expr("y - 0.5D").alias("y"), F.lit(6.0).alias("advance"), F.expr(SIZE).alias("font_size"), F.lit("b").alias("text")),
        at(210, "CASE WHEN q % 3 = 0 THEN '' ELSE concat('c', q, ' ') END", "0.5D * (q % 3)"), at(410, "CASE WHEN r < 2 THEN '' ELSE concat('d', r) END"), at(202, "CASE WHEN k = 1 THEN '|' ELSE '' END"),
        F.struct(F.expr("200 + 0.3D * (q % 2)").alias("x"), F.expr("y - 6").alias("y"), F.lit(2.0).alias("advance"), F.lit(10.5).alias("font_size"), F.expr(f"CASE WHEN {STARTS} AND page % 3 <> 0 THEN '|' ELSE '' END").alias("text")),
        F.struct(F.expr("400 + 0.4D * (q % 3)").alias("x"), F.expr("y - 6.2D").alias("y"), F.lit(2.0).alias("advance"), F.lit(10.5).alias("font_size"), F.expr(f"CASE WHEN {STARTS} AND page % 3 <> 0 THEN '|' ELSE '' END").alias("text")),
    )
    rows = _printed(spark, sf_dir).withColumn("y", F.expr("760.0D - 12 * k"))
    return rows.select("doc", "page", F.explode(words).alias("g")).select("doc", "page", "g.*").where("text <> ''")


def ruled(spark, sf_dir):
    return ops.ruled_lines(glyphs(spark, sf_dir)).withColumn("cells", F.array_join("cells", "|"))


def pages(spark, sf_dir):
    """Every page and how it was read."""
    return ops.ruled_pages(glyphs(spark, sf_dir)).select("doc", "page", "status", "reason", F.size(F.coalesce("rules", F.array().cast("array<double>"))).alias("rules"), F.size("drawn").alias("drawn"))


def entries(spark, sf_dir):
    return ops.page_entries(lines(spark, sf_dir)).withColumn("cells", F.array_join("cells", "|"))


QUERIES = {"c25_provision_rows": rows, "c25_provisions": headed, "c25_coverage": covered, "p24_changed": changed, "p32_position": enacted, "c26_ruled_lines": ruled, "c26_ruled_pages": pages, "w17_page_entries": entries}

_sql = lambda x: x.replace("D)", ")").replace("0D", "0").replace("5D", "5").replace("3D", "3").replace("4D", "4").replace("2D", "2")
PRINTED = f"""printed AS (SELECT *, (l_partkey * 7 + l_linenumber) % 11 AS r, CAST(floor(l_quantity) AS INTEGER) AS q, 760.0 - 12 * k AS y
  FROM (SELECT *, CAST(i // {LINES_PER_PAGE} + 1 AS INTEGER) AS page, CAST(i % {LINES_PER_PAGE} + 1 AS INTEGER) AS k FROM (SELECT *, l_suppkey AS doc, row_number() OVER (PARTITION BY l_suppkey ORDER BY {ORDER}) - 1 AS i FROM lineitem)))"""
# Glyphs, row tops as a recursion from one top to the next, rules as clusters of what is drawn, lines as what stands between them.
PAGES = f"""{PRINTED},
size AS (SELECT *, CAST({_sql(SIZE)} AS DOUBLE) AS fs FROM printed),
g AS (SELECT doc, page, unnest(w, recursive := true) FROM (SELECT doc, page, unnest([
    {{'x': 50.0::DOUBLE, 'y': y::DOUBLE, 'adv': 6.0 * length('a' || l_partkey), 'fs': fs, 't': 'a' || l_partkey}},
    {{'x': 50 + 6 * length('a' || l_partkey) + CASE WHEN q % 2 = 0 THEN 1.0 ELSE 5.0 END, 'y': y - 0.5, 'adv': 6.0, 'fs': fs, 't': 'b'}},
    {{'x': 210.0, 'y': y - 0.5 * (q % 3), 'adv': 6.0 * length('c' || q || ' '), 'fs': fs, 't': CASE WHEN q % 3 = 0 THEN '' ELSE 'c' || q || ' ' END}},
    {{'x': 410.0, 'y': y, 'adv': 6.0 * length('d' || r), 'fs': fs, 't': CASE WHEN r < 2 THEN '' ELSE 'd' || r END}},
    {{'x': 202.0, 'y': y, 'adv': 6.0, 'fs': fs, 't': CASE WHEN k = 1 THEN '|' ELSE '' END}},
    {{'x': 200 + 0.3 * (q % 2), 'y': y - 6, 'adv': 2.0, 'fs': 10.5, 't': CASE WHEN {STARTS} AND page % 3 <> 0 THEN '|' ELSE '' END}},
    {{'x': 400 + 0.4 * (q % 3), 'y': y - 6.2, 'adv': 2.0, 'fs': 10.5, 't': CASE WHEN {STARTS} AND page % 3 <> 0 THEN '|' ELSE '' END}}]) AS w FROM size) WHERE w.t <> ''),
pg AS (SELECT doc, page, list_sort(list(fs))[count(*) // 2 + 1] AS size, 0.4 * list_sort(list(fs))[count(*) // 2 + 1] AS tol, count(*) FILTER (t <> '|') AS words FROM g GROUP BY doc, page),
ys AS (SELECT DISTINCT doc, page, t = '|' AS rule, y, tol FROM g JOIN pg USING (doc, page)),
tops AS (SELECT doc, page, rule, max(y) AS top FROM ys GROUP BY doc, page, rule UNION ALL SELECT t.doc, t.page, t.rule, max(y) FROM tops t JOIN ys ON ys.doc = t.doc AND ys.page = t.page AND ys.rule = t.rule AND t.top - y > tol GROUP BY t.doc, t.page, t.rule, t.top),
drawn AS (SELECT doc, page, top FROM tops t WHERE rule AND NOT EXISTS (SELECT 1 FROM ys WHERE ys.doc = t.doc AND ys.page = t.page AND NOT ys.rule AND abs(ys.y - t.top) <= tol)),
topped AS (SELECT g.*, (SELECT min(top) FROM tops t WHERE t.doc = g.doc AND t.page = g.page AND t.rule = (g.t = '|') AND t.top >= g.y) AS top FROM g),
kept AS (SELECT doc, page, x FROM topped JOIN drawn USING (doc, page, top) WHERE t = '|'),
steps AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY doc, page ORDER BY x) <= 1.0 THEN 0 ELSE 1 END AS fresh FROM kept),
rule AS (SELECT doc, page, avg(x) AS x FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc, page ORDER BY x) AS c FROM steps) GROUP BY doc, page, c),
own AS (SELECT doc, page, list(x ORDER BY x) AS rules FROM rule GROUP BY doc, page),
st AS (SELECT pg.doc, pg.page, size, own.rules IS NOT NULL AS own, last_value(own.rules IGNORE NULLS) OVER (PARTITION BY pg.doc ORDER BY pg.page) AS rules FROM pg LEFT JOIN own ON own.doc = pg.doc AND own.page = pg.page)"""
# A fold over the lines of each document: one row of state a line.
FOLD = f"""{PRINTED},
line AS (SELECT doc, page, k, y, [{FIRST}, {SECOND}, {THIRD}] AS cells, {STARTS} AS starts, {_sql(SIZE)} AS size FROM printed),
filled AS (SELECT *, array_to_string(cells, '') AS text, replace(regexp_replace(lower(array_to_string(cells, chr(1))), '[0-9]', '#', 'g'), ' ', '') AS key FROM line WHERE trim(array_to_string(cells, '')) <> ''),
furniture AS (SELECT f.doc, round(y) AS y, key FROM filled f JOIN (SELECT doc, count(DISTINCT page) AS pages FROM line GROUP BY doc) p ON p.doc = f.doc GROUP BY f.doc, round(f.y), key, pages HAVING count(DISTINCT page) >= greatest(pages // 2, 2)),
body AS (SELECT doc, first(size ORDER BY n DESC, size) AS body FROM (SELECT doc, size, count(*) AS n FROM filled GROUP BY doc, size) GROUP BY doc),
c AS (SELECT f.*, row_number() OVER (PARTITION BY f.doc ORDER BY page, k) AS i, size < body - 0.5 AS small, size < body - 0.5 AND regexp_matches(trim(text), '^[A-Z]{{3,8}}[0-9]{{1,4}}([^0-9]|$)') AS heads,
        len(list_filter(cells, lambda x: trim(x) <> '')) AS n_filled
      FROM filled f JOIN body ON body.doc = f.doc WHERE NOT EXISTS (SELECT 1 FROM furniture u WHERE u.doc = f.doc AND u.y = round(f.y) AND u.key = f.key)),
st AS (SELECT doc, CAST(0 AS BIGINT) AS i, '' AS kind, 0 AS provision, false AS open, false AS cited, CAST(NULL AS VARCHAR) AS section, 0 AS entry, CAST(NULL AS INTEGER) AS entry_of FROM c GROUP BY doc
  UNION ALL SELECT doc, i, kind, provision + CAST(kind = 'heading' AS INTEGER), CASE kind WHEN 'heading' THEN true WHEN 'section' THEN false ELSE open END, CASE WHEN kind = 'heading' THEN true WHEN small THEN cited ELSE false END,
    CASE WHEN kind = 'section' THEN trim(text) ELSE section END, entry + CAST(kind = 'entry' AS INTEGER), CASE WHEN kind = 'entry' THEN provision ELSE entry_of END
  FROM (SELECT s.* EXCLUDE (i, kind), c.i, c.small, c.text, CASE WHEN c.heads THEN 'heading' WHEN c.small AND s.cited THEN 'citation' WHEN c.small AND c.n_filled = 1 THEN 'section' WHEN c.small OR NOT s.open THEN 'none'
    WHEN c.starts THEN 'entry' WHEN s.entry_of IS NOT NULL AND s.provision - s.entry_of <= 1 THEN 'text' ELSE 'none' END AS kind FROM st s JOIN c ON c.doc = s.doc AND c.i = s.i + 1)),
m AS (SELECT c.*, st.kind, st.provision, st.section, st.entry, st.entry_of FROM c JOIN st ON st.doc = c.doc AND st.i = c.i),
title AS (SELECT doc, provision, page, section, regexp_extract(trim(text), '^[A-Z]+[0-9]+') AS code, trim(regexp_replace(trim(text), '^[A-Z]+[0-9]+', '')) AS t FROM m WHERE kind = 'heading'),
pro AS (SELECT doc, provision, code, section, page, CASE WHEN t LIKE '**PARTIALLY VETOED**%' THEN 'partially_vetoed' WHEN t LIKE '**VETOED**%' THEN 'vetoed' ELSE 'not_vetoed' END AS veto_status,
        trim(replace(replace(t, '**PARTIALLY VETOED**', ''), '**VETOED**', '')) AS title FROM title),
head AS (SELECT doc, doc % 5 <> 0 AS third FROM line WHERE k = 2 GROUP BY doc),
part AS (SELECT doc, entry_of AS provision, entry, page, k, j, trim(cells[j]) AS x FROM m, (SELECT unnest([1, 2, 3]) AS j) WHERE kind IN ('entry', 'text')),
glue AS (SELECT *, lag(x) OVER (PARTITION BY doc, entry, j ORDER BY page, k) AS prior FROM part WHERE x <> ''),
cell AS (SELECT doc, provision, entry, j, string_agg(CASE WHEN prior IS NULL OR prior LIKE '%-' THEN x ELSE ' ' || x END, '' ORDER BY page, k) AS cell FROM glue GROUP BY doc, provision, entry, j),
ent AS (SELECT doc, provision, entry, row_number() OVER (PARTITION BY doc, provision ORDER BY entry) - 1 AS entry_index FROM (SELECT DISTINCT doc, provision, entry FROM part) WHERE doc IN (SELECT doc FROM head)),
con AS (SELECT *, regexp_matches(lower(trim(regexp_replace(cell, '\\s+', ' ', 'g'))), '^(\\([0-9]+\\) )?same as the (executive|executive proposal|house|senate|conference report)\\.*$') AS same FROM cell),
chg AS (SELECT doc, entry, bool_or(NOT same) AS changed FROM con WHERE j > 1 GROUP BY doc, entry)"""
WITH = f"WITH RECURSIVE {FOLD}"
ROWS = f"""rws AS (SELECT e.doc, p.code, p.title, p.section, CAST(e.entry_index AS INTEGER) AS entry_index, CASE j WHEN 1 THEN 'as-introduced' WHEN 2 THEN 'as-passed-house' ELSE 'as-enacted' END AS stage,
  trim(regexp_replace(regexp_replace(cell, '\\[\\*\\*\\*VETOED:\\s*(.*?)\\s*(\\*\\*\\*\\]|$)', '\\1', 'g'), '\\s+', ' ', 'g')) AS position, same AS concurs,
  array_to_string(regexp_extract_all(cell, '\\[\\*\\*\\*VETOED:\\s*(.*?)\\s*(\\*\\*\\*\\]|$)', 1), '|') AS vetoed_spans,
  len(regexp_extract_all(cell, '\\[\\*\\*\\*VETOED:')) > 0 AND strpos(array_to_string(string_split(cell, '[***VETOED:')[-1:], ''), '***]') = 0 AS veto_extent_uncertain,
  CASE veto_status WHEN 'vetoed' THEN 'vetoed' WHEN 'partially_vetoed' THEN 'partially-vetoed' END AS provision_veto, 'page ' || p.page AS locator, coalesce(changed, false) AS changed
  FROM ent e JOIN con c ON c.doc = e.doc AND c.entry = e.entry JOIN pro p ON p.doc = e.doc AND p.provision = e.provision JOIN head h ON h.doc = e.doc LEFT JOIN chg g ON g.doc = e.doc AND g.entry = e.entry WHERE j < 3 OR third)"""
ORACLES = {
    "c25_provision_rows": f"{WITH}, {ROWS} SELECT * FROM rws",
    "c25_provisions": f"""{WITH} SELECT p.doc, p.provision, code, title, veto_status, section, p.page, coalesce(citations, '') AS citations FROM pro p
LEFT JOIN (SELECT doc, provision, string_agg(trim(text), '|' ORDER BY page, k) AS citations FROM m WHERE kind = 'citation' GROUP BY doc, provision) c ON c.doc = p.doc AND c.provision = p.provision""",
    "c25_coverage": f"""{WITH}, per AS (SELECT e.doc, count(*) AS entries, count(*) FILTER (coalesce(changed, false)) AS changed FROM ent e LEFT JOIN chg g ON g.doc = e.doc AND g.entry = e.entry GROUP BY e.doc),
fil AS (SELECT c.doc, count(*) AS filled FROM con c JOIN head h ON h.doc = c.doc WHERE j < 3 OR third GROUP BY c.doc)
SELECT p.doc, count(*) AS provisions, coalesce(any_value(entries), 0) AS entries, coalesce(any_value(changed), 0) AS changed, coalesce(any_value(filled), 0) AS filled, coalesce(any_value(entries) * CASE WHEN any_value(third) THEN 3 ELSE 2 END - any_value(filled), 0) AS empty,
  CASE WHEN any_value(third) THEN '' ELSE 'Fiscal effect' END AS unmapped FROM pro p JOIN head h ON h.doc = p.doc LEFT JOIN per ON per.doc = p.doc LEFT JOIN fil ON fil.doc = p.doc GROUP BY p.doc""",
    "p24_changed": f"{WITH}, {ROWS} SELECT doc, code, count(DISTINCT entry_index) AS entries, count(*) FILTER (NOT concurs) AS statements FROM rws WHERE changed GROUP BY doc, code",
    "p32_position": f"{WITH} SELECT e.doc, p.code, CAST(e.entry_index AS INTEGER) AS entry_index, CASE WHEN third THEN coalesce(cell, '') END AS position FROM ent e JOIN pro p ON p.doc = e.doc AND p.provision = e.provision JOIN head h ON h.doc = e.doc LEFT JOIN con c ON c.doc = e.doc AND c.entry = e.entry AND c.j = 3 WHERE p.code = 'PRV1'",
    "c26_ruled_pages": f"""WITH RECURSIVE {PAGES} SELECT doc, page, CASE WHEN own THEN 'ruled' WHEN rules IS NULL THEN 'refused' ELSE 'continued' END AS status, CASE WHEN rules IS NULL THEN 'no_rules' END AS reason,
  CAST(coalesce(len(rules), 0) AS INTEGER) AS rules, CAST(CASE WHEN own THEN (SELECT count(*) FROM drawn d WHERE d.doc = st.doc AND d.page = st.page) ELSE 0 END AS INTEGER) AS drawn FROM st""",
    "c26_ruled_lines": f"""WITH RECURSIVE {PAGES},
words AS (SELECT w.*, rules, len(list_filter(rules, lambda r: r <= x + adv / 2)) AS col, 0.25 * size AS gap, own FROM topped w JOIN st ON st.doc = w.doc AND st.page = w.page WHERE rules IS NOT NULL AND t <> '|'),
pieces AS (SELECT *, CASE WHEN x - lag(x + adv) OVER c > gap AND lag(t) OVER c NOT LIKE '% ' THEN ' ' || t ELSE t END AS in_cell, CASE WHEN x - lag(x + adv) OVER l > gap AND lag(t) OVER l NOT LIKE '% ' THEN ' ' || t ELSE t END AS in_line
  FROM words WINDOW c AS (PARTITION BY doc, page, top, col ORDER BY x), l AS (PARTITION BY doc, page, top ORDER BY x)),
cell AS (SELECT doc, page, top, col, trim(string_agg(in_cell, '' ORDER BY x)) AS cell FROM pieces GROUP BY doc, page, top, col),
ln AS (SELECT doc, page, top, any_value(rules) AS rules, any_value(own) AS own, list_sort(list(fs))[count(*) // 2 + 1] AS font_size, trim(string_agg(in_line, '' ORDER BY x)) AS text FROM pieces GROUP BY doc, page, top),
slot AS (SELECT doc, page, top, unnest(range(0, len(rules) + 1)) AS col FROM ln),
full_cells AS (SELECT s.doc, s.page, s.top, string_agg(coalesce(cell, ''), '|' ORDER BY s.col) AS cells FROM slot s LEFT JOIN cell c ON c.doc = s.doc AND c.page = s.page AND c.top = s.top AND c.col = s.col GROUP BY s.doc, s.page, s.top),
started AS (SELECT DISTINCT d.doc, d.page, (SELECT min(t.top) FROM tops t WHERE NOT t.rule AND t.doc = d.doc AND t.page = d.page AND t.top > d.top) AS top FROM drawn d)
SELECT ln.doc, ln.page, CAST(row_number() OVER (PARTITION BY ln.doc, ln.page ORDER BY ln.top DESC) - 1 AS INTEGER) AS line_no, ln.top AS y, cells, s.top IS NOT NULL AND own AS starts_entry, font_size, text
FROM ln JOIN full_cells f ON f.doc = ln.doc AND f.page = ln.page AND f.top = ln.top LEFT JOIN started s ON s.doc = ln.doc AND s.page = ln.page AND s.top = ln.top""",
    "w17_page_entries": f"""WITH {PRINTED},
line AS (SELECT doc, page, k, y, [{FIRST}, {SECOND}, {THIRD}] AS cells, {STARTS} AS starts FROM printed),
n AS (SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY doc, page ORDER BY k) AS entry FROM line),
tall AS (SELECT doc, page, entry, max(y) AS y FROM n GROUP BY doc, page, entry),
part AS (SELECT doc, page, entry, k, j, trim(cells[j]) AS x FROM n, (SELECT unnest([1, 2, 3]) AS j) WHERE trim(array_to_string(cells, '')) <> ''),
glue AS (SELECT *, lag(x) OVER (PARTITION BY doc, page, entry, j ORDER BY k) AS prior FROM part WHERE x <> ''),
cell AS (SELECT doc, page, entry, j, string_agg(CASE WHEN prior IS NULL OR prior LIKE '%-' THEN x ELSE ' ' || x END, '' ORDER BY k) AS cell FROM glue GROUP BY doc, page, entry, j)
SELECT p.doc, p.page, CAST(p.entry AS BIGINT) AS entry, t.y, string_agg(coalesce(cell, ''), '|' ORDER BY p.j) AS cells FROM (SELECT DISTINCT doc, page, entry, j FROM part) p LEFT JOIN cell c ON c.doc = p.doc AND c.page = p.page AND c.entry = p.entry AND c.j = p.j
JOIN tall t ON t.doc = p.doc AND t.page = p.page AND t.entry = p.entry GROUP BY p.doc, p.page, p.entry, t.y""",
}
