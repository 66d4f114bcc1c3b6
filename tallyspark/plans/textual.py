"""Queries over texts written from the driver's rows: money, headers, paths, provisions, and the unpivot of wide cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import numbers, text
from tallyspark.operators import extract

from . import fixtures as fx


def f01(spark, sf_dir):
    return fx.MONEY.frame(spark, sf_dir).select("id", numbers.parse_money(F.col("text")).alias("p")).select("id", "p.cents", F.col("p.error").isNull().alias("ok"), numbers.format_money(F.col("p.cents")).alias("shown"))


def f23(spark, sf_dir):
    rows = fx.VETOED.frame(spark, sf_dir).select("id", text.veto_split(F.col("text")).alias("v"))
    return rows.select("id", F.col("v.text").alias("text"), F.array_join("v.spans", "|").alias("spans"), F.coalesce("v.unterminated", F.lit(False)).alias("unterminated"))


def plan(spark, sf_dir):
    return extract.column_plan(fx.HEADERS.frame(spark, sf_dir))


QUERIES = {
    "f01_money_parse": f01,
    "f02_strict_parse": lambda s, d: fx.STRICT.frame(s, d).select("id", numbers.parse_money_strict(F.col("text")).alias("cents")),
    "f07_nested_parens": lambda s, d: fx.NESTED.frame(s, d).select("id", text.without_brackets(F.col("text")).alias("outside")),
    "f14_path_join": lambda s, d: fx.PATHS.frame(s, d).select("base", "target", text.joined_path(F.col("base"), F.col("target")).alias("path")).withColumns({"slug": text.slug_of(F.col("path")), "class": text.target_class(F.col("path"))}),
    "f21_concurrence": lambda s, d: fx.CELLS.frame(s, d).select("id", text.is_concurrence(F.col("text")).alias("concurs")),
    "f23_inline_veto": f23,
    "f24_provision_code": lambda s, d: fx.CODES.frame(s, d).select("id", text.provision_code(F.col("text")).alias("c")).select("id", "c.code", "c.rest"),
    "c22_column_plan": plan,
    "c23_unpivot": lambda s, d: extract.unpivot(fx.WIDE_CELLS.frame(s, d), plan(s, d)),
    "a17_accounting": lambda s, d: extract.accounting(extract.unpivot(fx.WIDE_CELLS.frame(s, d), plan(s, d))),
}

_MONEY = f"""{fx.MONEY.sql()}, m1 AS (SELECT id, trim(text) AS t FROM money), m2 AS (SELECT id, t, (starts_with(t, '(') AND ends_with(t, ')')) OR starts_with(t, '-') AS neg,
  regexp_replace(CASE WHEN starts_with(t, '(') AND ends_with(t, ')') THEN substr(t, 2, length(t) - 2) WHEN starts_with(t, '-') THEN substr(t, 2) ELSE t END, '[$,  _]', '', 'g') AS b FROM m1),
m3 AS (SELECT id, neg, CASE WHEN regexp_full_match(b, '([0-9]+(\\.[0-9]{{0,2}})?|\\.[0-9]{{1,2}})') THEN TRY_CAST(('0' || regexp_replace(b, '\\.$', '')) AS DECIMAL(32, 2)) * 100 END AS x FROM m2),
m4 AS (SELECT id, TRY_CAST(CASE WHEN neg THEN -x ELSE x END AS BIGINT) AS cents FROM m3)"""


def _named(expr: str, spellings: dict[str, list[str]]) -> str:
    quoted = lambda xs: ", ".join("'" + x + "'" for x in xs)
    return "CASE " + " ".join(f"WHEN {expr} IN ({quoted(v)}) THEN '{k}'" for k, v in spellings.items()) + " END"


_PLAN = f"""{fx.HEADERS.sql()}, h1 AS (SELECT *, trim(regexp_replace(lower(header), '[^a-z0-9]+', ' ', 'g')) AS n, trim(regexp_replace(lower(regexp_replace(header, '\\([^()]*\\)', '', 'g')), '[^a-z0-9]+', ' ', 'g')) AS m FROM headers),
h2 AS (SELECT *, regexp_extract(n, '\\bfy ?([0-9]{{4}})(?:[^0-9a-z]|$)', 1) AS y, trim(regexp_replace(regexp_replace(m, '\\bfy ?[0-9]{{4}}\\b', ' ', 'g'), ' +', ' ', 'g')) AS label FROM h1),
h3 AS (SELECT workbook, col_idx, y, label, {_named('n', text.IDENTITY_SPELLINGS)} AS ident, {_named('label', text.STAGE_SPELLINGS)} AS stage FROM h2),
h4 AS (SELECT *, CASE WHEN ident IS NOT NULL THEN 'identity' WHEN y = '' THEN 'other' WHEN label = '' THEN 'actual' WHEN label LIKE '%change%' THEN 'other' WHEN label IN ('actual', 'actuals') THEN 'actual' WHEN label LIKE 'adjusted approp%' THEN 'adjusted'
  WHEN label LIKE '%estimate%' OR label LIKE '%projected%' THEN 'estimate' WHEN label IN ('appropriation', 'appropriations') OR stage IS NOT NULL THEN 'appropriation' ELSE 'unknown_stage' END AS kind FROM h3),
plan AS (SELECT workbook, col_idx, kind, CASE WHEN kind = 'identity' THEN ident WHEN kind = 'appropriation' THEN coalesce(stage, 'as-enacted') WHEN kind IN ('estimate', 'unknown_stage') THEN label END AS detail,
  CASE WHEN kind NOT IN ('identity', 'other') THEN 'FY' || y END AS fiscal_year FROM h4)"""
_FACTS = f"""{_PLAN}, {fx.WIDE_CELLS.sql()}, k AS (SELECT c.*, kind, detail, fiscal_year FROM wide_cells c JOIN plan USING (workbook, col_idx)),
idn AS (SELECT workbook, row_idx, max(text) FILTER (detail = 'agency') AS agency, max(text) FILTER (detail = 'line_item_code') AS code, max(text) FILTER (detail = 'line_item_name') AS line_item_name FROM k WHERE kind = 'identity' GROUP BY ALL),
p AS (SELECT k.*, agency, trim(code) AS code, line_item_name, regexp_replace(trim(k.text), '[$, _()]', '', 'g') AS b FROM k JOIN idn USING (workbook, row_idx) WHERE kind IN ('appropriation', 'actual') AND trim(code) <> ''),
facts AS (SELECT workbook, row_idx, agency, code, line_item_name, kind, detail AS stage, fiscal_year, CASE WHEN trim(text) IN ('', '-') THEN 'blank' WHEN regexp_full_match(b, '[0-9]+(\\.[0-9]{{0,2}})?') THEN 'row' ELSE 'failure' END AS outcome,
  CASE WHEN trim(text) NOT IN ('', '-') AND regexp_full_match(b, '[0-9]+(\\.[0-9]{{0,2}})?') THEN CAST(CAST(b AS DECIMAL(20, 2)) * 100 * CASE WHEN starts_with(trim(text), '(') THEN -1 ELSE 1 END AS BIGINT) END AS amount_cents FROM p)"""
ORACLES = {
    "f01_money_parse": f"WITH {_MONEY} SELECT id, cents, cents IS NOT NULL AS ok, CASE WHEN cents < 0 THEN '-' WHEN cents IS NOT NULL THEN '' END || '$' || (abs(cents) // 100) || '.' || lpad(CAST(abs(cents) % 100 AS VARCHAR), 2, '0') AS shown FROM m4",
    "f02_strict_parse": f"WITH {fx.STRICT.sql()}, b AS (SELECT id, regexp_replace(trim(text), '[,$ ]', '', 'g') AS b FROM strict) SELECT id, CASE WHEN regexp_full_match(b, '[-(]?[0-9]+\\.[0-9]{{2}}\\)?') THEN CAST(regexp_replace(b, '[-().]', '', 'g') AS BIGINT) * CASE WHEN b LIKE '-%' OR b LIKE '(%' THEN -1 ELSE 1 END END AS cents FROM b",
    "f07_nested_parens": f"""WITH RECURSIVE {fx.NESTED.sql()}, r AS (SELECT id, text AS s, 0 AS d, '' AS out FROM nested UNION ALL
  SELECT id, substr(s, 2), CASE WHEN s[1] = '(' THEN d + 1 WHEN s[1] = ')' THEN greatest(0, d - 1) ELSE d END, CASE WHEN d = 0 AND s[1] NOT IN ('(', ')') THEN out || s[1] ELSE out END FROM r WHERE s <> '')
SELECT nested.id, max(r.out) FILTER (r.s = '') AS outside FROM nested LEFT JOIN r ON r.id = nested.id GROUP BY nested.id""",
    "f14_path_join": f"""WITH RECURSIVE {fx.PATHS.sql()}, r AS (SELECT base, target, string_split(regexp_replace(base, '[^/]*$', '') || target, '/') AS todo, CAST([] AS VARCHAR[]) AS done FROM paths UNION ALL
  SELECT base, target, todo[2:], CASE WHEN todo[1] IN ('', '.') THEN done WHEN todo[1] = '..' THEN done[:-2] ELSE list_append(done, todo[1]) END FROM r WHERE len(todo) > 0),
f AS (SELECT base, target, array_to_string(done, '/') AS path FROM r WHERE len(todo) = 0)
SELECT base, target, path, regexp_extract(path, '([^/]+?)(\\.yml|\\.md)?$', 1) AS slug, CASE WHEN path LIKE '%.ont.yml' THEN regexp_extract(path, '([^/]+)\\.ont\\.yml$', 1) ELSE regexp_extract(path, '([^/]+)/[^/]+$', 1) END AS class FROM f""",
    "f21_concurrence": f"WITH {fx.CELLS.sql()} SELECT id, coalesce(trim(regexp_replace(lower(regexp_replace(regexp_replace(trim(text), '^\\([0-9]+\\)\\s*', ''), '\\.+$', '')), '\\s+', ' ', 'g')) IN ({', '.join(repr(x) for x in text.CONCURRENCES)}), false) AS concurs FROM cells",
    "f23_inline_veto": f"""WITH {fx.VETOED.sql()} SELECT id, replace(replace(text, '[***VETOED:', ''), '***]', '') AS text, array_to_string(list_transform(regexp_extract_all(text, '(?s)\\[\\*\\*\\*VETOED:(.*?)(?:\\*\\*\\*\\]|$)', 1), lambda x: trim(x)), '|') AS spans,
  coalesce(len(regexp_extract_all(text, '\\[\\*\\*\\*VETOED:')) > len(regexp_extract_all(text, '\\*\\*\\*\\]')), false) AS unterminated FROM vetoed""",
    "f24_provision_code": f"WITH {fx.CODES.sql()}, c AS (SELECT id, text, regexp_extract(text, '^([A-Z]{{3,8}}[0-9]{{1,4}})(?:[^0-9]|$)', 1) AS c FROM codes) SELECT id, nullif(c, '') AS code, CASE WHEN c <> '' THEN trim(substr(text, length(c) + 1)) END AS rest FROM c",
    "c22_column_plan": f"WITH {_PLAN} SELECT * FROM plan",
    "c23_unpivot": f"WITH {_FACTS} SELECT * FROM facts",
    "a17_accounting": f"WITH {_FACTS} SELECT workbook, count(*) FILTER (kind = 'appropriation' AND outcome = 'row') AS appropriations, count(*) FILTER (kind = 'actual' AND outcome = 'row') AS actuals, count(*) FILTER (outcome = 'blank') AS blanks, count(*) FILTER (outcome = 'failure') AS failures, count(*) AS cells FROM facts GROUP BY workbook",
}
