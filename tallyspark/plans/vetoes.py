"""Veto messages printed from the driver's order lines: a supplier is a message, its order lines the printed lines in order."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.operators import messages as ops

from .comparing import ORDER
from .ledger import table

# Both engines read this expression: i is the line's place, q its whole quantity, r what the line is.
TEXT = """CASE r WHEN 0 THEN concat('ITEM NUMBER ', i % 97 + 1) WHEN 1 THEN concat('On  page ', q, ', delete the boxed text beginning with “w', l_partkey) WHEN 2 THEN concat('” and ending with “x', q, '...') WHEN 3 THEN '”.'
  WHEN 4 THEN concat('On page ', q, ', delete “one ', l_partkey, '.” On page ', q + 1, ', delete the whole ter-') WHEN 5 THEN 'race of it.' WHEN 6 THEN concat('Heading of ', l_partkey, CASE WHEN q % 3 = 0 THEN concat(' ', repeat('x', 70)) ELSE '' END)
  WHEN 7 THEN '  The veto is in the Public interest. ' WHEN 8 THEN '   ' WHEN 9 THEN 'Page 3 of 9' WHEN 10 THEN 'on page 5 strike “all' WHEN 11 THEN 'the pre-' WHEN 12 THEN 'Tax starting with “z” and continuing to the end of the page'
  ELSE concat('as ON PAGE ', q, ' says, “delete ', l_partkey, '”') END"""


def lines(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("*", F.col("l_suppkey").alias("doc"), F.expr("CAST(l_quantity AS INT)").alias("q"))
    rows = rows.withColumn("i", F.row_number().over(W.partitionBy("doc").orderBy(*ORDER.split(", "))) - 1)
    # The multiplier mixes the line's own key with its place, so that kinds follow one another in every order.
    rows = rows.withColumn("r", F.expr("CASE WHEN i % 9 = 0 THEN 0 WHEN i % 9 = 1 THEN (CASE WHEN q % 2 = 0 THEN 1 ELSE 4 END) ELSE (l_partkey * 5 + q) % 14 END"))
    return rows.select("doc", F.col("i").alias("line_no"), F.expr(TEXT).alias("text"))


def items(spark, sf_dir):
    return ops.message_items(lines(spark, sf_dir))


QUERIES = {
    "w19_instructions": lambda s, d: items(s, d).select("doc", "segment", F.posexplode("instructions").alias("place", "instruction")),
    "f27_complete": lambda s, d: lines(s, d).select("doc", "line_no", ops.is_complete(F.col("text")).alias("complete"), ops.starts_instruction(F.col("text")).alias("starts"), F.array_join(ops.embedded(F.col("text")), "|").alias("parts")),
    "c27_message_items": lambda s, d: items(s, d).withColumn("instructions", F.size("instructions")),
    "f28_item_deletions": lambda s, d: ops.item_deletions(items(s, d)),
    "c27_message_report": lambda s, d: ops.message_report(items(s, d)),
}

PRINTED = f"""raw AS (SELECT *, CASE WHEN i % 9 = 0 THEN 0 WHEN i % 9 = 1 THEN (CASE WHEN q % 2 = 0 THEN 1 ELSE 4 END) ELSE (l_partkey * 5 + q) % 14 END AS r
  FROM (SELECT *, l_suppkey AS doc, CAST(floor(l_quantity) AS INTEGER) AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY {ORDER}) - 1 AS i FROM lineitem)),
l AS (SELECT doc, i AS line_no, {TEXT} AS text FROM raw)"""
_ANY = lambda words: "(" + " OR ".join(f"contains(lower({{0}}), '{w}')" for w in words) + ")"


def _complete(x: str) -> str:
    has = lambda words: _ANY(words).format(x)
    d = ops.documents
    return f"""(NOT ({has(d.RANGE_OPENERS)} AND NOT {has(d.RANGE_CONNECTORS)} AND NOT {has(d.PAGE_END_CONNECTORS)}) AND (right(rtrim({x}), 1) IN ('”', '"') OR (right(rtrim({x}), 1) = '.' AND right(rtrim({x}), 3) <> '...')))"""


def _embedded(x: str) -> str:
    """A mark before every "on page" and a number, kept where "delete" stands behind it."""
    pieces = f"string_split(regexp_replace({x}, '(?i)(on page\\s*[0-9])', chr(1) || '\\1', 'g'), chr(1))"
    marked = f"list_transform({pieces}, lambda p, n: CASE WHEN n = 1 THEN p WHEN contains(lower(array_to_string({pieces}[n:], '')), 'delete') THEN chr(1) || p ELSE p END)"
    return f"list_filter(list_transform(string_split(array_to_string({marked}, ''), chr(1)), lambda p: trim(p)), lambda p: p <> '')"


def _join(a: str, x: str) -> str:
    return f"CASE WHEN regexp_matches({a}, '\\p{{L}}-$') AND regexp_matches({x}, '^\\p{{Ll}}') THEN left({a}, length({a}) - 1) || {x} WHEN right({a}, 1) = '-' OR {a} = '' THEN {a} || {x} ELSE {a} || ' ' || {x} END"


ITEMS = f"""{PRINTED},
seg AS (SELECT *, sum(CAST(num IS NOT NULL AS INTEGER)) OVER (PARTITION BY doc ORDER BY line_no) AS segment FROM (SELECT *, TRY_CAST(nullif(regexp_extract(trim(text), '^ITEM NUMBER\\s+([0-9]+)(\\s|$)', 1), '') AS INTEGER) AS num FROM l WHERE NOT regexp_full_match(trim(text), 'Page [0-9]+ of [0-9]+'))),
item AS (SELECT doc, segment, max(num) AS item_number FROM seg WHERE segment > 0 GROUP BY doc, segment),
body AS (SELECT doc, segment, row_number() OVER (PARTITION BY doc, segment ORDER BY line_no) AS j, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM seg WHERE segment > 0 AND num IS NULL),
f AS (SELECT doc, segment, CAST(0 AS BIGINT) AS j, '' AS acc, CAST([] AS VARCHAR[]) AS done, CAST(0 AS BIGINT) AS taken, false AS ended FROM item
  UNION ALL SELECT f.doc, f.segment, b.j, CASE WHEN f.ended OR b.line = '' THEN acc WHEN starts_with(lower(b.line), 'on page') THEN b.line WHEN acc <> '' AND NOT {_complete('acc')} THEN {_join('acc', 'b.line')} ELSE acc END,
    CASE WHEN NOT f.ended AND acc <> '' AND starts_with(lower(b.line), 'on page') THEN list_append(done, acc) ELSE done END,
    CASE WHEN f.ended THEN taken WHEN b.line = '' OR starts_with(lower(b.line), 'on page') OR (acc <> '' AND NOT {_complete('acc')}) THEN b.j ELSE taken END,
    f.ended OR NOT (b.line = '' OR starts_with(lower(b.line), 'on page') OR (acc <> '' AND NOT {_complete('acc')}))
  FROM f JOIN body b ON b.doc = f.doc AND b.segment = f.segment AND b.j = f.j + 1),
last AS (SELECT doc, segment, arg_max(CASE WHEN acc = '' THEN done ELSE list_append(done, acc) END, j) AS whole, arg_max(taken, j) AS taken FROM f GROUP BY doc, segment),
ins AS (SELECT doc, segment, flatten(list_transform(whole, lambda w: {_embedded('w')})) AS ins FROM last),
rest AS (SELECT b.doc, b.segment, trim(text) AS t, row_number() OVER (PARTITION BY b.doc, b.segment ORDER BY b.j) AS n FROM body b JOIN last ON last.doc = b.doc AND last.segment = b.segment AND b.j > taken WHERE trim(text) <> ''),
head AS (SELECT doc, segment, coalesce(max(t) FILTER (n = 1), '') AS a, coalesce(max(t) FILTER (n = 2), '') AS b FROM rest GROUP BY doc, segment),
title AS (SELECT item.doc, item.segment, item_number, coalesce(strlen(a) >= 75 AND b <> '' AND strlen(b) < 40, false) AS title_rejoined, coalesce(CASE WHEN strlen(a) >= 75 AND b <> '' AND strlen(b) < 40 THEN a || ' ' || b ELSE a END, '') AS title
  FROM item LEFT JOIN head ON head.doc = item.doc AND head.segment = item.segment),
reason AS (SELECT r.doc, r.segment, list_reduce(list_prepend('', list(t ORDER BY n)), lambda x, y: {_join('x', 'y')}) AS rationale FROM rest r JOIN title ON title.doc = r.doc AND title.segment = r.segment WHERE n > CASE WHEN title_rejoined THEN 2 ELSE 1 END GROUP BY r.doc, r.segment),
full_item AS (SELECT t.doc, t.segment, item_number, ins, title, title_rejoined, coalesce(rationale, '') AS rationale, contains(lower(coalesce(rationale, '')), 'is in the public interest') AS has_formula
  FROM title t JOIN ins ON ins.doc = t.doc AND ins.segment = t.segment LEFT JOIN reason r ON r.doc = t.doc AND r.segment = t.segment)"""
_OPEN, _CLOSE, _END = ("(" + "|".join(x) + ")" for x in (ops.documents.RANGE_OPENERS, ops.documents.RANGE_CONNECTORS, ops.documents.PAGE_END_CONNECTORS))


def _quote(x: str) -> str:
    """struct(t, fixed) of what is quoted in ``x``, the missing mark repaired."""
    o, c = f"least(coalesce(nullif(strpos({x}, '“'), 0), 1000000), coalesce(nullif(strpos({x}, '\"'), 0), 1000000))", f"(length({x}) + 1 - least(coalesce(nullif(strpos(reverse({x}), '”'), 0), 1000000), coalesce(nullif(strpos(reverse({x}), '\"'), 0), 1000000)))"
    both = f"({o} < {c})"
    raw = f"CASE WHEN {both} THEN {x}[{o} + 1:{c} - 1] WHEN {o} < 1000000 THEN trim({x}[{o} + 1:], '“”\" ') WHEN strpos({x}, '”') > 0 THEN trim({x}[:{c} - 1], '“”\" ') END"
    return f"{{'t': nullif(trim({raw}), ''), 'fixed': NOT {both} AND {raw} IS NOT NULL}}"


CUTS = f"""cut0 AS (SELECT doc, segment, item_number, CAST(n - 1 AS INTEGER) AS place, ins[n] AS instruction FROM (SELECT *, unnest(range(1, len(ins) + 1)) AS n FROM full_item)),
cut1 AS (SELECT *, TRY_CAST(nullif(regexp_extract(instruction, '(?i)\\bpage\\s+[^0-9\\s]*([0-9]+)', 1), '') AS INTEGER) AS bill_page, CASE WHEN regexp_matches(lower(instruction), '{_OPEN}') THEN regexp_replace(instruction, '(?is)^.*?{_OPEN}', '') END AS after FROM cut0),
cut2 AS (SELECT *, coalesce(regexp_matches(lower(after), '{_END}'), false) AS to_end, CASE WHEN regexp_matches(lower(after), '{_CLOSE}') THEN regexp_replace(after, '(?is)^.*?{_CLOSE}', '') END AS tail FROM cut1),
cut3 AS (SELECT *, CASE WHEN to_end THEN regexp_replace(after, '(?is){_END}.*$', '') ELSE regexp_replace(after, '(?is){_CLOSE}.*$', '') END AS first_part FROM cut2),
cut4 AS (SELECT *, {_quote('first_part')} AS a, {_quote('tail')} AS z, {_quote('instruction')} AS w FROM cut3),
cut AS (SELECT doc, segment, item_number, place, instruction, CASE WHEN after IS NULL THEN CASE WHEN w.t IS NULL THEN 'whole' ELSE 'text' END WHEN to_end THEN CASE WHEN a.t IS NULL THEN 'unrecognised' ELSE 'range_to_page_end' END WHEN a.t IS NULL OR z.t IS NULL THEN 'unrecognised' ELSE 'range' END AS kind, bill_page, a, z, w FROM cut4),
cuts AS (SELECT doc, segment, item_number, place, instruction, kind, bill_page, CASE WHEN kind = 'text' THEN w.t END AS text, CASE WHEN kind LIKE 'range%' THEN a.t END AS begins, CASE WHEN kind = 'range' THEN z.t END AS ends,
  coalesce(CASE kind WHEN 'text' THEN w.fixed WHEN 'range' THEN a.fixed OR z.fixed WHEN 'range_to_page_end' THEN a.fixed END, false) AS quotes_repaired FROM cut)"""
WITH = f"WITH RECURSIVE {ITEMS}"
ORACLES = {
    "w19_instructions": f"{WITH} SELECT doc, CAST(segment AS BIGINT) AS segment, CAST(n - 1 AS INTEGER) AS place, ins[n] AS instruction FROM (SELECT *, unnest(range(1, len(ins) + 1)) AS n FROM ins)",
    "f27_complete": f"WITH {PRINTED} SELECT doc, CAST(line_no AS INTEGER) AS line_no, {_complete('text')} AS complete, starts_with(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'on page') AS starts, array_to_string({_embedded('text')}, '|') AS parts FROM l",
    "c27_message_items": f"{WITH} SELECT doc, CAST(segment AS BIGINT) AS segment, item_number, CAST(len(ins) AS INTEGER) AS instructions, title, title_rejoined, rationale, has_formula FROM full_item",
    "f28_item_deletions": f"{WITH}, {CUTS} SELECT doc, CAST(segment AS BIGINT) AS segment, item_number, place, instruction, kind, bill_page, text, begins, ends, quotes_repaired FROM cuts",
    "c27_message_report": f"""{WITH}, {CUTS}, k AS (SELECT doc, item_number, count(*) AS n, count(*) FILTER (kind = 'unrecognised') AS u, bool_or(contains(coalesce(text, begins, ''), '$')) AS m FROM cuts GROUP BY doc, item_number),
r AS (SELECT f.doc, count(*) AS items, CAST(coalesce(sum(n), 0) AS BIGINT) AS deletions, count(*) FILTER (NOT has_formula) AS without_formula, count(*) FILTER (n IS NULL) AS without_deletions, CAST(coalesce(sum(u), 0) AS BIGINT) AS unrecognised, count(*) FILTER (m) AS striking_money,
  max(f.item_number) - min(f.item_number) + 1 - count(DISTINCT f.item_number) AS missing_numbers FROM full_item f LEFT JOIN k ON k.doc = f.doc AND k.item_number = f.item_number GROUP BY f.doc)
SELECT *, without_formula + without_deletions + unrecognised + missing_numbers = 0 AS is_clean FROM r""",
}
