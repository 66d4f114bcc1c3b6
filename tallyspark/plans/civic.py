"""Bills, page geometry, veto reports and feed lookups over the driver's tables.

Bill: order; assembly: customer; version: line number. Page: user; heights and marks: event values.
Source: supplier; a node cites the suppliers of its order's lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import bills, documents, feed, process, stages

from . import fixtures as fx
from . import movement
from .ledger import table

BASE = "https://records.example//"
# Both engines read these expressions: a bill's number with white space of every kind in it, a heading with markers of every kind and place.
NUMBER = "CASE o_orderkey % 4 WHEN 0 THEN concat('H B ', o_orderkey) WHEN 1 THEN concat(' hb', chr(9), o_orderkey, ' ') WHEN 2 THEN concat('SB', o_orderkey) ELSE concat('Hb  ', o_orderkey, chr(10)) END"
HEADING = "CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN concat('**VETOED**', p_name) WHEN 2 THEN concat('  **VETOED**  ', p_name, ' ') WHEN 3 THEN concat('**PARTIALLY VETOED**', p_name, '**VETOED**') WHEN 4 THEN concat(p_name, ' **VETOED**') ELSE concat('**vetoed** ', p_name) END"
ENDINGS = ["th", "st", "nd", "rdth", ""]
TOLERANCE = 0.5
BIENNIA = fx.Rows("biennia", "bill string, file string, previous_bill string", [("N", "n.xlsx", "R"), ("R", "r.xlsx", "A"), ("A", "a.xlsx", None)])
BILLS = fx.Copied("bills_", "bill string, file string, previous_bill string", [("N/@", "n@.xlsx", "R/@"), ("R/@", "r@.xlsx", "A/@"), ("A/@", "a@.xlsx", None), ("Q/@", "q@.xlsx", "gone/@")])
OFFICERS = fx.Rows("officers", "actor string, bill string, officer string", [("house", "A", "Speaker A"), ("house", "N", "Speaker N"), ("senate", "A", "President A")])
LINES = fx.Drawn("broken", "id int, line string", list(enumerate([
    "a ter-|race by Miller-|Jones", "TOP-|UP # and #-|month", " a |  | b", "", "one-|", "Größen-|änderung", "Page 1 of 2|x", "river-|side",
])))
FEET = fx.Drawn("feet", "id int, line string", list(enumerate(["Page # of 57", "  Page 1 of 2 ", "Page 1 of", "Page a of 2", "Page 1 of 2 x", "page 1 of 2", "", None])))
_TITLES = [("x" * 74, "short"), ("x" * 72 + "#", "short #"), ("é" * 38, " short "), ("x" * 80, "y" * 40), ("x" * 80, ""), ("x", "y"), ("", "y")]
HEADINGS = fx.Drawn("headings", "id int, first string, second string", [(i, *t) for i, t in enumerate(_TITLES)])
ROWS = fx.Drawn("header_rows", "id int, line string", list(enumerate(["As Introduced|As Passed by House", "Executive|x", "Executive|x|As Passed by  Senate", "|As Enacted|", "a|b|#", "", "Executive|x|y|As Enacted"])))
FIRST = fx.Drawn("justifications", "id int, line string", list(enumerate(["one # two\nthree", "  padded  \nx", "", "\nafter", None])))


def numbered(spark, sf_dir):
    """Orders as bills: number, assembly with an ordinal ending, and stage."""
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(NUMBER).alias("number"), F.concat(F.col("o_custkey").cast("string"), ending).alias("assembly"), F.substring("o_orderpriority", 3, 20).alias("stage"))


def slugs(spark, sf_dir):
    n, a = F.col("number"), F.col("assembly")
    return numbered(spark, sf_dir).select("o_orderkey", bills.bill_slug(n).alias("slug"), bills.corpus_slug(n, a).alias("corpus_slug"), bills.version_slug(n, F.col("stage")).alias("version_slug"))


def urls(spark, sf_dir):
    return numbered(spark, sf_dir).select("o_orderkey", bills.document_url(F.lit(BASE), F.col("number"), F.col("assembly")).alias("url"))


def missing_versions(spark, sf_dir):
    """Fetched: all lines of an order; held: those that were returned."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("HB "), F.col("l_orderkey").cast("string")).alias("number"), F.col("l_linenumber").cast("string").alias("stage"), "l_returnflag")
    held = lines.where("l_returnflag = 'R'").select(bills.version_slug(F.col("number"), F.col("stage")).alias("slug"))
    return bills.missing_versions(lines.select("number", "stage").distinct(), held)


def marks(spark, sf_dir, kind):
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select(F.col("user_id").alias("doc"), F.lit(1).alias("page"), F.col("value").alias("y"))


def clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.lit(1).alias("page"), F.col("value").alias("x"))
    return documents.rule_clusters(rows, 8 * TOLERANCE).select("doc", F.round("rule", 6).alias("rule"), "marks")


def headings(spark, sf_dir):
    """Part names as provision headings, with markers of every kind and place."""
    return table(spark, sf_dir, "part").select("p_partkey", documents.veto_marker(F.expr(HEADING)).alias("m")).select("p_partkey", "m.*")


def provenance(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_brand")).alias("code"), F.col("p_name").alias("title"), F.col("p_size").alias("page"))
    return documents.provision_provenance(rows).select("p_partkey", "document_ref", "locator")


def entries(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_returnflag").alias("code"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").distinct()
    return documents.entry_index(rows, "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def report(spark, sf_dir):
    """A customer is a message, an order an item, its lines the deletions."""
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("item_number"), (F.col("o_orderstatus") != "P").alias("has_formula"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    cuts = lines.select(F.col("o_custkey").alias("doc"), F.col("l_orderkey").alias("item_number"), F.when(F.col("l_tax") > 0.07, "unrecognised").otherwise("text").alias("kind"), F.when(F.col("l_discount") > 0.05, "costs $5").alias("text"))
    return documents.veto_report(items, cuts)


def steps(spark, sf_dir):
    return stages.steps(movement.points(spark, sf_dir))


def cited(spark, sf_dir):
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"))
    return feed.citing_counts(sources, table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("source"), F.col("l_orderkey").alias("node")))


def lookup(spark, sf_dir):
    return feed.node_by_slug(table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))).alias("path")))


def split(rows, spark, sf_dir):
    return rows.frame(spark, sf_dir).select("id", F.split(F.coalesce("line", F.lit("")), "\\|").alias("cells"))


def labels(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    slug = F.lower(F.replace(F.col("p_name"), F.lit(" "), F.lit("-")))
    return rows.select("p_partkey", feed.humanised(slug).alias("label"), feed.constant_dollar_label(F.concat(F.lit("FY"), F.col("p_size").cast("string")), F.col("p_brand")).alias("dollars"))


def process_findings(spark, sf_dir):
    return process.findings(movement.columns(spark, sf_dir), BIENNIA.frame(spark, sf_dir).select("bill"), movement.HAND_OFFS, OFFICERS.frame(spark, sf_dir))


QUERIES = {
    "f17_bill_slugs": slugs,
    "f18_document_url": urls,
    "j31_missing_versions": missing_versions,
    "a36_rule_clusters": clusters,
    "p38_drawn_rules": lambda s, d: documents.drawn_rules(marks(s, d, "purchase"), marks(s, d, "click"), TOLERANCE),
    "w14_entry_starts": lambda s, d: documents.entry_starts(marks(s, d, "click"), marks(s, d, "purchase")),
    "f22_veto_headings": headings,
    "f41_provenance": provenance,
    "w09_entry_index": entries,
    "p28_veto_report": report,
    "f25_joined_lines": lambda s, d: split(LINES, s, d).select("id", documents.join_lines(F.col("cells")).alias("soft"), documents.join_lines(F.col("cells"), False).alias("hard")),
    "f26_running_feet": lambda s, d: FEET.frame(s, d).select("id", documents.is_running_foot(F.col("line")).alias("foot")),
    "f29_headings": lambda s, d: HEADINGS.frame(s, d).select("id", documents.heading(F.array("first", "second")).alias("h")).select("id", "h.*"),
    "p30_header_rows": lambda s, d: split(ROWS, s, d).select("id", documents.is_header_row(F.col("cells"), [x for xs in text.DOCUMENT_SPELLINGS.values() for x in xs]).alias("header")),
    "j14_previous_biennium": lambda s, d: process.with_previous(BILLS.frame(s, d)),
    "c17_process_findings": process_findings,
    "c34_hand_off_rows": lambda s, d: process.hand_off_rows(process.conditioning(movement.columns(s, d), movement.HAND_OFFS)),
    "p17_first_decomposition": lambda s, d: feed.first_decomposition(steps(s, d)),
    "j36_appropriation_decomposition": lambda s, d: feed.with_decomposition(feed.enacted_points(movement.points(s, d), movement.STAGES), steps(s, d)),
    "o08_largest_movements": lambda s, d: feed.largest_movements(steps(s, d)),
    "j33_enacted_points": lambda s, d: feed.enacted_points(movement.points(s, d), movement.STAGES),
    "a35_citing_counts": cited,
    "p35_node_by_slug": lookup,
    "f35_labels": labels,
    "f36_first_line": lambda s, d: FIRST.frame(s, d).select("id", feed.first_line(F.col("line")).alias("first")),
}

_SPELLINGS = ", ".join(f"'{x}'" for xs in text.DOCUMENT_SPELLINGS.values() for x in xs)
_ASSEMBLY = "CAST(o_custkey AS VARCHAR) || list_extract(['th', 'st', 'nd', 'rdth', ''], CAST(o_orderkey % 5 + 1 AS INTEGER))"


def _joined(soft: str) -> str:
    """DuckDB fold over the lines of ``broken``."""
    return f"""list_reduce(list_prepend('', list_filter(list_transform(string_split(line, '|'), lambda x: trim(x)), lambda x: x <> '')), lambda a, x:
  CASE WHEN {soft} AND regexp_matches(a, '\\p{{L}}-$') AND regexp_matches(x, '^\\p{{Ll}}') THEN left(a, length(a) - 1) || x WHEN a = '' OR ends_with(a, '-') THEN a || x ELSE a || ' ' || x END)"""


_COND = movement.ORACLES["c15_conditioning"]
ORACLES = {
    "f17_bill_slugs": f"WITH n AS (SELECT *, lower(regexp_replace({NUMBER}, '\\s', '', 'g')) AS slug FROM orders) SELECT o_orderkey, slug, slug || '-' || {_ASSEMBLY} AS corpus_slug, slug || '-' || substr(o_orderpriority, 3) AS version_slug FROM n",
    "f18_document_url": f"""WITH n AS (SELECT o_orderkey, lower(regexp_replace({NUMBER}, '\\s', '', 'g')) AS slug, {_ASSEMBLY} AS assembly FROM orders)
SELECT o_orderkey, 'https://records.example/legislation/' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(assembly, '(th)+$', ''), '(nd)+$', ''), '(rd)+$', ''), '(st)+$', '') || '/' || slug AS url FROM n""",
    "j31_missing_versions": "SELECT DISTINCT 'HB ' || l_orderkey AS number, CAST(l_linenumber AS VARCHAR) AS stage, 'hb' || l_orderkey || '-' || l_linenumber AS slug FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem h WHERE h.l_returnflag = 'R' AND h.l_orderkey = l.l_orderkey AND h.l_linenumber = l.l_linenumber)",
    "a36_rule_clusters": """WITH RECURSIVE x AS (SELECT user_id AS doc, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i FROM events),
c AS (SELECT doc, i, 0 AS id, value AS total, 1 AS n FROM x WHERE i = 1
  UNION ALL SELECT x.doc, x.i, CASE WHEN abs(value - total / n) <= 4.0 THEN id ELSE id + 1 END, CASE WHEN abs(value - total / n) <= 4.0 THEN total + value ELSE value END, CASE WHEN abs(value - total / n) <= 4.0 THEN n + 1 ELSE 1 END FROM c JOIN x ON x.doc = c.doc AND x.i = c.i + 1)
SELECT doc, round(arg_max(total, i) / max(n), 6) AS rule, CAST(max(n) AS INTEGER) AS marks FROM c GROUP BY doc, id""",
    "p38_drawn_rules": "SELECT user_id AS doc, 1 AS page, value AS y FROM events m WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'click' AND c.user_id = m.user_id AND abs(c.value - m.value) <= 0.5)",
    "w14_entry_starts": "SELECT DISTINCT user_id AS doc, 1 AS page, (SELECT min(c.value) FROM events c WHERE c.event_type = 'click' AND c.user_id = m.user_id AND c.value > m.value) AS y FROM events m WHERE event_type = 'purchase' AND y IS NOT NULL",
    "f22_veto_headings": f"""WITH h AS (SELECT p_partkey, trim({HEADING}) AS t FROM part)
SELECT p_partkey, CASE WHEN starts_with(t, '**VETOED**') THEN 'vetoed' WHEN starts_with(t, '**PARTIALLY VETOED**') THEN 'partially_vetoed' ELSE 'not_vetoed' END AS status,
  trim(CASE WHEN starts_with(t, '**VETOED**') THEN substr(t, 11) WHEN starts_with(t, '**PARTIALLY VETOED**') THEN substr(t, 21) ELSE t END) AS title FROM h""",
    "f41_provenance": """SELECT p_partkey, 'provision ' || CASE WHEN p_size > 10 THEN p_brand ELSE '"' || p_name || '"' END AS document_ref, 'page ' || p_size AS locator FROM part""",
    "w09_entry_index": "SELECT *, CAST(row_number() OVER (PARTITION BY doc, code ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS INTEGER) AS entry_index FROM (SELECT DISTINCT l_suppkey AS doc, l_returnflag AS code, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem)",
    "p28_veto_report": """WITH d AS (SELECT l_orderkey AS o, count(*) AS n, count(*) FILTER (l_tax > 0.07) AS u, bool_or(l_discount > 0.05) AS m FROM lineitem GROUP BY ALL),
r AS (SELECT o_custkey AS doc, count(*) AS items, CAST(coalesce(sum(n), 0) AS BIGINT) AS deletions, count(*) FILTER (o_orderstatus = 'P') AS without_formula, count(*) FILTER (n IS NULL) AS without_deletions, CAST(coalesce(sum(u), 0) AS BIGINT) AS unrecognised,
  count(*) FILTER (m) AS striking_money, max(o_orderkey) - min(o_orderkey) + 1 - count(DISTINCT o_orderkey) AS missing_numbers FROM orders LEFT JOIN d ON o = o_orderkey GROUP BY o_custkey)
SELECT *, without_formula + without_deletions + unrecognised + missing_numbers = 0 AS is_clean FROM r""",
    "f25_joined_lines": f"WITH {LINES.sql()} SELECT id, {_joined('true')} AS soft, {_joined('false')} AS hard FROM broken",
    "f26_running_feet": f"WITH {FEET.sql()} SELECT id, regexp_full_match(trim(line), 'Page [0-9]+ of [0-9]+') AS foot FROM feet",
    "f29_headings": f"WITH {HEADINGS.sql()}, w AS (SELECT *, strlen(trim(first)) >= 75 AND trim(second) <> '' AND strlen(trim(second)) < 40 AS rejoined FROM headings) SELECT id, CASE WHEN rejoined THEN trim(first) || ' ' || trim(second) ELSE trim(first) END AS title, rejoined FROM w",
    "p30_header_rows": f"""WITH {ROWS.sql()}, c AS (SELECT id, list_filter(list_transform(string_split(line, '|'), lambda x: trim(x)), lambda x: x <> '') AS filled FROM header_rows)
SELECT id, len(filled) >= 2 AND len(list_filter(filled, lambda x: regexp_replace(lower(x), '\\s+', ' ', 'g') IN ({_SPELLINGS}))) * 2 > len(filled) AS header FROM c""",
    "j14_previous_biennium": f"WITH {BILLS.sql()} SELECT b.bill, b.file, b.previous_bill, p.file AS previous_file FROM bills_ b LEFT JOIN bills_ p ON p.bill = b.previous_bill",
    "c17_process_findings": f"WITH {OFFICERS.sql()}, k AS ({_COND}) SELECT k.*, officer FROM k LEFT JOIN officers o ON o.actor = k.actor AND o.bill = k.bill WHERE (SELECT count(DISTINCT l_returnflag) FROM lineitem WHERE l_returnflag IN ('N', 'R', 'A')) = 3",
    "c34_hand_off_rows": f"""WITH k AS ({_COND}), s AS (SELECT actor, bill, round(100.0 * raised_after_raise / nullif(after_raise, 0), 6) AS raised_when_prior_raised, round(100.0 * raised_after_cut / nullif(after_cut, 0), 6) AS raised_when_prior_cut, after_raise + after_cut AS moved_n, round(100.0 * toward / nullif(toward + away, 0), 6) AS toward_baseline FROM k)
SELECT *, round(raised_when_prior_cut - raised_when_prior_raised, 5) AS gap FROM s""",
    "p17_first_decomposition": f"WITH {movement.POINTS} SELECT item, period, to_stage, from_stage, delta_cents FROM steps QUALIFY row_number() OVER (PARTITION BY item, period ORDER BY to_stage) = 1",
    "j36_appropriation_decomposition": f"""WITH {movement.POINTS}, f AS (SELECT item, period, to_stage, from_stage, delta_cents FROM steps QUALIFY row_number() OVER (PARTITION BY item, period ORDER BY to_stage) = 1)
SELECT p.item, p.period, p.cents, to_stage, from_stage, delta_cents FROM pts p LEFT JOIN f ON f.item = p.item AND f.period = p.period WHERE stage = 5 AND cents IS NOT NULL""",
    "o08_largest_movements": f"WITH {movement.POINTS} SELECT item, period, to_stage, delta_cents, CAST(row_number() OVER (PARTITION BY item, period ORDER BY abs(delta_cents) DESC, to_stage) AS INTEGER) AS place FROM steps QUALIFY place <= 2",
    "j33_enacted_points": f"WITH {movement.POINTS} SELECT item, period, cents FROM pts WHERE stage = 5 AND cents IS NOT NULL",
    "a35_citing_counts": "SELECT s_suppkey AS source, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') AS nodes FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey",
    "p35_node_by_slug": "SELECT replace(p_name, ' ', '-') AS slug, min(p_brand || '/' || replace(p_name, ' ', '-')) AS path, count(*) > 1 AS ambiguous FROM part GROUP BY 1",
    "f35_labels": "SELECT p_partkey, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS label, 'FY' || p_size || ' dollars (' || p_brand || ')' AS dollars FROM part",
    "f36_first_line": f"WITH {FIRST.sql()} SELECT id, trim(string_split(coalesce(line, ''), chr(10))[1]) AS first FROM justifications",
}
