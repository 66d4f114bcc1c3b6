"""Graph queries: the whole rule set on a small corpus for every supplier, with other records missing in each; link resolution and backlinks on the driver's tables."""

from __future__ import annotations

import posixpath

from pyspark.sql import functions as F

from tallyspark.operators import graph

from . import fixtures as fx
from .ledger import table

_NODES = [
    ("appropriation/a-@.yml", "appropriation", "Appropriation A", "fine [verified]"), ("appropriation/b-@.yml", "appropriation", "B", "The amount is unfilled here."), ("appropriation/c-@.yml", "appropriation", "C", "actuals are not carried by any committed source; [guess] →[succeeds]→ x [link](y) [x]"),
    ("expenditure/e-@.yml", "expenditure", "E", "Not catalogued (lsc-@). Also not yet catalogued."), ("line-item/li-@.yml", "line-item", "LI [verified]", "synthetic-fixture value"), ("wrong/dir-@.yml", "line-item", "D", ""), ("mystery/m-@.yml", "mystery", "M", "[guess] [verified]"), ("fiscal-period/p-@.yml", "fiscal-period", "P", None),
    ("agency/lone-@.yml", "agency", "Lone", "not catalogued (unknown-slug)"),
]
_PROPS = [
    ("appropriation/a-@.yml", "amount", "text", "$@.00"), ("appropriation/b-@.yml", "amount", "text", "$1.00"), ("appropriation/b-@.yml", "cost_delta", "float", "1.5"), ("appropriation/c-@.yml", "amount", "text", "[open] tbd"), ("line-item/li-@.yml", "current_code", "text", "200550 [verified]"),
    ("line-item/li-@.yml", "agency_code", "text", "[open] unknown"), ("line-item/li-@.yml", "stray", "text", "x"), ("expenditure/e-@.yml", "basis", "text", "see synthetic-fixture"), ("mystery/m-@.yml", "zzz", "text", "q"),
]
_LINKS = [
    ("appropriation/a-@.yml", 0, "instance-of", "../appropriation.ont.yml"), ("appropriation/a-@.yml", 1, "grants-authority-for", "../line-item/li-@.yml"), ("appropriation/a-@.yml", 2, "cites", "../catalog/lsc-@.md"), ("appropriation/b-@.yml", 0, "instance-of", "../line-item.ont.yml"),
    ("appropriation/b-@.yml", 1, "grants-authority-for", "../line-item/none-@.yml"), ("appropriation/b-@.yml", 2, "cites", "../catalog/none-@.md"), ("appropriation/b-@.yml", 3, "draws-from", "../catalog/lsc-@.md"), ("appropriation/c-@.yml", 0, "instance-of", "../appropriation.ont.yml"),
    ("appropriation/c-@.yml", 1, "grants-authority-for", "../line-item/li-@.yml"), ("appropriation/c-@.yml", 2, "in-period", "../fiscal-period/p-@.yml"), ("expenditure/e-@.yml", 0, "instance-of", "../expenditure.ont.yml"), ("expenditure/e-@.yml", 1, "disburses-against", "./../line-item/li-@.yml"),
    ("expenditure/e-@.yml", 2, "in-period", "../fiscal-period/p-@.yml"), ("expenditure/e-@.yml", 3, "praises", "../line-item/li-@.yml"), ("line-item/li-@.yml", 0, "instance-of", "../line-item.ont.yml"), ("wrong/dir-@.yml", 0, "instance-of", "../line-item.ont.yml"), ("fiscal-period/p-@.yml", 0, "instance-of", "../fiscal-period.ont.yml"),
    ("mystery/m-@.yml", 0, "belongs-to", "../nowhere/x-@.yml"), ("agency/lone-@.yml", 0, "instance-of", "../agency.ont.yml"),
]
NODES = fx.Copied("nodes", "path string, class string, label string, description string", _NODES)
PROPS = fx.Copied("props", "path string, key string, kind string, text string", _PROPS)
LINKS = fx.Copied("links", "path string, pos int, relationship string, raw string", _LINKS)
CLASSES = fx.Rows("classes", "class string, path string", [(c, f"{c}.ont.yml") for c in ("appropriation", "expenditure", "line-item", "fiscal-period", "agency")])
CLASS_PROPS = fx.Copied("class_props", "class string, name string", [("appropriation", "amount"), ("appropriation", "cost_delta"), ("line-item", "current_code"), ("line-item", "agency_code"), ("expenditure", "basis")])
CLASS_EDGES = fx.Rows("class_edges", "class string, relationship string, target string, direction string, expected boolean", [
    ("appropriation", "grants-authority-for", "line-item", "out", False), ("appropriation", "in-period", "fiscal-period", "out", False), ("expenditure", "disburses-against", "line-item", "out", False), ("expenditure", "in-period", "fiscal-period", "out", False),
    ("line-item", "grants-authority-for", "appropriation", "in", True), ("line-item", "belongs-to", "agency", "out", False), ("agency", "succeeds", "agency", "out", False),
])
CATALOG = fx.Copied("catalog", "path string, file_slug string, slug string, parse_error string, feeds string", [("catalog/lsc-@.md", "lsc-@", "lsc-@", None, "line-item,ghost"), ("catalog/obm-@.md", "obm-@", "omb-@", None, ""), ("catalog/bad-@.md", "bad-@", None, "no frontmatter", None)])
DECISIONS = fx.Copied("decisions", "path string, keys string", [("decisions/@-1.yml", "id,summary,decision"), ("decisions/@-2.yml", "id,notes"), ("decisions/@-3.yml", "")])
ALL = [NODES, PROPS, LINKS, CLASSES, CLASS_PROPS, CLASS_EDGES, CATALOG, DECISIONS]
#: The same links with their targets worked out by another library, for the oracle.
DST = fx.Copied("full_links", "path string, pos int, relationship string, raw string, dst string", [(*x, posixpath.normpath(posixpath.join(posixpath.dirname(x[0]), x[3]))) for x in _LINKS])


def v_rules(spark, sf_dir):
    return graph.findings(*[x.frame(spark, sf_dir) for x in ALL])


def j22(spark, sf_dir):
    return graph.link_targets(LINKS.frame(spark, sf_dir), NODES.frame(spark, sf_dir), CLASSES.frame(spark, sf_dir), CATALOG.frame(spark, sf_dir))


def tables_graph(spark, sf_dir: str):
    """Region, nation, customer and supplier as nodes; a negative balance links to a nation that is not there."""
    node = lambda df, kind, key: df.select(F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"), F.lit(".yml")).alias("path"), F.lit(kind).alias("class"))
    t = {x: table(spark, sf_dir, x) for x in ("region", "nation", "customer", "supplier")}
    nodes = node(t["region"], "region", "r_regionkey").unionByName(node(t["nation"], "nation", "n_nationkey")).unionByName(node(t["customer"], "customer", "c_custkey")).unionByName(node(t["supplier"], "supplier", "s_suppkey"))

    def link(df, kind, key, target, to, bad=None):
        goal = F.col(to) if bad is None else F.when(F.col(bad) < 0, F.col(to) + 100).otherwise(F.col(to))
        return df.select(F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"), F.lit(".yml")).alias("path"), F.lit(0).alias("pos"), F.lit("belongs-to").alias("relationship"), F.concat(F.lit(f"../{target}/"), goal.cast("string"), F.lit(".yml")).alias("raw"))

    links = link(t["nation"], "nation", "n_nationkey", "region", "n_regionkey").unionByName(link(t["customer"], "customer", "c_custkey", "nation", "c_nationkey", "c_acctbal")).unionByName(link(t["supplier"], "supplier", "s_suppkey", "nation", "s_nationkey", "s_acctbal"))
    return nodes, links


def j23(spark, sf_dir):
    nodes, links = tables_graph(spark, sf_dir)
    return graph.backlinks(links, nodes)


def j26(spark, sf_dir):
    nodes, links = tables_graph(spark, sf_dir)
    return graph.resolved(links).join(nodes.select(F.col("path").alias("dst")), "dst", "left_anti").select("path", "dst")


QUERIES = {"v_rules": v_rules, "j22_link_resolution": j22, "j23_backlinks": j23, "j26_broken_links": j26, "a29_findings_by_severity": lambda s, d: v_rules(s, d).groupBy("severity").agg(F.sum("n").alias("findings"))}

_FIX = ", ".join(x.sql() for x in [*ALL, DST])
_in = lambda xs: ", ".join("'" + x + "'" for x in xs)
_like = lambda col, xs: "(" + " OR ".join(f"contains({col}, '{x}')" for x in xs) + ")"
_RULES = f"""WITH {_FIX}, live AS (SELECT nodes.*, concat_ws(' ', label, description) AS body FROM nodes WHERE class IN (SELECT class FROM classes)),
l AS (SELECT *, CASE WHEN dst LIKE '%.ont.yml' THEN replace(dst, '.ont.yml', '') ELSE split_part(dst, '/', 1) END AS dc FROM full_links), ol AS (SELECT l.*, class FROM l JOIN live USING (path)),
dom AS (SELECT * FROM ol WHERE relationship NOT IN ('instance-of', 'cites') AND dst NOT LIKE 'catalog/%'), place AS (SELECT path FROM nodes UNION ALL SELECT path FROM classes),
pr AS (SELECT props.*, class, body FROM props JOIN live USING (path)), tx AS (SELECT live.path, body, string_agg(text, chr(10)) FILTER (kind = 'text') AS t FROM live LEFT JOIN props USING (path) GROUP BY ALL), sd AS (SELECT *, lower(concat_ws(chr(10), body, t)) AS s FROM tx),
pointed AS (SELECT DISTINCT dst FROM l WHERE relationship NOT IN ('instance-of', 'cites')),
sub AS (SELECT a.path, a.dst AS item, b.dst AS period FROM l a JOIN l b ON a.path = b.path AND b.relationship = 'in-period' WHERE a.relationship IN ('grants-authority-for', 'disburses-against')),
f AS (SELECT path, 'decision-key-outside-schema' AS rule, 'error' AS severity FROM decisions WHERE len(list_filter(string_split(keys, ','), lambda x: x <> '' AND x NOT IN ({_in(graph.DECISION_FIELDS)}))) > 0
UNION ALL SELECT path, 'bad-catalog-frontmatter', 'error' FROM catalog WHERE parse_error IS NOT NULL UNION ALL SELECT path, 'catalog-slug-mismatch', 'error' FROM catalog WHERE parse_error IS NULL AND slug <> file_slug
UNION ALL SELECT path, 'catalog-unknown-feed', 'error' FROM (SELECT path, unnest(string_split(feeds, ',')) AS c FROM catalog WHERE parse_error IS NULL) WHERE c <> '' AND c NOT IN (SELECT class FROM classes)
UNION ALL SELECT path, 'unknown-class', 'error' FROM nodes WHERE class NOT IN (SELECT class FROM classes) UNION ALL SELECT path, 'class-directory-mismatch', 'error' FROM live WHERE split_part(path, '/', 1) <> class
UNION ALL SELECT path, 'undeclared-property', 'error' FROM pr WHERE NOT EXISTS (SELECT 1 FROM class_props c WHERE c.class = pr.class AND c.name = pr.key)
UNION ALL SELECT path, 'claim-tag-in-identifier', 'error' FROM pr WHERE key IN ({_in(graph.IDENTIFIER_KEYS)}) AND kind = 'text' AND {_like('text', graph.TAGS)} AND NOT starts_with(ltrim(text), '[open]')
UNION ALL SELECT path, 'float-money', 'error' FROM pr WHERE {_like('key', graph.MONEY_WORDS)} AND kind = 'float'
UNION ALL SELECT path, 'body-contradicts-filled-property', 'error' FROM pr WHERE {_like('key', graph.MONEY_WORDS)} AND kind = 'text' AND NOT starts_with(ltrim(text), '[open]') AND {_like('lower(body)', graph.UNFILLED)}
UNION ALL SELECT DISTINCT live.path, 'stale-no-outturn-claim', 'error' FROM live JOIN sub USING (path) JOIN sub o ON o.item = sub.item AND o.period = sub.period AND o.path <> sub.path JOIN nodes n ON n.path = o.path AND n.class = 'expenditure' WHERE {_like('lower(body)', graph.NO_OUTTURN)}
UNION ALL SELECT path, 'stale-not-catalogued-claim', 'error' FROM (SELECT path, unnest(regexp_extract_all(s, '{graph.NAMED_CLAIM}', 1)) AS slug FROM sd) WHERE slug IN (SELECT slug FROM catalog WHERE parse_error IS NULL)
UNION ALL SELECT path, 'unnamed-not-catalogued-claim', 'warn' FROM (SELECT path, unnest(range(len(regexp_extract_all(s, '{graph.ANY_CLAIM}')) - len(regexp_extract_all(s, '{graph.NAMED_CLAIM}')))) FROM sd)
UNION ALL SELECT path, 'bad-instance-of', 'error' FROM ol WHERE relationship = 'instance-of' AND NOT (dst LIKE '%.ont.yml' AND dc = class) UNION ALL SELECT path, 'bad-catalog-relationship', 'error' FROM ol WHERE dst LIKE 'catalog/%' AND relationship NOT IN ('cites', 'instance-of')
UNION ALL SELECT path, 'broken-link', 'error' FROM ol WHERE relationship = 'cites' AND dst NOT IN (SELECT path FROM catalog) UNION ALL SELECT path, 'broken-link', 'error' FROM dom WHERE dst NOT IN (SELECT path FROM place)
UNION ALL SELECT path, 'undeclared-relationship', 'error' FROM dom WHERE dst IN (SELECT path FROM place) AND NOT EXISTS (SELECT 1 FROM class_edges e WHERE e.direction = 'out' AND e.class = dom.class AND e.relationship = dom.relationship AND e.target = dom.dc)
UNION ALL SELECT path, 'missing-instance-of', 'error' FROM live WHERE path NOT IN (SELECT path FROM full_links WHERE relationship = 'instance-of')
UNION ALL SELECT path, 'no-domain-link', 'warn' FROM live WHERE path NOT IN (SELECT path FROM dom) AND class IN (SELECT class FROM class_edges WHERE direction = 'out') AND path NOT IN (SELECT dst FROM pointed)
UNION ALL SELECT path, 'orphan-in', 'warn' FROM live WHERE class IN (SELECT class FROM class_edges WHERE direction = 'in' AND expected) AND path NOT IN (SELECT dst FROM pointed)
UNION ALL SELECT path, 'verified-without-source', 'error' FROM live WHERE contains(body, '[verified]') AND path NOT IN (SELECT path FROM full_links WHERE relationship = 'cites')
UNION ALL SELECT path, 'fixture-data-in-corpus', 'error' FROM sd WHERE contains(body, 'synthetic-fixture') OR contains(coalesce(t, ''), 'synthetic-fixture')
UNION ALL SELECT path, 'unknown-claim-tag', 'warn' FROM (SELECT path, unnest(regexp_extract_all(regexp_replace(body, '[→=>-]\\[[^]]*\\]|\\[[^]]*\\][(→-]', '', 'g'), '\\[[a-z -]{{1,12}}\\]')) AS token FROM live) WHERE token NOT IN ('[verified]', '[inference]', '[open]', '[ ]', '[x]'))"""
_BULK = """n AS (SELECT 'region/' || r_regionkey || '.yml' AS path, 'region' AS class FROM region UNION ALL SELECT 'nation/' || n_nationkey || '.yml', 'nation' FROM nation UNION ALL SELECT 'customer/' || c_custkey || '.yml', 'customer' FROM customer UNION ALL SELECT 'supplier/' || s_suppkey || '.yml', 'supplier' FROM supplier),
e AS (SELECT 'nation/' || n_nationkey || '.yml' AS path, 'region/' || n_regionkey || '.yml' AS dst FROM nation UNION ALL SELECT 'customer/' || c_custkey || '.yml', 'nation/' || (c_nationkey + CASE WHEN c_acctbal < 0 THEN 100 ELSE 0 END) || '.yml' FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey || '.yml', 'nation/' || (s_nationkey + CASE WHEN s_acctbal < 0 THEN 100 ELSE 0 END) || '.yml' FROM supplier)"""
ORACLES = {
    "v_rules": f"{_RULES} SELECT path, rule, severity, count(*) AS n FROM f GROUP BY ALL",
    "a29_findings_by_severity": f"{_RULES} SELECT severity, count(*) AS findings FROM f GROUP BY severity",
    "j22_link_resolution": f"WITH {_FIX} SELECT path, pos, relationship, raw, dst, CASE WHEN dst IN (SELECT path FROM nodes) THEN 'node' WHEN dst IN (SELECT path FROM classes) THEN 'class' WHEN dst IN (SELECT path FROM catalog) THEN 'catalog' ELSE 'unresolved' END AS kind FROM full_links",
    "j23_backlinks": f"WITH {_BULK} SELECT e.dst AS path, s.class AS src_class, e.path AS src, 'belongs-to' AS relationship FROM e JOIN n s ON s.path = e.path JOIN n t ON t.path = e.dst",
    "j26_broken_links": f"WITH {_BULK} SELECT path, dst FROM e WHERE dst NOT IN (SELECT path FROM n)",
}
