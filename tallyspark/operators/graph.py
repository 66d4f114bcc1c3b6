"""The typed link graph: resolution, backlinks, link counts, and the schema rules it must obey.

Frames: nodes (path, class, label, description), props (path, key, kind, text), links (path, pos,
relationship, raw), classes (class, path), class_props (class, name), class_edges (class, relationship,
target, direction, expected), catalog (path, file_slug, slug, parse_error, feeds), decisions (path, keys).
``feeds`` and ``keys`` are comma-separated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import joined_path, target_class

# Names and phrases of the graph's own schema.
INSTANCE_OF, CITES = "instance-of", "cites"
DECISION_FIELDS = ["id", "summary", "corpus_depth", "context", "decision", "rationale"]
IDENTIFIER_KEYS = ["current_code", "agency_code", "fund_number", "fund_code", "identifier", "bill_number", "request_id", "line_item_code"]
MONEY_WORDS = ["amount", "cents", "delta", "dollars", "balance", "cost"]
UNFILLED = ["amount is unfilled", "figure is unfilled", "amount is not yet filled", "amount is still unfilled"]
NO_OUTTURN = [
    "actuals are not carried by any committed source",
    "actual is not carried by any committed source",
    "no committed source carries its actuals",
    "no committed source carries the actuals",
]
FIXTURE = "synthetic-fixture"
TAGS = ["[verified]", "[inference]", "[open]"]
NAMED_CLAIM = r"not (?:yet )?catalogued\s*\(\s*([a-z0-9-]+)\s*\)"
ANY_CLAIM = r"not (?:yet )?catalogued"
TAG_TOKEN = r"(?<![→\-=>])(\[[a-z -]{1,12}\])(?![(→-])"


def resolved(links: DataFrame) -> DataFrame:
    """Links with the path they lead to and its class; the raw target stays."""
    dst = joined_path(F.col("path"), F.col("raw"))
    return links.withColumn("dst", dst).withColumn("dst_class", target_class(F.col("dst")))


def link_targets(links: DataFrame, nodes: DataFrame, classes: DataFrame, catalog: DataFrame) -> DataFrame:
    """What each link resolves to: the first hit of node, class file, catalog entry; else unresolved."""
    known = nodes.select(F.col("path").alias("dst"), F.lit(0).alias("o")).unionByName(classes.select(F.col("path").alias("dst"), F.lit(1).alias("o"))).unionByName(catalog.select(F.col("path").alias("dst"), F.lit(2).alias("o")))
    first = known.groupBy("dst").agg(F.min("o").alias("o"))
    kind = F.when(F.col("o") == 0, "node").when(F.col("o") == 1, "class").when(F.col("o") == 2, "catalog").otherwise("unresolved")
    return resolved(links).join(first, "dst", "left").select("path", "pos", "relationship", "raw", "dst", kind.alias("kind"))


def domain_links(links: DataFrame) -> DataFrame:
    return links.where((F.col("relationship") != INSTANCE_OF) & (F.col("relationship") != CITES))


def backlinks(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Incoming links, one row each: path of the node, class and path of the source, relationship. A hub is many rows, not one."""
    incoming = resolved(links).where(F.col("relationship") != INSTANCE_OF).join(nodes.select("path", F.col("class").alias("src_class")), "path")
    incoming = incoming.select(F.col("dst").alias("path"), "src_class", F.col("path").alias("src"), "relationship")
    return incoming.join(nodes.select("path"), "path", "left_semi")


def _any(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def findings(nodes, props, links, classes, class_props, class_edges, catalog, decisions) -> DataFrame:  # noqa: PLR0913
    """(path, rule, severity, n): one row per rule and path, with the number of findings."""
    out: list[DataFrame] = []

    def add(rows: DataFrame, rule: str, severity: str = "error") -> None:
        out.append(rows.select("path", F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))

    add(decisions.where(F.size(F.array_except(F.filter(F.split("keys", ","), lambda x: x != ""), F.array(*map(F.lit, DECISION_FIELDS)))) > 0), "decision-key-outside-schema")
    good = catalog.where("parse_error is null")
    add(catalog.where("parse_error is not null"), "bad-catalog-frontmatter")
    add(good.where("slug <> file_slug"), "catalog-slug-mismatch")
    feeds = good.select("path", F.explode(F.filter(F.split("feeds", ","), lambda x: x != "")).alias("class"))
    add(feeds.join(classes, "class", "left_anti"), "catalog-unknown-feed")

    add(nodes.join(classes.select("class"), "class", "left_anti"), "unknown-class")
    # Nothing else is asked of a node whose class is unknown.
    live = nodes.join(classes.select("class"), "class", "left_semi")
    body = F.concat_ws(" ", "label", "description")
    live = live.withColumn("body", body)
    add(live.where(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1) != F.col("class")), "class-directory-mismatch")
    own = props.join(live.select("path", "class", "body"), "path")
    add(own.join(class_props.select("class", F.col("name").alias("key")), ["class", "key"], "left_anti"), "undeclared-property")
    tagged = F.col("text").contains("[verified]") | F.col("text").contains("[inference]") | F.col("text").contains("[open]")
    add(own.where(F.col("key").isin(*IDENTIFIER_KEYS) & (F.col("kind") == "text") & tagged & ~F.ltrim("text").startswith("[open]")), "claim-tag-in-identifier")
    money = F.col("key").rlike("|".join(MONEY_WORDS))
    add(own.where(money & (F.col("kind") == "float")), "float-money")
    add(own.where(money & (F.col("kind") == "text") & ~F.ltrim("text").startswith("[open]") & _any(F.lower("body"), UNFILLED)), "body-contradicts-filled-property")

    full = resolved(links)
    subject = full.where("relationship in ('grants-authority-for', 'disburses-against')").groupBy("path").agg(F.max_by("dst", "pos").alias("item"))
    subject = subject.join(full.where("relationship = 'in-period'").groupBy("path").agg(F.max_by("dst", "pos").alias("period")), "path")
    spent = subject.join(nodes.where("class = 'expenditure'").select("path"), "path", "left_semi").select(F.col("path").alias("other"), "item", "period")
    claims = live.where(_any(F.lower("body"), NO_OUTTURN)).join(subject, "path")
    add(claims.join(spent, ["item", "period"]).where("other <> path").select("path").distinct(), "stale-no-outturn-claim")

    texts = props.where("kind = 'text'").groupBy("path").agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("texts"))
    said = live.join(texts, "path", "left").select("path", F.lower(F.concat_ws("\n", "body", "texts")).alias("said"), "body", F.coalesce("texts", F.lit("")).alias("texts"))
    named = said.select("path", F.explode(F.regexp_extract_all("said", F.lit(NAMED_CLAIM), F.lit(1))).alias("slug"))
    add(named.join(good.select("slug"), "slug", "left_semi"), "stale-not-catalogued-claim")
    unnamed = F.regexp_count("said", F.lit(ANY_CLAIM)) - F.regexp_count("said", F.lit(NAMED_CLAIM))
    add(said.where(unnamed > 0).select("path", F.explode(F.sequence(F.lit(1), unnamed)).alias("_i")), "unnamed-not-catalogued-claim", "warn")

    own_links = full.join(live.select("path", "class"), "path")
    typed = own_links.where(F.col("relationship") == INSTANCE_OF)
    add(typed.where(~(F.col("dst").endswith(".ont.yml") & (F.col("dst_class") == F.col("class")))), "bad-instance-of")
    to_catalog = F.regexp_extract("dst", r"([^/]+)/[^/]+$", 1) == "catalog"
    rest = own_links.where(F.col("relationship") != INSTANCE_OF)
    add(rest.where(to_catalog & (F.col("relationship") != CITES)), "bad-catalog-relationship")
    cites = rest.where(F.col("relationship") == CITES)
    add(cites.join(catalog.select(F.col("path").alias("dst")), "dst", "left_anti"), "broken-link")
    domain = rest.where((F.col("relationship") != CITES) & ~to_catalog)
    places = nodes.select(F.col("path").alias("dst")).unionByName(classes.select(F.col("path").alias("dst")))
    add(domain.join(places, "dst", "left_anti"), "broken-link")
    outgoing = class_edges.where("direction = 'out'")
    declared = outgoing.select("class", "relationship", F.col("target").alias("dst_class"))
    add(domain.join(places, "dst", "left_semi").join(declared, ["class", "relationship", "dst_class"], "left_anti"), "undeclared-relationship")
    add(live.join(typed, "path", "left_anti"), "missing-instance-of")
    pointed = domain_links(full).select(F.col("dst").alias("path")).distinct()
    lonely = live.join(domain, "path", "left_anti").join(outgoing.select("class"), "class", "left_semi")
    add(lonely.join(pointed, "path", "left_anti"), "no-domain-link", "warn")
    add(live.join(class_edges.where("direction = 'in' and expected").select("class"), "class", "left_semi").join(pointed, "path", "left_anti"), "orphan-in", "warn")
    add(live.where(F.col("body").contains("[verified]")).join(links.where(F.col("relationship") == CITES), "path", "left_anti"), "verified-without-source")
    add(said.where(F.col("body").contains(FIXTURE) | F.col("texts").contains(FIXTURE)), "fixture-data-in-corpus")
    tokens = live.select("path", F.explode(F.regexp_extract_all("body", F.lit(TAG_TOKEN), F.lit(1))).alias("token"))
    add(tokens.where(~F.col("token").isin(*TAGS, "[ ]", "[x]")), "unknown-claim-tag", "warn")

    rows = out[0]
    for one in out[1:]:
        rows = rows.unionByName(one)
    return rows.groupBy("path", "rule", "severity").agg(F.count("*").alias("n"))


def gate(found: DataFrame) -> int:
    """Exit code of the gate: 1 if any finding is an error."""
    return 0 if found.where("severity = 'error'").isEmpty() else 1
