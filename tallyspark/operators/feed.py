"""Views that a published feed is made of: node views, counts, subjects, plot-ready points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.numbers import parse_money, percent
from tallyspark.functions.text import claim_tags, slug_of

from .deflate import deflate
from .graph import INSTANCE_OF

# The only properties that are read as money; codes would parse as well.
MONEY_KEYS = ["amount", "amount_delta", "projected_amount", "reversion", "variance_from_actual"]


def node_views(nodes: DataFrame, links: DataFrame, props: DataFrame) -> DataFrame:
    """Per node: slug, claim tags, whether it is an open question, its domain links and its figures in cents."""
    money = props.where(F.col("key").isin(*MONEY_KEYS) & (F.col("kind") == "text") & ~F.contains(F.col("text"), F.lit("[open]")))
    figures = money.select("path", parse_money(F.col("text"))["cents"].alias("cents")).where("cents is not null").groupBy("path").agg(F.count("*").alias("n_figures"), F.sum("cents").alias("figure_cents"))
    degree = links.where(F.col("relationship") != INSTANCE_OF).groupBy("path").agg(F.count("*").alias("n_links"))
    views = nodes.join(degree, "path", "left").join(figures, "path", "left")
    body = F.concat_ws(" ", "label", "description")
    return views.select(
        "path", "class", slug_of(F.col("path")).alias("slug"), F.array_join(claim_tags(body), ",").alias("claims"), F.coalesce(F.startswith(F.col("label"), F.lit("?")), F.lit(False)).alias("is_question"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_figures", F.lit(0)).alias("n_figures"), "figure_cents",
    )


def class_counts(views: DataFrame, classes: DataFrame) -> DataFrame:
    """Instances of every declared class (0 where there are none), and those that are verified or open."""
    agg = views.groupBy("class").agg(F.count("*").alias("nodes"), F.count_if(F.contains(F.col("claims"), F.lit("verified"))).alias("verified"), F.count_if(F.contains(F.col("claims"), F.lit("open"))).alias("open"))
    return classes.select("class").join(agg, "class", "left").fillna(0, ["nodes", "verified", "open"])


def real_categories(totals: DataFrame, factors: DataFrame, names: list[str]) -> DataFrame:
    """Category totals in base-period cents; null unless every category of the row restates."""
    rows = totals.withColumn("period", F.concat(F.lit("FY"), F.col("year").cast("string"))).join(factors, "period", "left")
    real = [deflate(F.col(n), F.col("factor")) for n in names]
    whole = F.col("factor").isNotNull()
    for n in names:
        whole = whole & F.col(n).isNotNull()
    return rows.select("measure", "year", *[F.when(whole, r).alias(f"real_{n}") for n, r in zip(names, real, strict=True)], whole.alias("is_restated"))


def subjects(gaps: DataFrame, decomposed: DataFrame, related: DataFrame, least_related: int = 4) -> DataFrame:
    """Items worth a page: with computed gaps, stage series, or enough related nodes; the most figures first."""
    figures = gaps.where("status = 'computed'").groupBy("item").agg(F.count("*").alias("n_gaps"))
    series = decomposed.where("n_steps > 0").groupBy("item").agg(F.count("*").alias("n_series"))
    out = figures.join(series, "item", "full_outer").join(related, "item", "full_outer").fillna(0, ["n_gaps", "n_series", "n_related"])
    return out.where((F.col("n_gaps") > 0) | (F.col("n_series") > 0) | (F.col("n_related") >= least_related)).withColumn("figures", F.col("n_gaps") + F.col("n_series"))


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def placed(rows: DataFrame, first: list[str], rest: list[Column]) -> DataFrame:
    """``rows`` with their place, from 1, in the order of the columns ``first`` (downwards with a leading minus), then of ``rest``.

    Rows equal in ``first`` are numbered by themselves; only one row for each of its values meets the others in one order. Null stands before all values.
    """
    names = [c.removeprefix("-") for c in first]
    so_far = W.orderBy(*[F.desc_nulls_last(n) if c != n else F.asc_nulls_first(n) for c, n in zip(first, names, strict=True)]).rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy(*names).agg(F.count("*").alias("_n")).select(*[F.col(n).alias(f"_{n}") for n in names], F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_at", F.row_number().over(W.partitionBy(*names).orderBy(*rest)))
    same = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
    return numbered.join(offsets, same).select(*rows.columns, (F.col("_at") + F.col("_before")).alias("place"))


def change(first: Column, last: Column) -> Column:
    return percent(last - first, first)


def first_decomposition(steps: DataFrame) -> DataFrame:
    """The first step of each (item, period) in feed order: by stage."""
    return steps.groupBy("item", "period").agg(F.min(F.struct("to_stage", "from_stage", "delta_cents")).alias("s")).select("item", "period", "s.*")


def with_decomposition(appropriations: DataFrame, steps: DataFrame) -> DataFrame:
    """Appropriations (item, period, ..) with the first step of their item and period, null where there is none."""
    return appropriations.join(first_decomposition(steps), ["item", "period"], "left")


def largest_movements(steps: DataFrame, n: int = 2) -> DataFrame:
    """The ``n`` largest movements of each (item, period), the earlier stage first of equal ones."""
    order = W.partitionBy("item", "period").orderBy(F.abs("delta_cents").desc(), "to_stage")
    return steps.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("item", "period", "to_stage", "delta_cents", "place")


def enacted_points(points: DataFrame, last_stage: int) -> DataFrame:
    """(item, period, cents) of the figures at the last stage that have an amount."""
    return points.where((F.col("stage") == last_stage) & F.col("cents").isNotNull()).select("item", "period", "cents")


def enacted_by_period(backlinks: DataFrame, appropriations: DataFrame) -> DataFrame:
    """Enacted figures of every line item, through its backlinks: item, period, cents, slug and place (by first year, then slug).

    backlinks: item, class, slug of the nodes that point to it. appropriations: slug, stage, period, cents. A link to a node that does
    not exist gives nothing, nor does a figure without an amount or a period.
    """
    own = backlinks.where("class = 'appropriation'").select("item", "slug").join(appropriations, "slug")
    points = own.where((F.trim("stage") == "as-enacted") & F.col("cents").isNotNull() & (F.trim("period") != "")).select("item", F.trim("period").alias("period"), "cents", "slug")
    year = F.coalesce(F.regexp_extract("period", "([0-9]{4})", 1).try_cast("int"), F.lit(2147483647))
    return points.withColumn("place", F.row_number().over(W.partitionBy("item").orderBy(year, "slug", "cents")))


def related_nodes(backlinks: DataFrame, nodes: DataFrame) -> DataFrame:
    """How many existing nodes of each class point to every item: item, class, nodes, and place (most nodes first, then class).

    Counted before they meet, so that a hub is one row a class; repeated links count again, as the feed lists them.
    """
    found = backlinks.join(nodes.select("class", "slug").distinct(), ["class", "slug"], "left_semi").groupBy("item", "class").agg(F.count("*").alias("nodes"))
    return found.withColumn("place", F.row_number().over(W.partitionBy("item").orderBy(F.desc("nodes"), "class")))


def citing_nodes(links: DataFrame, sources: DataFrame) -> DataFrame:
    """The nodes (class, slug) that cite each parsed source (links: class, slug, kind, target), once each."""
    return links.where("kind = 'catalog'").select("class", "slug", F.col("target").alias("source")).join(sources.where("state = 'parsed'").select("source"), "source", "left_semi").distinct()


def citing_counts(sources: DataFrame, citations: DataFrame) -> DataFrame:
    """(source, nodes): distinct nodes that cite each source, 0 included."""
    counted = citations.groupBy("source").agg(F.count_distinct("node").alias("nodes"))
    return sources.join(counted, "source", "left").fillna(0, ["nodes"])


def node_by_slug(nodes: DataFrame) -> DataFrame:
    """(slug, path, ambiguous): the first node, by path, of each bare slug and whether others have it too."""
    slug = F.regexp_extract("path", r"([^/]+)$", 1)
    return nodes.groupBy(slug.alias("slug")).agg(F.min("path").alias("path"), (F.count("*") > 1).alias("ambiguous"))


def restated_at(periods: DataFrame, series: DataFrame) -> DataFrame:
    """Periods (item, period) with the restated point of the series (item, period, real_cents), null without one."""
    return periods.join(series, ["item", "period"], "left")


def humanised(slug: Column) -> Column:
    """Hyphens as spaces, the first character upper-cased and nothing else."""
    plain = F.replace(slug, F.lit("-"), F.lit(" "))
    return F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, 2147483647))


def first_line(text: Column) -> Column:
    return F.trim(F.get(F.split(F.coalesce(text, F.lit("")), "\n"), 0))


def constant_dollar_label(base: Column, series: Column) -> Column:
    return F.concat(base, F.lit(" dollars ("), series, F.lit(")"))


# How the feed's pages name the stages, and how reports name severities.
STAGE_LABELS = {
    "as-introduced": "As introduced",
    "house-substitute": "House substitute",
    "house-reported": "House reported",
    "as-passed-house": "Passed House",
    "senate-substitute": "Senate substitute",
    "senate-reported": "Senate reported",
    "as-passed-senate": "Passed Senate",
    "conference-report": "Conference report",
    "as-enacted": "As enacted",
    "post-veto": "Post-veto",
}
SEVERITY_LABELS = {"error": "error", "warn": " warn"}


def _labelled(value: Column, labels: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), value), value)


def stage_label(stage: Column) -> Column:
    return _labelled(stage, STAGE_LABELS)


def severity_label(severity: Column) -> Column:
    return _labelled(severity, SEVERITY_LABELS)


def with_item_labels(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` (slug, ..) with the label of the line item of that slug (nodes: class, slug, label), else the slug read as words."""
    own = nodes.where("class = 'line-item'").groupBy("slug").agg(F.min("label").alias("_label"))
    return rows.join(own, "slug", "left").withColumn("label", F.coalesce("_label", humanised(F.col("slug")))).drop("_label")


def node_of(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The node of each (class, slug) of ``wanted``, null fields where there is none; slugs are unique within a class only."""
    return wanted.join(nodes.groupBy("class", "slug").agg(F.min("path").alias("path")), ["class", "slug"], "left")


def related_figures(backlinks: DataFrame, nodes: DataFrame) -> DataFrame:
    """item, related (links to it) and figures (links of existing nodes that carry one; nodes: class, slug, has_figure)."""
    known = nodes.groupBy("class", "slug").agg(F.bool_or("has_figure").alias("has_figure"))
    return backlinks.join(known, ["class", "slug"], "left").groupBy("item").agg(F.count("*").alias("related"), F.count_if(F.coalesce("has_figure", F.lit(False))).alias("figures"))


def series_change(points: DataFrame, start: Column) -> DataFrame:
    """item, first and last period, nominal and real change in percent between them, and whether their signs differ.

    points: item, period, cents, real_cents. Items with a single point, or with nothing at the first one, have no row.
    """
    point = F.struct(start.alias("start"), "period", "cents", "real_cents")
    ends = points.groupBy("item").agg(F.min(point).alias("a"), F.max(point).alias("z"), F.count("*").alias("n")).where("n > 1 AND a.cents <> 0 AND a.real_cents <> 0")
    grown = lambda c: (F.col(f"z.{c}") / F.col(f"a.{c}") - 1) * 100
    rows = ends.select("item", F.col("a.period").alias("from_period"), F.col("z.period").alias("to_period"), grown("cents").alias("nominal_pct"), grown("real_cents").alias("real_pct"))
    return rows.withColumn("reverses_sign", F.signum("nominal_pct") != F.signum("real_pct"))
