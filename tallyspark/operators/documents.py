"""Positioned text and veto messages: geometry to tables, lines to items, instructions to deletions.

Work that depends on the order inside one page or one item is a fold over that page's sorted array; everything
else is windows, joins and aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.numbers import parse_money_strict

# Phrases of the messages, slips of the source included.
RANGE_OPENERS = ["beginning with", "begging with", "stating with", "starting with"]
RANGE_CONNECTORS = ["and ending with", "or ending with", "and continuing through"]
PAGE_END_CONNECTORS = [
    "and continuing to the bottom of the page",
    "and continuing through the end of the page",
    "and continuing to the end of the page",
    "to the bottom of the page",
    "through the end of the page",
    "to the end of the page",
    "to the end of a page",
]
ROW_TOLERANCE, RIVER_WIDTH, BIN = 0.5, 1.2, 0.1


def page_rows(glyphs: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """Glyphs with the row they stand in: from the top down, a row takes what lies within ``tolerance`` of its first baseline."""
    page = glyphs.groupBy("doc", "page").agg(F.sort_array(F.collect_list(F.struct((-F.col("y")).alias("ny"), "x", "advance", "font_size", "text"))).alias("g"))
    start = F.struct(F.lit(-1).alias("row"), F.lit(None).cast("double").alias("ny"), F.array().cast("array<int>").alias("rows"))

    def step(a: Column, g: Column) -> Column:
        new = a["ny"].isNull() | (F.abs(g["ny"] - a["ny"]) > tolerance)
        row = F.when(new, a["row"] + 1).otherwise(a["row"])
        return F.struct(row.alias("row"), F.when(new, g["ny"]).otherwise(a["ny"]).alias("ny"), F.array_append(a["rows"], row).alias("rows"))

    page = page.withColumn("rows", F.aggregate("g", start, step)["rows"])
    flat = page.select("doc", "page", F.explode(F.arrays_zip("g", "rows")).alias("z"))
    return flat.select("doc", "page", F.col("z.rows").alias("row"), F.col("z.g.x").alias("x"), (-F.col("z.g.ny")).alias("y"), F.col("z.g.advance").alias("advance"), F.col("z.g.font_size").alias("font_size"), F.col("z.g.text").alias("text"))


def rivers(glyphs: DataFrame, width: float = RIVER_WIDTH, bin_size: float = BIN) -> DataFrame:
    """Vertical bands of a page that no glyph touches, as wide as ``width`` of the median font size, margins left out."""
    # A glyph covers whole bins, its end not included; one without width may cover none. Runs are bridged from left to right, so a page's rows are its glyphs, not its bins.
    lo, end = F.floor(F.col("x") / bin_size), F.ceil((F.col("x") + F.col("advance")) / bin_size)
    page = glyphs.groupBy("doc", "page").agg(
        F.min(lo).alias("lo"), F.max(end).alias("hi"), F.sort_array(F.collect_set(F.when(lo < end, F.struct(lo.alias("a"), end.alias("z"))))).alias("covered"), F.sort_array(F.collect_list("font_size")).alias("sizes"),
    )
    page = page.withColumn("median", F.get("sizes", F.floor(F.size("sizes") / 2).cast("int"))).withColumn("median", F.when(F.col("median") <= 0, 1.0).otherwise(F.col("median")))
    gap = lambda a, z: F.struct(a.alias("a"), z.alias("z"))
    start = F.struct(F.col("lo").alias("end"), F.array().cast("array<struct<a:bigint,z:bigint>>").alias("gaps"))

    def step(s: Column, c: Column) -> Column:
        gaps = F.when(c["a"] > s["end"], F.array_append(s["gaps"], gap(s["end"], c["a"]))).otherwise(s["gaps"])
        return F.struct(F.greatest(s["end"], c["z"]).alias("end"), gaps.alias("gaps"))

    last = F.array(F.struct(F.col("hi").alias("a"), F.col("hi").alias("z")))
    runs = page.select("doc", "page", "median", F.explode(F.aggregate(F.concat("covered", last), start, step)["gaps"]).alias("g"))
    return runs.where((F.col("g.z") - F.col("g.a")) * bin_size >= F.col("median") * width).select("doc", "page", F.round(F.col("g.a") * bin_size, 6).alias("left"), F.round(F.col("g.z") * bin_size, 6).alias("right"))


def cells(glyphs: DataFrame, space: float = 0.25) -> DataFrame:
    """doc, page, row, col, text: glyphs laid between the page's rivers, joined with a space where they stand apart."""
    bands = rivers(glyphs).groupBy("doc", "page").agg(F.sort_array(F.collect_list((F.col("left") + F.col("right")) / 2)).alias("rules"))
    placed = page_rows(glyphs).join(bands, ["doc", "page"], "left")
    centre = F.col("x") + F.col("advance") / 2
    placed = placed.withColumn("col", F.size(F.filter(F.coalesce("rules", F.array().cast("array<double>")), lambda r: r <= centre)))
    order = W.partitionBy("doc", "page", "row", "col").orderBy("x")
    gap = F.col("x") - F.lag(F.col("x") + F.col("advance")).over(order)
    placed = placed.withColumn("piece", F.concat(F.when(gap > F.col("font_size") * space, " ").otherwise(""), F.col("text")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "piece"))), lambda p: p["piece"]), "")
    return placed.groupBy("doc", "page", "row", "col").agg(joined.alias("text"))


def carried_rules(pages: DataFrame) -> DataFrame:
    """Each page with the rules of the last page, up to itself, that draws any (doc, page, rules)."""
    order = W.partitionBy("doc").orderBy("page").rowsBetween(W.unboundedPreceding, 0)
    return pages.select("doc", "page", F.last("rules", ignorenulls=True).over(order).alias("rules"))


def running_key(text: Column) -> Column:
    """White space removed, digits masked."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+", ""), "[0-9]", "#")


def running_lines(lines: DataFrame) -> DataFrame:
    """(doc, y, key) of heads and feet: on at least half of the document's pages, and on two (doc, page, y, text)."""
    pages = lines.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    found = lines.groupBy("doc", F.round("y").alias("y"), running_key(F.col("text")).alias("key")).agg(F.count_distinct("page").alias("n"))
    return found.join(pages, "doc").where(F.col("n") >= F.greatest(F.floor(F.col("pages") / 2), F.lit(2))).select("doc", "y", "key", "n")


def without_running_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (doc, page, y, text) without the document's running heads and feet."""
    heads = running_lines(lines).select("doc", F.col("y").alias("_y"), F.col("key").alias("_key"))
    keyed = lines.withColumns({"_y": F.round("y"), "_key": running_key(F.col("text"))})
    return keyed.join(heads, ["doc", "_y", "_key"], "left_anti").select(*lines.columns)


def rule_clusters(marks: DataFrame, tolerance: float) -> DataFrame:
    """doc, page, rule, marks: marks (doc, page, x) from left to right; one joins the rule whose running mean is within ``tolerance``."""
    page = marks.groupBy("doc", "page").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # the marks of one page
    kind = "array<struct<total:double,n:int>>"

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        near = (F.size(a) > 0) & (F.abs(x - F.get(a, F.size(a) - 1)["total"] / F.get(a, F.size(a) - 1)["n"]) <= tolerance)
        grown = F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct((last["total"] + x).alias("total"), (last["n"] + 1).alias("n"))))
        return F.when(near, grown).otherwise(F.concat(a, F.array(F.struct(x.alias("total"), F.lit(1).alias("n")))))

    rules = page.select("doc", "page", F.explode(F.aggregate("xs", F.array().cast(kind), step)).alias("r"))
    return rules.select("doc", "page", (F.col("r.total") / F.col("r.n")).alias("rule"), F.col("r.n").alias("marks"))


def drawn_rules(marks: DataFrame, content: DataFrame, tolerance: float) -> DataFrame:
    """Marks (doc, page, y, ..) that share no baseline, within ``tolerance``, with content of their page (doc, page, y).

    The range condition is an equality on bands as high as the tolerance: near heights lie in the same or an adjacent band.
    """
    band = lambda: F.floor(F.col("y") / tolerance)
    near = content.select("doc", "page", F.col("y").alias("_y"), F.explode(F.array(*[band() + k for k in (-1, 0, 1)])).alias("_band")).distinct()
    keyed = marks.withColumn("_band", band())
    same = [keyed[c] == near[c] for c in ("doc", "page", "_band")]
    return keyed.join(near, [*same, F.abs(F.col("y") - F.col("_y")) <= tolerance], "left_anti").drop("_band")


def entry_starts(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Content rows (doc, page, y) that a drawn rule (doc, page, y) marks: the last one above each rule, rows running down."""
    both = rows.select("doc", "page", "y", F.lit(True).alias("content")).unionByName(rules.select("doc", "page", "y", F.lit(False).alias("content")))
    # Above means a larger y; a row on the rule's own height is not above it, so it sorts behind the rule.
    order = W.partitionBy("doc", "page").orderBy(F.desc("y"), "content").rowsBetween(W.unboundedPreceding, -1)
    above = both.withColumn("above", F.min(F.when(F.col("content"), F.col("y"))).over(order))
    return above.where("not content and above is not null").select("doc", "page", F.col("above").alias("y")).distinct()


def is_running_foot(text: Column) -> Column:
    return F.trim(text).rlike(r"^Page [0-9]+ of [0-9]+$")


def join_lines(lines: Column, soft: bool = True) -> Column:
    """An array of lines as one text; a hyphen at a line's end joins without a space.

    With ``soft`` the hyphen goes where a letter stands before it and a lower-case one begins the next line; without, it always stays.
    """

    def step(a: Column, line: Column) -> Column:
        x = F.trim(line)
        dropped = F.lit(soft) & a.rlike(r"\p{L}-$") & x.rlike(r"^\p{Ll}")
        joined = F.when(dropped, F.concat(F.substring(a, F.lit(1), F.length(a) - 1), x)).when(a.endswith("-") | (a == ""), F.concat(a, x)).otherwise(F.concat(a, F.lit(" "), x))
        return F.when(x == "", a).otherwise(joined)

    return F.aggregate(lines, F.lit(""), step)


def heading(lines: Column, fill: int = 75, most: int = 40) -> Column:
    """struct(title, rejoined): the first line, with the second where the first is full (in bytes) and the second short."""
    first, second = F.trim(F.coalesce(F.get(lines, 0), F.lit(""))), F.trim(F.coalesce(F.get(lines, 1), F.lit("")))
    wraps = (F.octet_length(first) >= fill) & (second != "") & (F.octet_length(second) < most)
    return F.struct(F.when(wraps, F.concat_ws(" ", first, second)).otherwise(first).alias("title"), wraps.alias("rejoined"))


def veto_marker(title: Column) -> Column:
    """struct(status, title): the marker that opens a provision's heading, split off."""
    t = F.trim(title)
    # The markers as printed.
    marker = F.when(t.startswith("**PARTIALLY VETOED**"), "**PARTIALLY VETOED**").when(t.startswith("**VETOED**"), "**VETOED**").otherwise("")
    status = F.when(marker == "", "not_vetoed").when(marker == "**VETOED**", "vetoed").otherwise("partially_vetoed")
    return F.struct(status.alias("status"), F.trim(F.substring(t, F.length(marker) + 1, F.length(t))).alias("title"))


def provision_provenance(provisions: DataFrame) -> DataFrame:
    """code, title and page of a provision, with the reference and the locator that cite it."""
    reference = F.concat(F.lit("provision "), F.coalesce("code", F.concat(F.lit('"'), "title", F.lit('"'))))
    return provisions.withColumns({"document_ref": reference, "locator": F.concat(F.lit("page "), F.col("page").cast("string"))})


def entry_index(entries: DataFrame, *order: str) -> DataFrame:
    """``entries`` with their place, from 0, within (doc, code)."""
    return entries.withColumn("entry_index", F.row_number().over(W.partitionBy("doc", "code").orderBy(*order)) - 1)


def is_header_row(cells: Column, spellings: list[str]) -> Column:
    """At least two cells are filled, and more than half of the filled ones name a stage."""
    filled = F.filter(F.transform(cells, lambda c: F.trim(c)), lambda c: c != "")
    named = F.filter(filled, lambda c: F.regexp_replace(F.lower(c), r"\s+", " ").isin(spellings))
    return (F.size(filled) >= 2) & (F.size(named) * 2 > F.size(filled))


def veto_report(items: DataFrame, deletions: DataFrame) -> DataFrame:
    """Per doc: counts of items (doc, item_number, has_formula) and deletions (doc, item_number, kind, text), what is amiss, and whether nothing is."""
    cut = deletions.groupBy("doc", "item_number").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "unrecognised").alias("unknown"), F.max(F.coalesce(F.contains("text", F.lit("$")), F.lit(False))).alias("money"))
    return _reported(items.join(cut, ["doc", "item_number"], "left"))


def counted_report(items: DataFrame) -> DataFrame:
    """``veto_report`` of items that bring the counts of their own deletions (doc, item_number, has_formula, n, unknown, money); items of one number share them."""
    number = W.partitionBy("doc", "item_number")
    counts = {"n": F.sum("n").over(number), "unknown": F.sum("unknown").over(number), "money": F.max("money").over(number)}
    shared = items.withColumns(counts)
    # An item without a number has no deletions that could be told to be its own.
    known = F.col("item_number").isNotNull()
    return _reported(shared.withColumns({"n": F.when(known & (F.col("n") > 0), F.col("n")), "unknown": F.when(known, F.col("unknown")), "money": known & F.col("money")}))


def _reported(rows: DataFrame) -> DataFrame:
    rows = rows.groupBy("doc").agg(
        F.count("*").alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("deletions"), F.count_if(~F.col("has_formula")).alias("without_formula"), F.count_if(F.col("n").isNull()).alias("without_deletions"),
        F.coalesce(F.sum("unknown"), F.lit(0)).alias("unrecognised"), F.count_if("money").alias("striking_money"), (F.max("item_number") - F.min("item_number") + 1 - F.count_distinct("item_number")).cast("bigint").alias("missing_numbers"),
    )
    return rows.withColumn("is_clean", F.expr("without_formula + without_deletions + unrecognised + missing_numbers = 0"))


def body_font(lines: DataFrame) -> DataFrame:
    """The commonest line size of a document in tenths, the smallest on a tie."""
    sizes = lines.groupBy("doc", F.round(F.col("font_size") * 10).cast("int").alias("tenths")).count()
    return sizes.groupBy("doc").agg((-F.max(F.struct("count", (-F.col("tenths")).alias("t")))["t"] / 10).alias("body_font"))


def segments(lines: DataFrame, starts: Column) -> DataFrame:
    """Lines (doc, line_no, text) numbered by the segment they belong to; 0 is what precedes the first start."""
    return lines.withColumn("segment", F.sum(starts.cast("int")).over(W.partitionBy("doc").orderBy("line_no")))


def veto_items(lines: DataFrame) -> DataFrame:
    """doc, segment, item_number, lines: segments between ITEM NUMBER headings, in order."""
    number = F.regexp_extract(F.trim("text"), r"^ITEM NUMBER\s+([0-9]+)(?:\s|$)", 1)
    rows = segments(lines, number != "").where("segment > 0").withColumn("number", F.when(number != "", number.cast("int")))
    return rows.groupBy("doc", "segment").agg(F.max("number").alias("item_number"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", F.trim("text").alias("t")))), lambda x: x["t"]), "\n").alias("lines"))


def missing_numbers(items: DataFrame) -> DataFrame:
    """Item numbers between the smallest and the largest that no item has."""
    span = items.groupBy("doc").agg(F.min("item_number").alias("lo"), F.max("item_number").alias("hi"))
    return span.select("doc", F.explode(F.sequence("lo", "hi")).alias("item_number")).join(items, ["doc", "item_number"], "left_anti")


def _quoted(text: Column) -> Column:
    """struct(text, repaired): what stands between the first opening and the last closing quote, or after or before the only one."""
    inner = F.regexp_extract(text, r'(?s)[“"](.*)[”"]', 1)
    both = text.rlike(r'(?s)[“"].*[”"]')
    after, before = F.regexp_extract(text, r'(?s)[“"](.*)$', 1), F.regexp_extract(text, r'(?s)^(.*)[”"]', 1)
    raw = F.when(both, inner).when(text.rlike('[“"]'), after).when(text.contains("”"), before)
    clean = F.trim(F.when(both, raw).otherwise(F.btrim(raw, F.lit('“”" '))))
    return F.struct(F.when(clean != "", clean).alias("text"), (~both & raw.isNotNull()).alias("repaired"))


def deletions(instructions: DataFrame) -> DataFrame:
    """kind, text, begins, ends, bill_page and quote repair of each ``instruction``."""
    low = F.lower("instruction")
    openers, connectors, ends = ("|".join(x) for x in (RANGE_OPENERS, RANGE_CONNECTORS, PAGE_END_CONNECTORS))
    page = F.regexp_extract("instruction", r"(?i)\bpage\s+[^0-9\s]*([0-9]+)", 1).try_cast("int")
    after = F.when(low.rlike(openers), F.regexp_replace("instruction", f"(?is)^.*?({openers})", ""))
    to_end = F.lower(after).rlike(ends)
    first = _quoted(F.when(to_end, F.regexp_replace(after, f"(?is)({ends}).*$", "")).otherwise(F.regexp_replace(after, f"(?is)({connectors}).*$", "")))
    last = _quoted(F.when(F.lower(after).rlike(connectors), F.regexp_replace(after, f"(?is)^.*?({connectors})", "")))
    whole = _quoted(F.col("instruction"))
    rows = instructions.select("*", page.alias("bill_page"), after.isNotNull().alias("ranged"), to_end.alias("to_end"), first.alias("a"), last.alias("z"), whole.alias("w"))
    known = F.when(F.col("to_end"), F.col("a.text").isNotNull()).otherwise(F.col("a.text").isNotNull() & F.col("z.text").isNotNull())
    kind = F.when(~F.col("ranged"), F.when(F.col("w.text").isNotNull(), "text").otherwise("whole")).when(~known, "unrecognised").when(F.col("to_end"), "range_to_page_end").otherwise("range")
    rows = rows.withColumn("kind", kind)
    ranged = F.col("kind").isin("range", "range_to_page_end")
    return rows.select(
        *instructions.columns, "kind", "bill_page", F.when(F.col("kind") == "text", F.col("w.text")).alias("text"), F.when(ranged, F.col("a.text")).alias("begins"), F.when(F.col("kind") == "range", F.col("z.text")).alias("ends"),
        F.coalesce(F.when(F.col("kind") == "text", F.col("w.repaired")).when(F.col("kind") == "range", F.col("a.repaired") | F.col("z.repaired")).when(ranged, F.col("a.repaired")), F.lit(False)).alias("quotes_repaired"),
    )


def budget_rows(rows: DataFrame) -> DataFrame:
    """Rows (id, cells array) of the budgetary report: skipped without four trailing amounts or a code, a problem where the printed variance is not final minus actual."""
    n = F.size("cells")
    money = F.transform(F.when(n >= 4, F.slice("cells", n - 3, 4)), parse_money_strict)
    rows = rows.withColumn("money", money).withColumn("money", F.when(F.forall("money", lambda c: c.isNotNull()), F.col("money")))
    rows = rows.withColumn("tokens", F.filter(F.split(F.array_join(F.slice("cells", 1, F.greatest(n - 4, F.lit(0))), " "), r"\s+"), lambda t: t != ""))
    is_code = lambda t: t.rlike("^[A-Za-z0-9]{6}$") & t.rlike("[0-9]")
    rows = rows.withColumn("at", F.array_position(F.transform("tokens", is_code), True))
    whole = F.col("money").isNotNull() & (F.col("at") >= 2)
    agrees = F.get("money", 3) == F.get("money", 1) - F.get("money", 2)
    outcome = F.when(F.col("money").isNull(), "skipped").when(~agrees, "problem").when(~whole, "skipped").otherwise("row")
    rows = rows.withColumn("outcome", outcome)
    known = F.col("outcome") == "row"
    at = F.col("at").cast("int")
    return rows.select(
        "id", "outcome", F.when(known, F.array_join(F.slice("tokens", 1, at - 2), " ")).alias("agency"), F.when(known, F.get("tokens", at - 2)).alias("fund"), F.when(known, F.get("tokens", at - 1)).alias("code"),
        F.when(known, F.array_join(F.slice("tokens", at + 1, F.size("tokens")), " ")).alias("name"), *[F.when(known, F.get("money", k)).alias(c) for k, c in enumerate(("original_cents", "final_cents", "actual_cents"))],
        F.when(known, F.get("money", 1) - F.get("money", 2)).alias("unspent_cents"),
    )


def decode_failures(glyphs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pages whose glyphs do not all stand in the page's text (doc, page, text)."""
    own = glyphs.where("trim(text) <> ''").select("doc", "page", F.col("text").alias("glyph"))
    return own.join(texts, ["doc", "page"]).where(~F.contains(F.col("text"), F.col("glyph"))).groupBy("doc", "page").agg(F.count("*").alias("lost"))
