"""Comparison documents: pages of glyphs to ruled lines, lines to provisions and their positions, positions to rows.

A page's columns are those that it draws for itself; a page that draws none takes them from the last one that does, and without
one it is refused by name, never guessed at. Provisions run across pages: what a line belongs to depends on the lines before it. That state is
running sums and last values over the document's lines in order, in three steps that share one shuffle and one sort by document; a task streams
through a document and holds one line's state, and pages of any number spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import text as tx

from . import documents

RULE, ROW_RATIO, SPACE_RATIO, X_TOLERANCE = "|", 0.4, 0.25, 1.0
#: Points by which structural lines are set smaller than the body.
SMALLER = 0.5
MEDIAN = "percentile_disc(0.5) WITHIN GROUP (ORDER BY {} DESC)"  # of an even number the upper one


def _row_tops(ys: Column, tolerance: Column) -> Column:
    """Baselines that begin a row, from the top: a row takes what lies within ``tolerance`` of its first baseline."""
    new = lambda a, y: (F.size(a) == 0) | (F.element_at(a, -1) - y > tolerance)
    return F.aggregate(F.reverse(F.array_sort(F.array_distinct(ys))), F.array().cast("array<double>"), lambda a, y: F.when(new(a, y), F.array_append(a, y)).otherwise(a))


def _clusters(xs: Column, tolerance: float) -> Column:
    """Means of the clusters of ``xs``; one joins a cluster whose running mean is within ``tolerance``."""
    kind = "struct<done:array<double>,total:double,n:int>"

    def step(a: Column, x: Column) -> Column:
        near = (a["n"] > 0) & (F.abs(x - a["total"] / a["n"]) <= tolerance)
        done = F.when(near | (a["n"] == 0), a["done"]).otherwise(F.array_append(a["done"], a["total"] / a["n"]))
        return F.struct(done.alias("done"), (F.when(near, a["total"]).otherwise(0.0) + x).alias("total"), (F.when(near, a["n"]).otherwise(0) + 1).alias("n"))

    start = F.struct(F.array().cast("array<double>").alias("done"), F.lit(0.0).alias("total"), F.lit(0).alias("n")).cast(kind)
    return F.aggregate(F.array_sort(xs), start, step, lambda a: F.when(a["n"] > 0, F.array_append(a["done"], a["total"] / a["n"])).otherwise(a["done"]))


def ruled_pages(glyphs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row a page: doc, page, status (ruled, continued, refused), reason, rules, row tops of its text, drawn rule rows, size.

    ``pages`` (doc, page) may name pages without any glyph, which are refused as scans.
    """
    glyphs = glyphs.where("text <> ''")
    is_rule = F.trim("text") == RULE
    page = glyphs.groupBy("doc", "page").agg(
        F.expr(MEDIAN.format("font_size")).alias("size"), F.collect_set(F.when(~is_rule, F.col("y"))).alias("ys"), F.collect_list(F.when(is_rule, F.struct("y", "x"))).alias("marks"),
    )
    page = page.withColumn("size", F.when(F.col("size") > 0, F.col("size")).otherwise(1.0)).withColumn("tolerance", F.col("size") * ROW_RATIO)
    page = page.withColumn("tops", _row_tops(F.col("ys"), F.col("tolerance"))).withColumn("rule_tops", _row_tops(F.transform("marks", lambda m: m["y"]), F.col("tolerance")))
    # A rule has a baseline of its own; a stroke among words is a word.
    drawn = F.filter("rule_tops", lambda t: ~F.exists("ys", lambda y: F.abs(y - t) <= F.col("tolerance")))
    page = page.withColumn("drawn", drawn)
    top_of = lambda m: F.array_min(F.filter("rule_tops", lambda t: t >= m["y"]))
    own = _clusters(F.transform(F.filter("marks", lambda m: F.array_contains("drawn", top_of(m))), lambda m: m["x"]), X_TOLERANCE)
    usable = (F.size("drawn") > 0) & (F.size("tops") > 0)
    page = page.withColumn("own", F.when(usable, own))
    if pages is not None:
        page = page.join(pages.select("doc", "page").distinct(), ["doc", "page"], "full")
    # The rules of the last page that draws any, as ``documents.carried_rules``, read beside the page's own columns.
    both = page.withColumn("rules", F.last("own", ignorenulls=True).over(W.partitionBy("doc").orderBy("page").rowsBetween(W.unboundedPreceding, 0)))
    empty, blank = F.col("size").isNull(), F.size("tops") == 0
    status = F.when(F.col("own").isNotNull(), "ruled").when(empty | blank | F.col("rules").isNull(), "refused").otherwise("continued")
    reason = F.when(status != "refused", None).when(empty, "no_glyphs").when(F.col("rules").isNull() & (F.size("drawn") == 0), "no_rules").otherwise("no_text")
    return both.select("doc", "page", status.alias("status"), reason.alias("reason"), F.when(status != "refused", F.col("rules")).alias("rules"), "tops", F.when(status == "ruled", F.col("drawn")).otherwise(F.array().cast("array<double>")).alias("drawn"), "size")


def _cell_text(glyphs: Column, gap: Column) -> Column:
    """Glyphs of a row, from left to right, as text; a space where they stand further apart than ``gap``."""

    def piece(g: Column, i: Column) -> Column:
        last = F.get(glyphs, i - 1)
        apart = (i > 0) & (g["x"] - (last["x"] + last["advance"]) > gap) & ~last["text"].endswith(" ")
        return F.when(apart, F.concat(F.lit(" "), g["text"])).otherwise(g["text"])

    return F.trim(F.array_join(F.transform(glyphs, piece), ""))


def ruled_lines(glyphs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """doc, page, line_no, y, cells, starts_entry, font_size and text of every line of every page that is not refused.

    ``pages`` is what ``ruled_pages`` gives, if the caller has it already. A drawn rule marks the last line above it. ``text`` is the line read straight across.
    """
    pages = ruled_pages(glyphs) if pages is None else pages
    pages = pages.where("status <> 'refused'").select("doc", "page", "rules", "tops", F.col("size").alias("page_size"), F.transform("drawn", lambda r: F.array_min(F.filter("tops", lambda t: t > r))).alias("started"))
    words = glyphs.where(f"text <> '' AND trim(text) <> '{RULE}'").join(pages, ["doc", "page"])
    col = F.size(F.filter("rules", lambda r: r <= F.col("x") + F.col("advance") / 2))
    words = words.withColumn("above", F.filter("tops", lambda t: t >= F.col("y"))).withColumns({"top": F.array_min("above"), "line_no": F.size("above") - 1, "col": col})
    # What a line needs of its page is single values: the page's arrays do not travel with every line's words.
    words = words.withColumns({"starts": F.coalesce(F.array_contains("started", F.col("top")), F.lit(False)), "last_col": F.size("rules")})
    glyph = F.struct("x", (-F.col("y")).alias("down"), "advance", "text", "col")
    line = words.groupBy("doc", "page", "top").agg(
        F.array_sort(F.collect_list(glyph)).alias("g"), F.expr(MEDIAN.format("CASE WHEN trim(text) <> '' THEN font_size END")).alias("font_size"),
        *[F.any_value(c).alias(c) for c in ("line_no", "starts", "last_col", "page_size")],
    )
    gap = F.col("page_size") * SPACE_RATIO
    cells = F.transform(F.sequence(F.lit(0), F.col("last_col")), lambda c: _cell_text(F.filter("g", lambda g: g["col"] == c), gap))
    return line.select(
        "doc", "page", "line_no", F.col("top").alias("y"), cells.alias("cells"), F.col("starts").alias("starts_entry"),
        F.when(F.col("font_size") > 0, F.col("font_size")).otherwise(1.0).alias("font_size"), _cell_text(F.col("g"), gap).alias("text"),
    )


def is_blank(cells: Column) -> Column:
    return F.forall(cells, lambda c: F.trim(c) == "")


def _columns_joined(lines: Column, n: Column) -> Column:
    """The cells of ordered lines joined column by column; a hyphen at a line's end joins without a space."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda c: documents.join_lines(F.transform(lines, lambda x: F.coalesce(F.get(x["cells"], c), F.lit(""))), soft=False))


def page_entries(lines: DataFrame) -> DataFrame:
    """doc, page, entry, y, cells: a page's entries from 1; entry 0 is its preamble, which is no entry's text.

    An entry runs from a line that a rule marks to the next one; blank lines add nothing, and an entry of blank lines is none.
    """
    here = W.partitionBy("doc", "page").orderBy("line_no")
    numbered = lines.withColumn("entry", F.sum(F.col("starts_entry").cast("int")).over(here))
    filled = numbered.where(~is_blank(F.col("cells")))
    line = F.struct("line_no", "cells")
    # An entry's place is its first line's, blank or not.
    starts = numbered.groupBy("doc", "page", "entry").agg(F.max("y").alias("y"))
    grouped = filled.groupBy("doc", "page", "entry").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return grouped.join(starts, ["doc", "page", "entry"]).select("doc", "page", "entry", "y", _columns_joined(F.col("lines"), F.size(F.col("lines")[0]["cells"])).alias("cells"))


def running(lines: DataFrame, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """``lines`` with running ``sums`` and the last non-null of ``lasts``, over the document's lines up to the line itself."""
    so_far = W.partitionBy("doc").orderBy("page", "line_no").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumns({**{n: F.sum(c).over(so_far) for n, c in (sums or {}).items()}, **{n: F.last(c, ignorenulls=True).over(so_far) for n, c in (lasts or {}).items()}})


def _stage(label: Column) -> Column:
    """Stage of a column heading, null if it names none; a few dozen fixed spellings."""
    known = [F.lit(x) for stage, names in tx.DOCUMENT_SPELLINGS.items() for name in names for x in (name, stage)]
    return F.element_at(F.create_map(*known), tx.normalised(label))


def document_columns(lines: DataFrame) -> DataFrame:
    """doc, labels, stages: the first line whose filled cells are headings, at least two of them and more than half known."""
    filled = F.filter("cells", lambda c: F.trim(c) != "")
    known = F.size(F.filter(filled, lambda c: _stage(c).isNotNull()))
    found = lines.where((F.size(filled) >= 2) & (known * 2 > F.size(filled)))
    first = found.groupBy("doc").agg(F.min(F.struct("page", "line_no", "cells"))["cells"].alias("cells"))
    return first.select("doc", F.transform("cells", lambda c: F.trim(c)).alias("labels"), F.transform("cells", _stage).alias("stages"))


def content_lines(lines: DataFrame) -> DataFrame:
    """``lines`` that are neither blank nor a running head or foot (same height and words on half of the pages, and on two)."""
    key = F.lower(F.array_join("cells", "\u0001"))

    def pages_of(rows: DataFrame, name: str, *keys: str) -> DataFrame:
        # Distinct pages by rank: the document's lines stay where they are, and no set of pages is held.
        rows = rows.withColumn(name, F.dense_rank().over(W.partitionBy(*keys).orderBy("page")))
        own = W.partitionBy(*keys)
        return rows.withColumn(name, F.max(name).over(own) - F.max(F.col("page").isNull().cast("int")).over(own))

    filled = pages_of(lines, "_pages", "doc").where(~is_blank(F.col("cells")))
    keyed = pages_of(filled.withColumns({"_y": F.round("y"), "_key": documents.running_key(key)}), "_n", "doc", "_y", "_key")
    often = F.col("doc").isNotNull() & F.col("_y").isNotNull() & F.col("_key").isNotNull() & (F.col("_n") >= F.greatest(F.floor(F.col("_pages") / 2), F.lit(2)))
    return keyed.where(~often).select(*lines.columns)


def roles(lines: DataFrame) -> DataFrame:
    """Content lines with what each is and what it belongs to.

    kind: heading (of a provision), citation, section, entry (a line that begins one), text, or null where nothing takes it up.
    provision counts headings from 1; entry counts the document's entries; a tail line, before a provision's first
    entry, belongs to the last entry of the provision before, if that has one.
    """
    content = content_lines(lines)
    body = documents.body_font(lines.where(~is_blank(F.col("cells"))))
    content = content.join(body, "doc")
    small = F.col("font_size") < F.col("body_font") - SMALLER
    code = tx.provision_code(F.trim("text"))
    content = content.withColumns({"small": small, "code": F.when(small, code["code"]), "heading": F.when(small, code["rest"])})
    # Citations follow a heading until the body goes on.
    content = running(content, lasts={"cited": F.when(F.col("code").isNotNull(), True).when(~F.col("small"), False)})
    single = F.size(F.filter("cells", lambda c: F.trim(c) != "")) == 1
    is_section = F.col("small") & F.col("code").isNull() & ~F.coalesce("cited", F.lit(False)) & single
    content = content.withColumn("is_section", is_section)
    headed = F.when(F.col("code").isNotNull(), True).when(F.col("is_section"), False)
    content = running(content, sums={"provision": F.col("code").isNotNull().cast("int")}, lasts={"open": headed, "section": F.when(F.col("is_section"), F.trim("text"))})
    is_open = F.coalesce("open", F.lit(False))
    begins = ~F.col("small") & is_open & F.col("starts_entry")
    content = content.withColumn("begins", begins)
    content = running(content, sums={"entry": F.col("begins").cast("int")}, lasts={"entry_of": F.when(F.col("begins"), F.col("provision"))})
    taken = ~F.col("small") & is_open & (F.col("provision") - F.col("entry_of")).isin(0, 1)
    citation = F.col("small") & F.col("code").isNull() & F.col("cited")
    kind = F.when(F.col("code").isNotNull(), "heading").when(citation, "citation").when(F.col("is_section"), "section").when(F.col("begins"), "entry").when(taken, "text")
    belongs = kind.isin("entry", "text")
    return content.select("doc", "page", "line_no", "cells", "text", kind.alias("kind"), "code", "heading", "section", "provision", F.when(belongs, F.col("entry")).alias("entry"), F.when(belongs, F.col("entry_of")).alias("entry_of"))


def provisions(marked: DataFrame) -> DataFrame:
    """doc, provision, code, title, veto_status, section, page and citations of every provision of ``roles``."""
    own = marked.where("kind IN ('heading', 'citation')")
    veto = documents.veto_marker(F.col("heading"))
    line = F.when(F.col("kind") == "citation", F.struct("page", "line_no", F.trim("text").alias("t")))
    # A heading stands first, so any of its columns is the group's only non-null one.
    only = lambda c: F.max(F.when(F.col("kind") == "heading", c))
    return own.groupBy("doc", "provision").agg(
        F.max("code").alias("code"), only(veto["title"]).alias("title"), only(veto["status"]).alias("veto_status"), only(F.col("section")).alias("section"), only(F.col("page")).alias("page"),
        F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]).alias("citations"),
    )


def positions(marked: DataFrame, columns: DataFrame) -> DataFrame:
    """doc, provision, entry_index, page and cells of every entry, its wrapped lines joined; ``columns`` as ``document_columns`` gives them."""
    own = marked.where("entry IS NOT NULL").join(columns.select("doc", F.size("labels").alias("n")), "doc")
    grouped = own.groupBy("doc", F.col("entry_of").alias("provision"), "entry", "n").agg(F.array_sort(F.collect_list(F.struct("page", "line_no", "cells"))).alias("lines"))
    place = F.row_number().over(W.partitionBy("doc", "provision").orderBy("entry")) - 1
    return grouped.select("doc", "provision", place.alias("entry_index"), F.col("lines")[0]["page"].alias("page"), _columns_joined(F.col("lines"), F.col("n")).alias("cells"))


def unchanged_after_first(cells: Column) -> Column:
    """Every cell after the first is blank or only points to an earlier stage."""
    return F.forall(F.slice(cells, 2, F.size(cells)), lambda c: (F.trim(c) == "") | tx.is_concurrence(c))


def struck(cell: Column) -> Column:
    """struct(text, spans, unterminated): veto annotations taken off a position, the struck words kept in place, white space collapsed."""
    mark = r"(?s)\[\*\*\*VETOED:\s*(.*?)\s*(?:\*\*\*\]|$)"
    text = F.trim(F.regexp_replace(F.regexp_replace(cell, mark, "$1"), r"\s+", " "))
    return F.struct(text.alias("text"), F.regexp_extract_all(cell, F.lit(mark), F.lit(1)).alias("spans"), cell.rlike(r"(?s)\[\*\*\*VETOED:(?!.*\*\*\*\])").alias("unterminated"))


def provision_rows(provisions: DataFrame, positions: DataFrame, columns: DataFrame) -> DataFrame:
    """One row a provision, entry and stage that says something; a column whose heading names no stage is left out, an empty cell too.

    doc, code, title, section, entry_index, stage, position, concurs, vetoed_spans, veto_extent_uncertain, provision_veto, locator, changed (does any later stage say something new).
    """
    joined = positions.join(columns, "doc").join(provisions.drop("citations").withColumnRenamed("page", "provision_page"), ["doc", "provision"])
    cells = joined.select("*", F.posexplode("cells").alias("at", "cell")).withColumn("stage", F.get("stages", F.col("at"))).where("stage IS NOT NULL AND trim(cell) <> ''")
    cells = cells.withColumn("s", struck(F.trim("cell")))
    return cells.select(
        "doc", "code", "title", "section", "entry_index", "stage", F.col("s.text").alias("position"), tx.is_concurrence(F.col("s.text")).alias("concurs"), F.col("s.spans").alias("vetoed_spans"), F.col("s.unterminated").alias("veto_extent_uncertain"),
        F.when(F.col("veto_status") == "vetoed", "vetoed").when(F.col("veto_status") == "partially_vetoed", "partially-vetoed").alias("provision_veto"), F.concat(F.lit("page "), F.col("provision_page")).alias("locator"),
        (~unchanged_after_first(F.col("cells"))).alias("changed"),
    )


def coverage(provisions: DataFrame, positions: DataFrame, columns: DataFrame) -> DataFrame:
    """Per document: provisions, entries, changed entries, filled and empty cells of known stages, headings that name no stage."""
    stages = positions.join(columns, "doc")
    cell = F.filter(F.arrays_zip("cells", "stages"), lambda z: z["stages"].isNotNull())
    filled = F.size(F.filter(cell, lambda z: F.trim(z["cells"]) != ""))
    counts = stages.groupBy("doc").agg(F.count("*").alias("entries"), F.count_if(~unchanged_after_first(F.col("cells"))).alias("changed"), F.sum(filled).alias("filled"), F.sum(F.size(cell) - filled).alias("empty"))
    unmapped = columns.select("doc", F.transform(F.filter(F.arrays_zip("labels", "stages"), lambda z: z["stages"].isNull() & (z["labels"] != "")), lambda z: z["labels"]).alias("unmapped"))
    own = provisions.groupBy("doc").agg(F.count("*").alias("provisions"))
    zero = F.lit(0).cast("bigint")
    return own.join(counts, "doc", "left").join(unmapped, "doc").select("doc", "provisions", *[F.coalesce(c, zero).alias(c) for c in ("entries", "changed", "filled", "empty")], "unmapped")


def position_of(positions: DataFrame, provisions: DataFrame, columns: DataFrame, code: str, stage: str) -> DataFrame:
    """What one stage says on a provision, per entry; null where the stage is no column of the document."""
    found = positions.join(provisions.where(F.col("code") == code).select("doc", "provision", "code"), ["doc", "provision"]).join(columns, "doc")
    at = F.array_position("stages", stage).cast("int")
    return found.select("doc", "code", "entry_index", F.when(at > 0, F.get("cells", at - 1)).alias("position"))
