"""Column expressions over headers, labels, codes, paths and veto marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Published spellings of each stage, in stage order.
STAGE_SPELLINGS = {
    "as-introduced": ["as introduced", "introduced", "as filed"],
    "house-substitute": ["house substitute", "substitute house bill", "sub house"],
    "house-reported": ["house reported", "as reported by house finance"],
    "as-passed-house": ["as passed by the house", "as passed house", "house passed"],
    "senate-substitute": ["senate substitute", "sub senate"],
    "senate-reported": ["senate reported", "as reported by senate finance"],
    "as-passed-senate": ["as passed by the senate", "as passed senate", "senate passed"],
    "conference-report": ["conference report", "conference", "as reported by conference committee"],
    "as-enacted": ["as enacted", "enacted", "as signed by the governor", "final", "as enacted after governor s vetoes", "as enacted after governors vetoes"],
    "post-veto": ["post veto", "as vetoed", "after line item veto"],
}
# Headings of the comparison document.
DOCUMENT_SPELLINGS = {
    "as-introduced": ["executive", "executive proposal", "as introduced", "introduced"],
    "as-passed-house": ["as passed by house", "as passed by the house", "house passed"],
    "as-passed-senate": ["as passed by senate", "as passed by the senate", "senate passed"],
    "conference-report": ["conference report", "as reported by conference committee"],
    "as-enacted": ["as enacted", "enacted"],
}
# Headings of the identifying columns.
IDENTITY_SPELLINGS = {
    "agency": ["agency", "agency code", "agy", "cas", "cas code", "agency name"],
    "fund_group": ["fund group", "group"],
    "fund": ["fund", "fund code", "fund number"],
    "line_item_code": ["ali", "ali code", "line item code", "code"],
    "line_item_name": ["ali name", "alititle", "ali title", "line item name", "line item", "title", "name"],
}
# Cells that only repeat an earlier stage.
CONCURRENCES = ["same as the executive", "same as the executive proposal", "same as the house", "same as the senate", "same as the conference report"]


def normalised(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def spelling_table(spark, spellings: dict[str, list[str]], key: str, name: str) -> DataFrame:
    """The fixed spellings as a dimension (key, name) of a few dozen rows."""
    return F.broadcast(spark.createDataFrame([(x, n) for n, xs in spellings.items() for x in xs], f"{key} string, {name} string"))


def fiscal_year_of(header: Column) -> Column:
    """FYnnnn of the first year token of a header, else null."""
    year = F.regexp_extract(normalised(header), r"\bfy ?([0-9]{4})(?![0-9a-z])", 1)
    return F.when(year != "", F.concat(F.lit("FY"), year))


def without_brackets(text: Column) -> Column:
    """The text outside brackets, nested ones included; an unmatched closing one is dropped, an unclosed one takes the rest."""
    state = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(a: Column, c: Column) -> Column:
        depth = F.when(c == "(", a["depth"] + 1).when(c == ")", F.greatest(F.lit(0), a["depth"] - 1)).otherwise(a["depth"])
        plain = (a["depth"] == 0) & ~c.isin("(", ")")
        return F.struct(depth.alias("depth"), F.when(plain, F.concat(a["out"], c)).otherwise(a["out"]).alias("out"))

    return F.aggregate(F.split(text, ""), state, step)["out"]


def label_of(header: Column) -> Column:
    """The normalised header without brackets and year tokens."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalised(without_brackets(header)), r"\bfy ?[0-9]{4}(?![0-9a-z])", " "), " +", " "))


def classified(headers: DataFrame) -> DataFrame:
    """``headers`` with kind, detail and fiscal_year of their ``header``; rules in order, the first that fits."""
    spark = headers.sparkSession
    rows = headers.withColumns({"plain": normalised(F.col("header")), "year": fiscal_year_of(F.col("header")), "label": label_of(F.col("header"))})
    rows = rows.join(spelling_table(spark, IDENTITY_SPELLINGS, "plain", "identity"), "plain", "left").join(spelling_table(spark, STAGE_SPELLINGS, "label", "stage"), "label", "left")
    label, stage = F.col("label"), F.col("stage")
    kind = (
        F.when(F.col("identity").isNotNull(), "identity").when(F.col("year").isNull(), "other").when(label == "", "actual").when(label.contains("change"), "other").when(label.isin("actual", "actuals"), "actual")
        .when(label.startswith("adjusted approp"), "adjusted").when(label.contains("estimate") | label.contains("projected"), "estimate").when(label.isin("appropriation", "appropriations") | stage.isNotNull(), "appropriation")
        .otherwise("unknown_stage")
    )
    rows = rows.withColumn("kind", kind)
    detail = F.when(F.col("kind") == "identity", F.col("identity")).when(F.col("kind") == "appropriation", F.coalesce(stage, F.lit("as-enacted"))).when(F.col("kind").isin("estimate", "unknown_stage"), label)
    return rows.select(*headers.columns, "kind", detail.alias("detail"), F.when(~F.col("kind").isin("identity", "other"), F.col("year")).alias("fiscal_year"))


def joined_path(base: Column, target: Column) -> Column:
    """``target`` resolved against the folder of ``base``; ``.`` and ``..`` are folded, never above the root."""
    parts = F.split(F.concat(F.regexp_replace(base, "[^/]*$", ""), target), "/")
    empty = F.array().cast("array<string>")

    def step(a: Column, p: Column) -> Column:
        return F.when(p.isin("", "."), a).when(p == "..", F.when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)).otherwise(F.array_append(a, p))

    return F.array_join(F.aggregate(parts, empty, step), "/")


def slug_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.yml|\.md)?$", 1)


def target_class(path: Column) -> Column:
    """Class of a link target: X for X.ont.yml, else the parent folder."""
    own = F.regexp_extract(path, r"([^/]+)\.ont\.yml$", 1)
    return F.when(own != "", own).otherwise(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))


def is_concurrence(cell: Column) -> Column:
    """Only "the same as an earlier stage", after an optional (n)."""
    text = F.regexp_replace(F.trim(cell), r"^\([0-9]+\)\s*", "")
    return F.coalesce(F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"\.+$", "")), r"\s+", " ")).isin(*CONCURRENCES), F.lit(False))


VETO = r"(?s)\[\*\*\*VETOED:(.*?)(?:\*\*\*\]|$)"


def veto_split(cell: Column) -> Column:
    """struct(text with the struck words kept, spans, unterminated)."""
    spans = F.transform(F.regexp_extract_all(cell, F.lit(VETO), F.lit(1)), lambda s: F.trim(s))
    closed, opened = F.regexp_count(cell, F.lit(r"\*\*\*\]")), F.regexp_count(cell, F.lit(r"\[\*\*\*VETOED:"))
    text = F.regexp_replace(F.regexp_replace(cell, r"\[\*\*\*VETOED:", ""), r"\*\*\*\]", "")
    return F.struct(text.alias("text"), spans.alias("spans"), (opened > closed).alias("unterminated"))


def provision_code(text: Column) -> Column:
    """struct(code, rest): three to eight capitals and one to four digits at the start, else nulls."""
    pattern = r"(?s)^([A-Z]{3,8}[0-9]{1,4})(?![0-9])(.*)$"
    code = F.regexp_extract(text, pattern, 1)
    return F.struct(F.when(code != "", code).alias("code"), F.when(code != "", F.trim(F.regexp_extract(text, pattern, 2))).alias("rest"))


def title_tokens(text: Column) -> Column:
    """Lower-case tokens of more than two bytes, repeats kept."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: F.octet_length(x) > 2)


def title_overlap(a: Column, b: Column) -> Column:
    """Tokens of ``a`` found in ``b`` over the lists' union; lists, not sets, so repeats count."""
    shared = F.size(F.filter(a, lambda x: F.array_contains(b, x)))
    union = F.size(a) + F.size(b) - shared
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / union)


def claim_tags(text: Column) -> Column:
    """Claim tags in the text, in fixed order."""
    return F.array_compact(F.array(*[F.when(text.contains(f"[{t}]"), F.lit(t)) for t in ("verified", "inference", "open")]))
