"""Bills and their versions: slugs, addresses, and versions that are not held yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Endings of ordinals, taken off in this order.
ORDINALS = ["th", "nd", "rd", "st"]


def bill_slug(number: Column) -> Column:
    """``HB 96`` as hb96."""
    return F.lower(F.regexp_replace(number, r"\s", ""))


def corpus_slug(number: Column, assembly: Column) -> Column:
    return F.concat_ws("-", bill_slug(number), assembly)


def version_slug(number: Column, stage: Column) -> Column:
    return F.concat_ws("-", bill_slug(number), stage)


def document_url(base: Column, number: Column, assembly: Column) -> Column:
    """Address of a bill's record: no slash at the base's end, no ordinal ending of the assembly."""
    plain = assembly
    for ending in ORDINALS:
        plain = F.regexp_replace(plain, f"({ending})+$", "")
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/legislation/"), plain, F.lit("/"), bill_slug(number))


def missing_versions(fetched: DataFrame, held: DataFrame) -> DataFrame:
    """(number, stage, slug) of fetched versions whose slug is not held (slug); a proposal, nothing is written."""
    return fetched.withColumn("slug", version_slug(F.col("number"), F.col("stage"))).join(held.select("slug").distinct(), "slug", "left_anti").select("number", "stage", "slug")
