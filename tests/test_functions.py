from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.functions import numbers, text
from tallyspark.operators import gap

MONEY = [("$1,234.56", 123456), ("(5.10)", -510), ("-5", -500), ("--5", None), (".5", 50), ("5.", 500), ("1.234", None), ("", None), ("$", None), ("n/a", None), ("92233720368547758.08", None)]


def test_money_texts_are_exact_or_refused(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(MONEY)], "i int, t string").select("i", numbers.parse_money(F.col("t")).alias("m"))
    got = {r["i"]: r["m"] for r in rows.collect()}
    assert [got[i]["cents"] for i in range(len(MONEY))] == [c for _, c in MONEY]
    assert got[6]["error"] == "fraction" and got[7]["error"] == "empty" and got[10]["error"] == "overflow"


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-(2**62), 2**62), min_size=20, max_size=40))
def test_format_then_parse_is_the_identity(spark, cents):
    rows = spark.createDataFrame([(c,) for c in cents], "c bigint").select("c", numbers.parse_money(numbers.format_money(F.col("c")))["cents"].alias("back"))
    assert rows.where("back is null or c <> back").isEmpty()


def test_title_overlap_counts_repeats(spark):
    tokens = lambda s: text.title_tokens(F.lit(s))
    got = spark.range(1).select(text.title_overlap(tokens("aid aid to schools"), tokens("aid schools fund")).alias("x"), text.title_overlap(tokens("of"), tokens("aid")).alias("z")).first()
    assert got["x"] == 3 / 3 and got["z"] == 0.0


def _gap(spark, authority, outturn):
    a = spark.createDataFrame(authority, "item string, period string, cents bigint, state string, ord int")
    e = spark.createDataFrame(outturn, "item string, period string, cents bigint, state string, ord int, basis string, is_slice boolean, reversion_cents bigint")
    return {r["item"]: r for r in gap.gap(a, e).collect()}


def test_gap_outcomes(spark):
    closed = lambda item, cents, state="ok", ord=1, basis="actual-closed", part=False: (item, "FY2020", cents, state, ord, basis, part, None)
    auth = lambda item, cents, state="ok", ord=1: (item, "FY2020", cents, state, ord)
    got = _gap(
        spark,
        [auth("pair", 100000), auth("open", None, "open"), auth("slice", 5), auth("both", 99900000), auth("mixed", 5), auth("zero", 0), auth("nothing", 0), auth("bad", None, "bad", 2), auth("bad", None, "open", 3), auth("alone", 7)],
        [closed("pair", 90000), closed("open", 1), closed("slice", 1, part=True), closed("both", 90000, part=True), closed("both", 99900000, ord=2), closed("mixed", 1), closed("mixed", 1, basis="disbursed", ord=2), closed("zero", 11272360872), closed("nothing", 0), closed("bad", 1), closed("none", 1)],
    )
    assert "alone" not in got  # coverage is driven by the outturn
    assert got["pair"]["status"] == "computed" and got["pair"]["variance_cents"] == 10000 and got["pair"]["variance_pct"] == 10.0
    assert (got["open"]["status"], got["open"]["reason_code"]) == ("unavailable", "authority_open")
    assert (got["slice"]["status"], got["slice"]["reason_code"]) == ("refused", "recipient_slice_only")
    assert got["both"]["status"] == "computed" and got["both"]["slices_excluded"] == 1
    assert got["mixed"]["reason_code"] == "mixed_bases" and got["none"]["reason_code"] == "one_side_missing"
    assert got["zero"]["variance_pct"] is None and got["zero"]["anomaly"] and got["nothing"]["anomaly"] is None
    assert got["bad"]["reason_code"] == "authority_unparsed"  # the first offending row decides
