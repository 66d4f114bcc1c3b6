"""Comparison documents, veto messages, page records, lineage and extraction on small inputs worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import comparison, documents, extract, lineage, messages, stages
from tallyspark.sources import files, pages

GLYPHS = "doc string, page int, x double, y double, advance double, font_size double, text string"


def line(page, y, *cells, size=11.0, at=(50.0, 210.0, 410.0)):
    return [("d", page, x, float(y), 5.0 * len(text), size, text) for x, text in zip(at, cells, strict=False) if text]


def rule(page, y):
    return [("d", page, x, float(y), 2.0, 11.0, "|") for x in (200.0, 400.3)]


def book():
    """Four pages: a scan of nothing is named by the caller, page 1 has no rules yet, 2 to 4 run on."""
    out = line(1, 700, "A foreword that nobody reads")
    out += line(2, 760, "Running head 2") + line(2, 740, "Executive", "As Passed by House", "Remarks")
    out += line(2, 720, "Early Years", size=9.0) + line(2, 700, "AGYCD1 ", "**VETOED** First title", size=9.0) + line(2, 690, "R.C. 1.01", size=9.0) + line(2, 680, "R.C. 1.02", "R.C. 1.03", size=9.0)
    out += line(2, 660, "A grant of river-", "Same as the Executive.", "none") + rule(2, 655) + line(2, 640, "side schools", "", "")
    out += line(2, 620, "Second entry", "pays [***VETOED: up to $5 ***]now", "") + rule(2, 615)
    out += line(3, 760, "Running head 3") + line(3, 740, "Executive", "As Passed by House", "Remarks") + line(3, 700, "of the first provision", "and later", "x")
    out += line(3, 680, "AGYCD2 Second title", size=9.0) + line(3, 660, "tail of the second entry", "", "")
    out += line(4, 760, "Running head 4") + line(4, 740, "Executive", "As Passed by House", "Remarks") + line(4, 720, "Third entry", "(1) Same as the House.", "") + rule(4, 715) + line(4, 690, "Later Years", size=9.0) + line(4, 670, "lost text", "", "")
    return out


@pytest.fixture(scope="module")
def printed(spark):
    glyphs = spark.createDataFrame(book(), GLYPHS).repartition(3)
    found = comparison.ruled_pages(glyphs, spark.createDataFrame([("d", 5)], "doc string, page int"))
    return found, comparison.ruled_lines(glyphs, found)


def test_pages_without_rules_take_the_last_ones_or_are_refused(printed):
    got = {r["page"]: (r["status"], r["reason"], len(r["rules"] or [])) for r in printed[0].collect()}
    assert got == {1: ("refused", "no_rules", 0), 2: ("ruled", None, 2), 3: ("continued", None, 2), 4: ("ruled", None, 2), 5: ("refused", "no_glyphs", 0)}


def test_a_stroke_among_words_moves_no_boundary(spark):
    glyphs = spark.createDataFrame(line(1, 700, "word", "and", "more") + rule(1, 690) + [("d", 1, 203.0, 650.0, 2.0, 11.0, "|")] + line(1, 650, "foot"), GLYPHS)
    assert [round(x, 1) for x in comparison.ruled_pages(glyphs).first()["rules"]] == [200.0, 400.3]


def test_a_document_becomes_provisions_and_rows(printed):
    lines = printed[1]
    marked, columns = comparison.roles(lines), comparison.document_columns(lines)
    own, found = comparison.provisions(marked), comparison.positions(marked, columns)
    assert [(r["code"], r["title"], r["veto_status"], r["section"], r["page"], r["citations"]) for r in own.orderBy("provision").collect()] == [
        ("AGYCD1", "First title", "vetoed", "Early Years", 2, ["R.C. 1.01", "R.C. 1.02 R.C. 1.03"]), ("AGYCD2", "Second title", "not_vetoed", "Early Years", 3, []),
    ]
    rows = [(r["code"], r["entry_index"], r["stage"], r["position"], r["concurs"], r["vetoed_spans"], r["changed"]) for r in comparison.provision_rows(own, found, columns).orderBy("code", "entry_index", "stage").collect()]
    assert rows == [
        ("AGYCD1", 0, "as-introduced", "A grant of river-side schools", False, [], True), ("AGYCD1", 0, "as-passed-house", "Same as the Executive.", True, [], True),
        ("AGYCD1", 1, "as-introduced", "Second entry of the first provision tail of the second entry", False, [], True), ("AGYCD1", 1, "as-passed-house", "pays up to $5now and later", False, ["up to $5"], True),
        ("AGYCD2", 0, "as-introduced", "Third entry", False, [], False), ("AGYCD2", 0, "as-passed-house", "(1) Same as the House.", True, [], False),
    ]
    report = comparison.coverage(own, found, columns).first()
    assert (report["provisions"], report["entries"], report["changed"], report["filled"], report["empty"], report["unmapped"]) == (2, 3, 2, 6, 0, ["Remarks"])
    assert comparison.position_of(found, own, columns, "AGYCD2", "as-enacted").first()["position"] is None


def test_running_state_shares_one_shuffle_by_document(spark, printed):
    plan = comparison.provisions(comparison.roles(printed[1]))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan


def block(spark, *lines):
    r = spark.createDataFrame([(list(lines),)], "lines array<string>").select(messages.deletion_block(F.col("lines")).alias("b")).first()["b"]
    return r["instructions"], r["after"]


def test_instructions_end_when_they_are_complete(spark):
    assert block(spark, "On  page 3, delete the text beginning with “a", "", "b...” and ending with", "“c”.", "Heading", "reason") == (["On page 3, delete the text beginning with “a b...” and ending with “c”."], 4)
    # An ellipsis ends nothing, and a range that is not closed neither.
    assert block(spark, "On page 3, starting with “a.”", "to the end of the page.", "Heading") == (["On page 3, starting with “a.” to the end of the page."], 2)
    assert block(spark, "On page 4, delete x...", "On page 5, delete the ter-", "race.", "Title") == (["On page 4, delete x...", "On page 5, delete the terrace."], 3)
    assert block(spark, "Heading", "On page 9, delete.") == ([], 0)
    assert block(spark) == ([], 0)


def test_an_embedded_instruction_keeps_its_own_page(spark):
    assert block(spark, "On page 1, delete “x,” On page 20, delete “says on page 3” .") == (["On page 1, delete “x,”", "On page 20, delete “says on page 3” ."], 1)


def test_a_message_loses_its_feet_and_keeps_its_reason(spark):
    text = ["To the House", "ITEM NUMBER 4", "On page 1, delete “a”", "Page 1 of 2", "A heading", "This is un-", "wise. It IS in the public interest.", "ITEM NUMBER 6", "Another heading"]
    rows = messages.message_items(spark.createDataFrame([("m", i, t) for i, t in enumerate(text)], "doc string, line_no int, text string"))
    assert [tuple(r)[2:] for r in rows.orderBy("segment").collect()] == [(4, ["On page 1, delete “a”"], "A heading", False, "This is unwise. It IS in the public interest.", True), (6, [], "Another heading", False, "", False)]
    report = messages.message_report(rows).first()
    assert (report["items"], report["deletions"], report["without_formula"], report["without_deletions"], report["missing_numbers"], report["is_clean"]) == (2, 1, 1, 1, 1, False)


def test_a_broken_page_is_one_error_row(spark, tmp_path):
    words = [{"x": 50.0 + 100 * c, "y": 700.0 - 20 * r, "advance": 30.0, "font_size": 10.0, "text": f"r{r}c{c}"} for r in range(2) for c in range(2)]
    record = lambda page, glyphs: json.dumps({"page": page, "glyphs": glyphs})
    (tmp_path / "bill.jsonl").write_text("\n".join([record(1, words), record(2, words[:2]), record(3, words)[:60], record(4, []), "", record(5, [{"x": 1.0}]), json.dumps({"glyphs": words})]))
    found = pages.read_pages(spark, str(tmp_path))
    assert sorted((r["doc"], str(r["page"]), r["error"]) for r in found.where("error is not null").collect()) == [("bill", "4", "no_glyphs"), ("bill", "5", "bad_glyph"), ("bill", "None", "no_page"), ("bill", "None", "unreadable")]
    tables = pages.page_tables(found)
    assert sorted(tuple(r)[1:5] for r in tables.where("error is null").collect()) == [(1, r, c, f"r{r}c{c}") for r in range(2) for c in range(2)]
    assert [(r["page"], r["error"]) for r in tables.where("error = 'too_few_rows'").collect()] == [(2, "too_few_rows")]
    assert pages.page_dump(pages.page_glyphs(found)).where("page = 1").first()["dump"] == "r0c0 r0c1\nr1c0 r1c1"


def test_decision_records_skip_files_of_another_shape(spark, tmp_path):
    whole = "id: a\nsummary: s\ncontext: c\ndecision: d\nrationale: r\n"
    for name, text in {"a.yml": whole, "b.yml": whole + "corpus_depth: 3\n", "list.yml": "- x\n- y\n", "broken.yml": "a: [", "short.yml": "id: a\nsummary: s\n", "minus.yml": whole + "corpus_depth: -1\n"}.items():
        (tmp_path / name).write_text(text)
    rows = {r["path"]: r for r in files.decision_records(spark, str(tmp_path)).collect()}
    assert {p for p, r in rows.items() if r["skipped"] is None} == {"a.yml", "b.yml"}
    assert (rows["a.yml"]["corpus_depth"], rows["b.yml"]["corpus_depth"], rows["b.yml"]["rationale"]) == (None, 3, "r")
    assert rows["short.yml"]["skipped"] == "ValueError: context is missing or of another type"


def test_a_token_of_every_title_joins_nothing_by_itself(spark):
    names = [f"fund {k:05d}a {k:05d}b {k:05d}c" for k in range(3000)] + ["fund 00007a 00007b other"]
    items = spark.createDataFrame([(n, n, "retired", "A", None, None) for n in names], "item string, name string, status string, agency string, first_period string, last_period string")
    items = items.withColumn("tokens", lineage.title_tokens(F.col("name")))
    pairs = lineage.similar_titles(items, items, 0.375).where("pred <> succ").collect()
    assert {tuple(r) for r in pairs} == {(names[7], names[-1]), (names[-1], names[7])}
    links, stated = spark.createDataFrame([("A", "B")], "old string, new string").repartition(2), spark.createDataFrame([(names[0], names[1])], "pred string, succ string").repartition(2)
    plan = lineage.propose(items.drop("tokens").repartition(2), links, stated)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_every_cell_of_a_single_stage_table_is_accounted_for(spark):
    headers = spark.createDataFrame([("t", i, h) for i, h in enumerate(["AGY", "Code", "Title", "FY 2024", "fy2025"])] + [("u", 0, "Agency"), ("u", 1, "FY 2024")], "doc string, col_idx int, header string")
    columns = extract.map_columns(headers)
    assert {r["doc"]: r["refused"] for r in columns.collect()} == {"t": None, "u": "no_code"}
    rows = spark.createDataFrame([("t", 0, ["A", "1", "x", "5.00", "-"]), ("t", 1, ["A", "2", "y", "", "about 5"]), ("u", 0, ["A", "5.00"])], "doc string, row_idx int, cells array<string>")
    outcomes = extract.single_stage(rows, columns)
    assert sorted((r["code"], r["fiscal_year"], r["outcome"], r["amount_cents"], r["fund"]) for r in outcomes.collect()) == [("1", "FY2024", "row", 500, "[open]"), ("1", "FY2025", "blank", None, "[open]"), ("2", "FY2024", "blank", None, "[open]"), ("2", "FY2025", "unparsed", None, "[open]")]
    assert tuple(extract.stage_coverage(outcomes).first()) == ("t", 1, 2, 1, 4)


def test_header_rows_ignore_blanks_around_names(spark):
    rows = spark.createDataFrame([(["  Executive ", " As Passed by House", "1x"],)], "cells array<string>")
    assert rows.select(documents.is_header_row(F.col("cells"), ["executive", "as passed by house"]).alias("h")).first()["h"]


def test_rivers_bridge_runs_of_glyphs(spark):
    """As bin by bin, with glyphs without width on and between bins, a page of one glyph, and nothing joined or laid out in bins."""
    glyphs = [("d", 1, 0.0, 5.0, 30.0, 10.0, "a"), ("d", 1, 100.0, 5.0, 20.0, 10.0, "b"), ("d", 1, 110.0, 4.0, 50.0, 10.0, "c"), ("d", 1, 50.0, 5.0, 0.0, 10.0, ""), ("d", 1, 200.5, 3.0, 0.0, 10.0, "e")]
    glyphs += [("d", 2, 1.0, 1.0, 3.0, 10.0, "x"), ("d", 3, 7.0, 1.0, 0.0, 10.0, "y")]
    found = documents.rivers(spark.createDataFrame(glyphs, GLYPHS), bin_size=1.0)
    free = set(range(0, 201)) - set(range(0, 30)) - set(range(100, 160)) - {200}
    runs = sorted((a, min(b for b in range(a, 202) if b not in free)) for a in free if a - 1 not in free)
    assert sorted((r["page"], r["left"], r["right"]) for r in found.collect()) == [(1, float(a), float(z)) for a, z in runs] == [(1, 30.0, 100.0), (1, 160.0, 200.0)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_records_without_a_page_are_one_row_an_error(spark):
    lines = spark.createDataFrame([("{broken 1", "/p/a.jsonl"), ("{broken 2", "/p/a.jsonl"), ("{broken", "/p/b.jsonl")], "value string, file string")
    tables = pages.page_tables(pages.parse_pages(lines))
    assert sorted((r["doc"], r["page"], r["error"]) for r in tables.collect()) == [("a", None, "unreadable"), ("b", None, "unreadable")]


def test_slices_sum_names_before_they_meet(spark):
    """As all pairs by the rule, with copies, longer and shorter names, one word, administrative ones, missing money and agencies."""
    names = ["School Fund", "School Fund A", " school fund a Extra", "School Fund A Audit", "Scholarships", "Scholarships Old", "School Fun", "School Fund  A", "Ärzte Fund Ö", "ärzte fund ö 2", None]
    rows = [(k % 3 if k % 17 else None, k, names[k % 11], None if k % 5 == 0 else k * 3 - 50) for k in range(120)]
    frame = spark.createDataFrame(rows, "agency int, code int, name string, cents bigint")
    a, b = (frame.select(*[F.col(c).alias(f"{c}{i}") for c in frame.columns]) for i in (1, 2))
    pairs = a.join(b, (F.col("agency1") == F.col("agency2")) & (F.col("code1") != F.col("code2"))).where(lineage.is_namesake(F.col("name1"), F.col("name2")) & ~lineage.is_administrative(F.col("name2")))
    want = pairs.groupBy("agency1", "code1", "name1", "cents1").agg(F.count("*").alias("n"), F.sum("cents2").alias("c")).collect()
    got = lineage.slices(frame).select("agency", "code", "name", "own_cents", "siblings", "sibling_cents").collect()
    assert len(want) > 60 and sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))
    # Of many copies of one name no two are paired: rows between the operators stay in proportion.
    many = lineage.slices(spark.range(30_000).select(F.lit(1).alias("agency"), F.col("id").alias("code"), F.lit("School Fund One").alias("name"), F.lit(1).cast("bigint").alias("cents")))
    assert many.agg(F.count("*"), F.min("siblings"), F.max("sibling_cents")).first() == (30_000, 29_999, 29_999)
    plan = str(many._jdf.queryExecution().optimizedPlan())
    assert "code2" not in plan


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_read_once(spark):
    """Carried rules are read beside a page's own columns, and a page's arrays do not travel with each of its lines."""
    glyphs = spark.createDataFrame(book(), GLYPHS)
    assert "Join" not in plan_of(comparison.ruled_pages(glyphs))
    lines = plan_of(comparison.ruled_lines(glyphs))
    assert "any_value(rules" not in lines and "any_value(tops" not in lines


def test_actions_get_their_texts_behind_the_joins(spark):
    """As with texts on both sides; an action that meets a figure twice counts once, and readings are no second evaluation."""
    moves = spark.createDataFrame([(1, "FY2001", 1, 2, 10, 30, 20, "", 7, 7), (1, "FY2001", 2, 4, 30, 40, 10, "3", 8, 9)], "item int, period string, from_stage int, to_stage int, from_cents bigint, to_cents bigint, delta_cents bigint, skipped string, version int, ref int")
    acts = spark.createDataFrame([(7, 1), (7, 1), (7, 2), (9, 3), (5, 4)], "at int, n int")
    text = lambda rows: rows.withColumns({"action": F.concat(F.lit("a"), "n"), "kind": F.when(F.col("n") == 2, "veto").otherwise("amendment"), "actor": F.concat(F.lit("p"), "n")})
    late = stages.attributed(moves, acts.withColumnRenamed("at", "version"), acts.withColumnRenamed("at", "ref"), text)
    early = stages.attributed(moves, text(acts.withColumnRenamed("at", "version")), text(acts.withColumnRenamed("at", "ref")))
    read = stages.with_readings(late)
    assert plan_of(read).count("Join") == plan_of(late).count("Join")
    assert sorted(map(str, late.collect())) == sorted(map(str, early.collect()))
    assert sorted((r["to_stage"], r["n_actions"], r["first_actor"], r["veto_with_rise"], r["is_complete"]) for r in read.collect()) == [(2, 2, "p1", True, False), (4, 1, "p3", False, False)]


def test_reports_fold_a_message_once(spark):
    """As ``veto_report`` of items and deletions by themselves: items of one number share theirs, one has none, one has no number."""
    kind = "doc int, segment bigint, item_number int, instructions array<string>, has_formula boolean"
    rows = [(1, 1, 5, ["On page 1, delete “a $1”", "On page 2, beginning with “x"], True), (1, 2, 5, [], False), (1, 3, 8, [], True), (2, 1, 3, ["On page 2, delete the whole section."], True), (3, 1, None, [], False)]
    items = spark.createDataFrame(rows, kind)
    report = messages.message_report(items)
    cuts = messages.item_deletions(items).select("doc", "item_number", "kind", F.coalesce("text", "begins").alias("text"))
    want = documents.veto_report(items.select("doc", "item_number", "has_formula"), cuts)
    assert sorted(map(str, report.collect())) == sorted(map(str, want.collect())) and report.columns == want.columns
    assert "Join" not in plan_of(report)


def test_content_lines_stay_with_their_document(spark):
    """Heads on half of the pages and on two go, lines without a height stay, blank pages count; nothing is joined."""
    rows = [("d", p, n, y, [text]) for p in (1, 2, 3, 4) for n, y, text in ((1, 70.2, f"Head {p}"), (2, 60.0, "once" if p == 1 else ""), (3, None, "free"), (4, 50.0, "pair" if p < 3 else "x" * p))]
    rows += [("e", p, 1, 70.0, [f"Head {p}" if p < 3 else " "]) for p in range(1, 8)]
    found = comparison.content_lines(spark.createDataFrame(rows, "doc string, page int, line_no int, y double, cells array<string>"))
    got = sorted((r["doc"], r["page"], r["cells"][0]) for r in found.collect())
    assert got == sorted([("d", 1, "once"), ("d", 3, "xxx"), ("d", 4, "xxxx"), *[("d", p, "free") for p in (1, 2, 3, 4)], ("e", 1, "Head 1"), ("e", 2, "Head 2")])
    assert "Join" not in plan_of(found)


def test_lines_of_an_item_are_sorted_without_a_comparator(spark):
    lines = spark.range(6).selectExpr("1L AS doc", "id AS line_no", "CASE id WHEN 0 THEN 'ITEM NUMBER 4' WHEN 1 THEN 'On page 2, delete “a' WHEN 2 THEN 'Page 1 of 2' WHEN 3 THEN 'b.”' WHEN 4 THEN 'Title' ELSE 'Reason' END AS text")
    items = messages.message_items(lines)
    assert [tuple(r) for r in items.select("item_number", "instructions", "title", "rationale").collect()] == [(4, ["On page 2, delete “a b.”"], "Title", "Reason")]
    assert "array_sort" not in items._jdf.queryExecution().optimizedPlan().toString()
