import zipfile

import pytest

from tallyspark.sources import files, sinks, workbook


def test_corpus_reads_nodes_classes_and_scalar_kinds(spark, tmp_path):
    root = tmp_path / "corpus"
    (root / "line-item").mkdir(parents=True)
    (root / "line-item.ont.yml").write_text("class: line-item\nproperties:\n  - name: amount\n    type: string\nedges:\n  - relationship: belongs-to\n    target: agency\n    direction: out\n    expected: true\n")
    (root / "line-item" / "a.yml").write_text("class: line-item\nlabel: A\nproperties:\n  amount: 5\n  rate: 1.5\n  flag: true\n  code: '200550'\n  word: yes\nlinks:\n  - target: ../agency/x.yml\n    relationship: belongs-to\n")
    (root / "line-item" / "bad.yml").write_text("a: [1,\n")
    rows = {r["path"]: r for r in files.corpus(spark, str(root)).collect()}
    props = rows["line-item/a.yml"]["properties"]
    assert {k: v["kind"] for k, v in props.items()} == {"amount": "int", "rate": "float", "flag": "bool", "code": "text", "word": "text"}
    assert rows["line-item/a.yml"]["links"][0]["relationship"] == "belongs-to"
    assert rows["line-item.ont.yml"]["is_class"] and rows["line-item.ont.yml"]["edges"][0]["expected"]
    assert rows["line-item/bad.yml"]["parse_error"]


def test_catalog_keeps_entries_that_do_not_parse(spark, tmp_path):
    root = tmp_path / "catalog"
    root.mkdir()
    (root / "lsc.md").write_text("---\nslug: lsc\ncontent_committed: true\nfeeds: [line-item]\n---\ntext")
    (root / "plain.md").write_text("no block")
    (root / "README.md").write_text("---\nslug: x\n---\n")
    rows = {r["file_slug"]: r for r in files.catalog(spark, str(root)).collect()}
    assert set(rows) == {"lsc", "plain"}
    assert rows["lsc"]["content_committed"] and rows["lsc"]["feeds"] == ["line-item"]
    assert rows["plain"]["parse_error"] == "no front matter"


def test_delimited_keeps_trailing_cells_and_refuses_odd_lines(spark, tmp_path):
    good, bad = tmp_path / "good.txt", tmp_path / "bad.txt"
    good.write_text("# note\na|b|c\r\n1||\r\n\n2|x|y\r\n")
    bad.write_text("a|b\n1|2|3\n")
    assert [r["cells"] for r in files.delimited(spark, str(good), "|").orderBy("line").collect()] == [["1", "", ""], ["2", "x", "y"]]
    with pytest.raises(Exception, match="number of cells"):
        files.delimited(spark, str(bad), "|").collect()


def test_price_series_skips_missing_values(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("DATE,VALUE\n2020-01-01,1.5\n2020-02-01,.\n2020-03-01,\n2020-04-01,2.5\n")
    rows = sorted((r["month"], r["value"]) for r in files.price_series(spark, str(path), "s").collect())
    assert rows == [(1, 1.5), (4, 2.5)]


def test_feed_round_trip_and_contract(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "slug string, n bigint")
    files.write_feed(str(tmp_path), nodes=rows)
    assert files.feed_section(spark, str(tmp_path), "nodes", "slug string, n bigint").collect() == rows.collect()
    spark.createDataFrame([("2",)], "contract string").write.mode("overwrite").json(f"{tmp_path}/manifest.json")
    with pytest.raises(ValueError, match="contract"):
        files.feed_section(spark, str(tmp_path), "nodes", "slug string")


def _book(path, sheets):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{r + 1}">' + "".join(f'<c r="{chr(65 + k)}{r + 1}"' + (f"><v>{v}</v></c>" if isinstance(v, int | float) else f' t="inlineStr"><is><t>{v}</t></is></c>') for k, v in enumerate(row)) + "</row>" for r, row in enumerate(rows))
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_workbook_cells_sheet_choice_and_header_row(spark, tmp_path):
    spark.dataSource.register(workbook.WorkbookSource)
    _book(tmp_path / "b.xlsx", {"Summary": [["x"]], "EN": [["A title"], ["Agency", "ALI", "FY 2024"], ["", "", ""], ["EDU", "200550", 12]]})
    raw = spark.read.format("workbook").load(str(tmp_path / "*.xlsx"))
    assert {(r["row_idx"], r["text"]) for r in raw.where("sheet = 'EN' and col_idx = 2").collect()} == {(1, "FY 2024"), (3, "12.00")}
    assert workbook.detail_sheet(raw).first()["sheet"] == "EN"
    en = raw.where("sheet = 'EN'")
    assert workbook.header_rows(en).first()["header_row"] == 1
    assert workbook.header_rows(en, legacy=True).first()["header_row"] == 0


def test_workbook_is_told_by_content(tmp_path):
    with pytest.raises(ValueError, match="by content"):
        list(workbook.cells(b"\xd0\xcf\x11\xe0"))


def test_decisions_and_skills_skip_what_does_not_parse(spark, tmp_path):
    (tmp_path / "b.yml").write_text("title: x\nstatus: open\n")
    (tmp_path / "a.yml").write_text("- one\n")
    (tmp_path / "c.yml").write_text("a: [1,\n")
    assert [(r["path"], r["keys"]) for r in files.decisions(spark, str(tmp_path)).collect()] == [("a.yml", []), ("b.yml", ["title", "status"])]
    (tmp_path / "one.md").write_text("---\nname: n\ndescription: d e\n---\nx")
    (tmp_path / "two.md").write_text("---\nname: n\n---\n")
    (tmp_path / "three.md").write_text("---\nname: [\n---\n")
    assert [tuple(r) for r in files.skills(spark, str(tmp_path)).collect()] == [("one.md", "n", "d e")]


def test_fixture_rows_are_found_by_assembly_and_number(spark, tmp_path):
    (tmp_path / "b.yml").write_text("- {bill_number: HB 96, general_assembly: 136th, amount_cents: 5}\n- {bill_number: HB 96, general_assembly: 135th, amount_cents: null}\n")
    (tmp_path / "a.yml").write_text("- {bill_number: HB 1, general_assembly: 136th, amount_cents: 7}\n")
    rows = files.fixture_rows(spark, str(tmp_path), "bill_number string, general_assembly string, amount_cents bigint")
    assert sorted((r["path"], r["bill_number"], r["amount_cents"] or 0) for r in rows.collect()) == [("a.yml", "HB 1", 7), ("b.yml", "HB 96", 0), ("b.yml", "HB 96", 5)]
    assert [r["amount_cents"] for r in files.bill(rows, "136th", "HB 96").collect()] == [5]
    with pytest.raises(NotImplementedError):
        files.http_rows("https://x.example")


def test_rows_and_schemas_round_trip_as_json(spark, tmp_path):
    from pyspark.sql.types import StructType

    rows = spark.createDataFrame([(1, "a", None), (2, None, [3])], "id bigint, name string, many array<int>")
    sinks.emit_rows(rows, f"{tmp_path}/rows")
    sinks.emit_schema(rows, str(tmp_path), "row")
    import json

    schema = StructType.fromJson(json.loads(spark.read.text(f"{tmp_path}/row.schema.json").first()["value"]))
    assert schema == rows.schema and sorted(map(str, spark.read.schema(schema).json(f"{tmp_path}/rows").collect())) == sorted(map(str, rows.collect()))


def test_json_schema_names_every_column(spark, tmp_path):
    import json

    rows = spark.createDataFrame([(1, "a", [1.5], ("x",))], "id bigint not null, name string, many array<double>, own struct<c: string>")
    sinks.emit_json_schema(rows, str(tmp_path), "row")
    schema = json.loads("\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/row.json").collect()))
    assert (schema["title"], schema["type"], schema["required"], schema["additionalProperties"]) == ("row", "object", ["id"], False)
    assert schema["properties"]["id"] == {"type": "integer"} and schema["properties"]["name"] == {"type": ["string", "null"]}
    assert schema["properties"]["many"] == {"type": ["array", "null"], "items": {"type": "number"}}
    assert schema["properties"]["own"]["properties"] == {"c": {"type": ["string", "null"]}}


def test_head_commit_is_null_outside_a_repository(tmp_path):
    assert files.head_commit(str(tmp_path)) is None
