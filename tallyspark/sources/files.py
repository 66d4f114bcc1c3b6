"""Text-file sources: corpus and catalog files, delimited tables, price series, feeds.

All of them go through Spark's own readers (so any store that Spark reads works); only YAML values are
parsed in Python, file by file inside tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTRACT_VERSION = "1"
NODE_SCHEMA = (
    "path string, is_class boolean, class string, label string, description string, properties map<string,struct<kind:string,text:string>>,"
    " links array<struct<target:string,relationship:string>>, edges array<struct<relationship:string,target:string,direction:string,expected:boolean>>, keys array<string>, parse_error string"
)


def _scalar(value: str, style: str | None) -> tuple[str, str]:
    """(kind, text) of a plain YAML scalar, tried as bool, int, float, then text; quoted ones are text."""
    if style in ("'", '"', "|", ">"):
        return "text", value
    if value in ("true", "false"):
        return "bool", value
    if re.fullmatch(r"[-+]?(0|[1-9][0-9]*)|0x[0-9a-fA-F]+|0o[0-7]+", value):
        return "int", value
    if re.fullmatch(r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?|[-+]?\.(inf|Inf|INF)|\.(nan|NaN|NAN)", value):
        return "float", value
    return "text", value


def _plain(node):
    """A composed YAML node as dicts, lists and (kind, text) scalars."""
    import yaml

    if isinstance(node, yaml.MappingNode):
        return {k.value: _plain(v) for k, v in node.value}
    if isinstance(node, yaml.SequenceNode):
        return [_plain(v) for v in node.value]
    return None if node.tag.endswith(":null") else _scalar(node.value, node.style)


def _text(x) -> str | None:
    return x[1] if isinstance(x, tuple) else None


def _parse(path: str, text: str) -> dict:
    import yaml

    row: dict = {"path": path, "is_class": path.endswith(".ont.yml"), "class": None, "label": None, "description": None, "properties": None, "links": None, "edges": None, "keys": [], "parse_error": None}
    try:
        node = yaml.compose(text)
        doc = _plain(node) if node is not None else None
    except yaml.YAMLError as e:
        return row | {"parse_error": str(e).splitlines()[0]}
    if not isinstance(doc, dict):
        return row
    props = doc.get("properties")
    pairs = props.items() if isinstance(props, dict) else ((_text(p.get("name")), p.get("type")) for p in props or [] if isinstance(p, dict))
    edge = lambda e: {"relationship": _text(e.get("relationship")), "target": _text(e.get("target")), "direction": _text(e.get("direction")), "expected": _text(e.get("expected")) == "true"}
    return row | {
        "class": _text(doc.get("class")), "label": _text(doc.get("label")), "description": _text(doc.get("description")),
        "properties": {k: {"kind": v[0], "text": v[1]} for k, v in pairs if k and isinstance(v, tuple)},
        "links": [{"target": _text(x.get("target")), "relationship": _text(x.get("relationship"))} for x in doc.get("links") or [] if isinstance(x, dict)],
        "edges": [edge(e) for e in doc.get("edges") or [] if isinstance(e, dict)], "keys": list(doc),
    }


def _frames(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield pd.DataFrame([_parse(p, t) for p, t in zip(part["path"], part["value"], strict=True)], columns=["path", "is_class", "class", "label", "description", "properties", "links", "edges", "keys", "parse_error"])


def whole_files(spark, folder: str, suffix: str) -> DataFrame:
    """path (relative to ``folder``) and value of every file below it."""
    root = folder.rstrip("/")
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(root, wholetext=True)
    name = root.rsplit("/", 1)[-1]
    return files.select(F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), "%20", " "), rf"^.*/\Q{name}\E/", "").alias("path"), "value")


def corpus(spark, folder: str) -> DataFrame:
    """Every .yml below ``folder``: class files (.ont.yml), nodes, decisions; a file that does not parse keeps its error."""
    return whole_files(spark, folder, ".yml").mapInPandas(_frames, NODE_SCHEMA)


def front_matter(text: Column) -> Column:
    """The YAML block that opens a Markdown file, else null."""
    found = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    return F.when(found != "", found)


def catalog(spark, folder: str) -> DataFrame:
    """Markdown entries other than README: fields of their front matter, or the reason why it does not parse."""
    files = whole_files(spark, folder, ".md").where(~F.lower("path").endswith("readme.md")).withColumn("value", front_matter(F.col("value")))
    parsed = files.where("value is not null").mapInPandas(_entries, "path string, slug string, content_committed boolean, feeds array<string>, parse_error string")
    bare = files.where("value is null").select("path", F.lit(None).cast("string").alias("slug"), F.lit(None).cast("boolean").alias("content_committed"), F.lit(None).cast("array<string>").alias("feeds"), F.lit("no front matter").alias("parse_error"))
    return parsed.unionByName(bare).withColumn("file_slug", F.regexp_extract("path", r"([^/]+)\.md$", 1))


def _entries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    for part in parts:
        rows = []
        for path, text in zip(part["path"], part["value"], strict=True):
            try:
                node = yaml.compose(text)
                doc = _plain(node) if node is not None else {}
                feeds = doc.get("feeds") or []
                rows.append((path, _text(doc["slug"]), _text(doc.get("content_committed")) == "true", [_text(f) for f in feeds], None))
            except (yaml.YAMLError, KeyError, AttributeError) as e:
                rows.append((path, None, None, None, f"{type(e).__name__}: {e}".splitlines()[0]))
        yield pd.DataFrame(rows, columns=["path", "slug", "content_committed", "feeds", "parse_error"])


def delimited(spark, path: str, delimiter: str = ",") -> DataFrame:
    """line number and cells of a delimited text: blank and # lines skipped, trailing empty cells kept.

    A line whose number of cells differs from the header's is an error, not padding. Cells stay one array:
    headers differ from file to file.
    """
    lines = spark.read.option("lineSep", "\n").text(path, wholetext=True).select(F.posexplode(F.split("value", "\n", -1)).alias("line", "text"))
    lines = lines.withColumn("text", F.regexp_replace("text", "\r$", "")).where((F.trim("text") != "") & ~F.ltrim("text").startswith("#"))
    rows = lines.select("line", F.split("text", f"\\Q{delimiter}\\E", -1).alias("cells"))
    header = rows.agg(F.min(F.struct("line", "cells")).alias("h")).select(F.col("h.line").alias("first"), F.col("h.cells").alias("headers"))
    joined = rows.join(F.broadcast(header), F.col("line") > F.col("first"))  # one row, by construction
    checked = F.when(F.size("cells") == F.size("headers"), F.col("cells")).otherwise(F.raise_error(F.concat(F.lit("line "), (F.col("line") + 1).cast("string"), F.lit(": number of cells differs from the header"))).cast("array<string>"))
    return joined.select("line", "headers", checked.alias("cells"))


def price_series(spark, path: str, series: str) -> DataFrame:
    """series, year, month, value of a date,value CSV: empty and ``.`` values are no rows, the last of a month counts."""
    rows = spark.read.csv(path, header=True, schema="date string, value string", mode="FAILFAST")
    rows = rows.withColumn("_line", F.monotonically_increasing_id()).where("value is not null and trim(value) not in ('', '.')")
    number = F.coalesce(F.col("value").try_cast("double"), F.raise_error(F.concat(F.lit("bad value "), "value")).cast("double"))
    rows = rows.select(F.lit(series).alias("series"), F.substring("date", 1, 4).cast("int").alias("year"), F.substring("date", 6, 2).cast("int").alias("month"), number.alias("value"), "_line")
    return rows.groupBy("series", "year", "month").agg(F.max_by("value", "_line").alias("value"))


def feed_section(spark, folder: str, name: str, schema: str) -> DataFrame:
    """A section of a written feed; a feed of another contract version is refused."""
    found = spark.read.json(f"{folder}/manifest.json", schema="contract string").first()
    if found is None or found["contract"] != CONTRACT_VERSION:
        raise ValueError(f"feed contract is {found and found['contract']}, not {CONTRACT_VERSION}")
    return spark.read.schema(schema).json(f"{folder}/{name}.json", mode="FAILFAST")


def write_feed(folder: str, **sections: DataFrame) -> None:
    """Feed sections and their manifest as JSON lines, written by Spark."""
    for name, rows in sections.items():
        rows.write.mode("overwrite").json(f"{folder}/{name}.json")
    spark = next(iter(sections.values())).sparkSession
    spark.createDataFrame([(CONTRACT_VERSION,)], "contract string").write.mode("overwrite").json(f"{folder}/manifest.json")


def decisions(spark, folder: str) -> DataFrame:
    """path and top-level keys of the decision files below ``folder``, by path; one that is no mapping has no keys, one that does not parse is left out."""
    return corpus(spark, folder).where("parse_error is null").select("path", F.coalesce("keys", F.array().cast("array<string>")).alias("keys")).orderBy("path")


#: Fields of a decision record; corpus_depth may be missing, all others are needed.
DECISION = ("id", "summary", "corpus_depth", "context", "decision", "rationale")


def decision_records(spark, folder: str) -> DataFrame:
    """path, the fields of DECISION and skipped (why a file is no record, else null) of every .yml below ``folder``; a file of another shape never ends the read."""
    return whole_files(spark, folder, ".yml").mapInPandas(_decisions, "path string, id string, summary string, corpus_depth int, context string, decision string, rationale string, skipped string")


def _decisions(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    for part in parts:
        rows = []
        for path, value in zip(part["path"], part["value"], strict=True):
            try:
                doc = yaml.safe_load(value)
                if not isinstance(doc, dict):
                    raise ValueError("no mapping")
                missing = [k for k in DECISION if k != "corpus_depth" and not isinstance(doc.get(k), str)]
                depth = doc.get("corpus_depth")
                if missing or not (depth is None or type(depth) is int and depth >= 0):
                    raise ValueError(f"{(missing or ['corpus_depth'])[0]} is missing or of another type")
                rows.append((path, *[doc.get(k) for k in DECISION], None))
            except (yaml.YAMLError, ValueError) as e:
                rows.append((path, *[None] * len(DECISION), f"{type(e).__name__}: {e}".splitlines()[0]))
        frame = pd.DataFrame(rows, columns=["path", *DECISION, "skipped"])
        yield frame.astype({"corpus_depth": "Int32"})


def skills(spark, folder: str) -> DataFrame:
    """path, name and description in the front matter of Markdown files; files without both are left out."""
    files = whole_files(spark, folder, ".md").withColumn("value", front_matter(F.col("value"))).where("value is not null")
    return files.mapInPandas(_skills, "path string, name string, description string").where("name is not null and description is not null")


def _skills(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    for part in parts:
        rows = []
        for path, value in zip(part["path"], part["value"], strict=True):
            try:
                doc = _plain(yaml.compose(value))
                rows.append((path, _text(doc.get("name")), _text(doc.get("description"))))
            except (yaml.YAMLError, AttributeError):
                rows.append((path, None, None))
        yield pd.DataFrame(rows, columns=["path", "name", "description"])


def fixture_rows(spark, folder: str, schema: str) -> DataFrame:
    """Rows of all .yml lists below ``folder``, with their file's path; a file that does not parse fails the read."""

    def parsed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import yaml

        for part in parts:
            rows = [(path, json.dumps(row, default=str)) for path, value in zip(part["path"], part["value"], strict=True) for row in yaml.safe_load(value) or []]
            yield pd.DataFrame(rows, columns=["path", "row"])

    rows = whole_files(spark, folder, ".yml").mapInPandas(parsed, "path string, row string")
    return rows.select("path", F.from_json("row", schema, {"mode": "FAILFAST"}).alias("r")).select("path", "r.*")


def bill(rows: DataFrame, assembly: str, number: str) -> DataFrame:
    """The fixture rows of one bill: a number is unique only within its general assembly."""
    return rows.where((F.col("general_assembly") == assembly) & (F.col("bill_number") == number))


def head_commit(folder: str) -> str | None:
    """Short hash of the checked-out commit of ``folder``, null outside a repository; asked once, by the driver."""
    import subprocess

    done = subprocess.run(["git", "-C", folder, "rev-parse", "--short", "HEAD"], capture_output=True, text=True, check=False)
    return done.stdout.strip() or None if done.returncode == 0 else None


def http_rows(url: str) -> DataFrame:
    """Nothing is fetched, and nothing stands in for it."""
    raise NotImplementedError(f"no network source: {url}")
