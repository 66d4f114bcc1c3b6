r"""Secret scans: fixed patterns plus character Markov models (DataFrame functions only).

Three patterns give the base spans: assignments to secret-like names, access key ids and long hex
runs. Further spans come from two first-order Markov models over the characters of key-like runs, one
of random strings and one of ordinary identifiers. A run that mixes letters and digits, overlaps no
base span and whose mean log-likelihood ratio per character pair exceeds the cutoff is a ``random``
span. Both models are trained from labelled samples ``(token, label)``; every fifth sample, by hash,
is held out and sets the cutoff at the HOLDOUT_QUANTILE of the ratio of held-out identifiers.

The query's samples: SAMPLE_TOKENS generated random strings (label 1), and identifiers built from the
words of at most SAMPLE_DOCS good labelled documents (label 0), both documented bounds. Only the
pair counts (alphabet x alphabet) reach the driver.

Offsets are code points, end exclusive, of the whole match. Edge cases: null and empty texts have no
spans; without samples of both labels there are base spans only; repeated rows are scanned one by one;
empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_of

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "random")
#: A run of fewer than 16 (24) further characters fails the pattern's length, wherever it starts.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
ASSIGN_VALUE = 6
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
SAMPLE_TOKENS, SAMPLE_DOCS = 10_000, 200
HOLDOUT_QUANTILE = 0.9995
MASK = "[SECRET]"

CHUNK = 256

_SPAN_ROW = "struct<start:int,kind:int,end:int>"
_SPAN = f"array<{_SPAN_ROW}>"


def _folded(items: Column, start: Column, step, kind: str) -> Column:
    """Fold of ``items``, which hands on a state and adds at most one output a step, to struct(state, out).

    ``step(state, item)`` gives struct(state, out), out null for none. A list that grows by one is copied each time, so
    outputs are gathered in chunks of CHUNK items and the chunks put together at the end: linear in the number of items.
    """
    outs = F.array().cast(f"array<{kind}>")

    def add(a: Column, x: Column) -> Column:
        return let(step(a["state"], x), lambda r: F.struct(r["state"].alias("state"), F.when(r["out"].isNull(), a["out"]).otherwise(F.array_append(a["out"], r["out"])).alias("out")))

    def chunk(a: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(a["state"].alias("state"), outs.alias("out")), add)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.array_append(a["parts"], d["out"]).alias("parts")))

    chunks = let(items, lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(all_), F.lit(1)) - 1) / CHUNK).cast("int")), lambda i: F.slice(all_, i * CHUNK + 1, F.lit(CHUNK))))
    folded = F.aggregate(chunks, F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("parts")), chunk)
    return let(folded, lambda f: F.struct(f["state"].alias("state"), F.flatten(f["parts"]).alias("out")))


def _spans(text: Column, found: Column, pattern: str, kind: int) -> Column:
    """(start, kind, end) of each match; ``found`` are the matches themselves, the gaps come from a split."""
    lengths = F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("own")))

    def add(at: Column, x: Column) -> Column:
        start = at + x["gap"]
        end = start + x["own"]
        # The last gap has no match behind it.
        return F.struct(end.alias("state"), F.when(x["own"].isNotNull(), F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))).alias("out"))

    return F.when(F.size(found) > 0, _folded(lengths, F.lit(0), add, _SPAN_ROW)["out"]).otherwise(F.array().cast(_SPAN))


def _free(runs: Column, base: Column) -> Column:
    """The ``runs`` (start, end, token; apart from each other) that overlap no span of ``base``: one pass over both, in order.

    A run overlaps a base span if the largest end of the base spans that start before the run's end lies behind the run's start.
    """
    event = lambda pos, order, x, token: F.struct(pos.alias("pos"), F.lit(order).alias("order"), x["start"].alias("start"), x["end"].alias("end"), token.alias("token"))
    events = F.array_sort(F.concat(F.transform(base, lambda b: event(b["start"], 1, b, F.lit(""))), F.transform(runs, lambda r: event(r["end"], 0, r, r["token"]))))

    def step(reach: Column, x: Column) -> Column:
        free = (x["order"] == 0) & (reach <= x["start"])
        return F.struct(F.when(x["order"] == 1, F.greatest(reach, x["end"])).otherwise(reach).alias("state"), F.when(free, F.struct(x["start"].alias("start"), x["end"].alias("end"), x["token"].alias("token"))).alias("out"))

    passed = _folded(events, F.lit(0), step, "struct<start:int,end:int,token:string>")["out"]
    return F.when((F.size(runs) > 0) & (F.size(base) > 0), passed).otherwise(runs)


def pair_codes(token: Column) -> Column:
    """Codes of adjacent characters, all within ALPHABET."""
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return let(places, lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: (a - 1) * len(ALPHABET) + b))


def mean_ratio(token: Column, table: Column) -> Column:
    return F.aggregate(pair_codes(token), F.lit(0.0), lambda a, c: a + F.element_at(table, c)) / (F.length(token) - 1)


def random_samples(spark, n: int = SAMPLE_TOKENS) -> DataFrame:
    """Generated random strings: hex, base64 and upper-case keys, from seeded digests."""
    digest = F.sha2(F.concat(F.lit("sample|"), F.col("id").cast("string")), 256)
    length = (F.pmod("id", F.lit(21)) + 20).cast("int")
    b64 = F.substring(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9+/_=-]", ""), F.lit(1), length)
    upper = F.substring(F.upper(F.base64(F.unhex(digest))), F.lit(1), length)
    kinds = F.pmod("id", F.lit(3))
    token = F.when(kinds == 0, F.substring(digest, F.lit(1), length)).when(kinds == 1, b64).otherwise(upper)
    return spark.range(n).select(token.alias("token"), F.lit(1).alias("label"))


def identifier_samples(docs: DataFrame, labels: DataFrame, n: int = SAMPLE_DOCS) -> DataFrame:
    """Plain, snake_case and camelCase identifiers from the words of at most ``n`` good documents."""
    good = labels.where("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    words = docs.join(F.broadcast(good), "doc_id").select(F.regexp_extract_all(text_of(docs), F.lit(r"\b[A-Za-z]{3,}\b"), F.lit(0)).alias("w")).where(F.size("w") > 1)
    pairs = words.select(F.explode(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w") - 1).alias("b"))).alias("p"))
    a, b = F.col("p")["a"], F.col("p")["b"]
    many = F.array(a, F.concat(a, F.lit("_"), b), F.concat(a, F.initcap(b)), F.concat(F.upper(a), F.lit("_"), F.upper(b)), F.concat(a, F.lit("-"), b, F.pmod(F.length(a), F.lit(10)).cast("string")))
    return pairs.select(F.explode(many).alias("token"), F.lit(0).alias("label"))


def train(samples: DataFrame) -> tuple[str, float] | None:
    """Comma-joined log-likelihood ratios by pair code, and the cutoff; None without both labels."""
    usable = samples.where(F.col("token").rlike(f"^[{ALPHABET[:-1]}-]{{3,}}$")).withColumn("held", F.pmod(F.xxhash64("token"), F.lit(5)) == 0)
    codes = usable.where("not held").select("label", F.explode(pair_codes(F.col("token"))).alias("code"))
    counts = {(r["label"], r["code"]): r["n"] for r in codes.groupBy("label", "code").agg(F.count("*").alias("n")).collect()}  # at most 2 * len(ALPHABET) ** 2
    totals = {label: sum(n for (k, _), n in counts.items() if k == label) for label in (0, 1)}
    if not all(totals.values()):
        return None
    size, a = len(ALPHABET), 0.5
    rows = {label: [sum(counts.get((label, i * size + j + 1), 0) for j in range(size)) for i in range(size)] for label in (0, 1)}

    def log_p(label: int, i: int, j: int) -> float:
        return math.log((counts.get((label, i * size + j + 1), 0) + a) / (rows[label][i] + a * size))

    table = ",".join(f"{log_p(1, i, j) - log_p(0, i, j):.6f}" for i in range(size) for j in range(size))
    ratio = mean_ratio(F.col("token"), _table(table))
    cutoff = usable.where("held and label = 0 and length(token) >= 12").agg(F.percentile(ratio, F.lit(HOLDOUT_QUANTILE))).first()[0]
    return table, max(0.0, cutoff or 0.0)


def _table(csv: str) -> Column:
    return F.split(F.lit(csv), ",").cast("array<double>")


def scan(docs: DataFrame, model: tuple[str, float] | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, the text, ``base`` and ``spans``: arrays of (start, kind, end), sorted."""
    every = lambda pattern, group=0: F.regexp_extract_all("_text", F.lit(pattern), F.lit(group))
    rows = docs.select(*keep, text_of(docs).alias("_text"))
    rows = rows.select("*", every(ASSIGN).alias("_a"), every(ACCESS).alias("_k"), every(HEX).alias("_h"))
    value = lambda m: F.regexp_extract(m, ASSIGN, 2)
    assign = F.filter(F.arrays_zip(_spans(F.col("_text"), F.col("_a"), ASSIGN, 0).alias("s"), F.col("_a").alias("m")), lambda x: F.length(value(x["m"])) >= ASSIGN_VALUE)
    base = F.concat(F.transform(assign, lambda x: x["s"]), _spans(F.col("_text"), F.col("_k"), ACCESS, 1), _spans(F.col("_text"), F.col("_h"), HEX, 2))
    rows = rows.select(*keep, "_text", F.sort_array(base).alias("base"))
    if model is None:
        return rows.withColumn("spans", F.col("base"))
    table, cutoff = model
    rows = rows.select("*", every(RUN).alias("_r"))
    mixed = lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]")
    likely = F.exists("_r", mixed)
    rows = rows.select(*keep, "_text", "base", "_r", F.when(likely, _spans(F.col("_text"), F.col("_r"), RUN, 3)).otherwise(F.array().cast(_SPAN)).alias("_s"))
    # Without a mixed run there are no spans of runs, and the zip holds nulls.
    zipped = F.transform(F.filter(F.arrays_zip(F.col("_s"), F.col("_r")), lambda x: x["_s"].isNotNull() & mixed(x["_r"])), lambda x: F.struct(x["_s"]["start"].alias("start"), x["_s"]["end"].alias("end"), x["_r"].alias("token")))
    extra = F.filter(_free(zipped, F.col("base")), lambda x: mean_ratio(x["token"], _table(table)) > cutoff)
    rows = rows.select(*keep, "_text", "base", F.when(likely, F.transform(extra, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))).otherwise(F.array().cast(_SPAN)).alias("_x"))
    return rows.select(*keep, "_text", "base", F.sort_array(F.concat("base", "_x")).alias("spans"))


def joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every maximal run of overlapping spans replaced by MASK."""
    # A span that begins before the end of the run so far extends it; the state is the open run.
    run = lambda start, end: F.struct(start.alias("start"), end.alias("end"))

    def step(a: Column, s: Column) -> Column:
        extends = s["start"] < a["end"]
        return F.struct(
            F.when(extends, run(a["start"], F.greatest(a["end"], s["end"]))).otherwise(run(s["start"], s["end"])).alias("state"), F.when(~extends, run(a["start"], a["end"])).alias("out")
        )

    first = let(F.get(spans, 0), lambda s: run(s["start"], s["end"]))
    folded = _folded(F.slice(spans, F.lit(2), F.size(spans)), first, step, "struct<start:int,end:int>")
    runs = let(folded, lambda f: F.array_append(f["out"], f["state"]))

    def cut(x: Column) -> Column:
        chars, merged = x["chars"], x["runs"]
        piece = lambda i: let(F.when(i > 0, F.get(merged, i - 1)["end"]).otherwise(F.lit(0)), lambda at: F.array_join(F.slice(chars, at + 1, F.coalesce(F.get(merged, i)["start"], F.size(chars)) - at), ""))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(merged)), piece), MASK)

    return F.when(F.size(spans) > 0, let(F.struct(F.split(text, "").alias("chars"), runs.alias("runs")), cut)).otherwise(text)


def default_model(spark, docs: DataFrame, labels: DataFrame) -> tuple[str, float] | None:
    return train(random_samples(spark).unionByName(identifier_samples(docs, labels)))


def redact(docs: DataFrame, model: tuple[str, float] | None) -> DataFrame:
    """All rows and columns of ``docs``; secrets in the text are masked and n_chars, if there, recounted."""
    packed = docs.select("text", F.struct("*").alias("_doc"))
    out = scan(packed, model, keep=("_doc",)).select("_doc", "spans", F.when(F.col("_doc.text").isNotNull(), masked(F.col("_text"), F.col("spans"))).alias("_new"))
    new = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc.n_chars"))
    return out.select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = scan(docs, default_model(spark, docs, labels))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
