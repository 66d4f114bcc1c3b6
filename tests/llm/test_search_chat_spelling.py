"""Ranked search, chat windows and spelling variants against brute force, with odd rows; long single texts for the scans."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import chatformat, quality, ranked, secretscan, spelling

from .conftest import sentence

lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))


def brute_search(docs, items, k):
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(s for *_, s in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c, size in held:
            m = 50 + 50 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(found)[:k], 1)]
    return collections.Counter(out)


def test_search_equals_brute_force(spark, docs, docs_rows, none, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_DOCS", 7)  # several blocks a task
    monkeypatch.setattr(ranked, "CHUNK", 4)  # several chunks of queries
    rng = random.Random(3)
    queries = [(q, sentence(rng, rng.randint(1, 30))) for q in range(9)] + [(9, None), (10, ""), (11, "no such term"), (None, docs_rows[3][1]), (1, docs_rows[0][1].upper()), (12, "ÀÉ ñandú x-y " * 3)]
    items = spark.createDataFrame(queries, "item_id bigint, text string").withColumn("score", F.lit("clash"))
    index = ranked.Index(docs)
    for k in (3, 50):
        assert collections.Counter(map(tuple, ranked.search(index, items, k).collect())) == brute_search([r[:2] for r in docs_rows], queries, k)
    index.drop()
    empty = ranked.Index(none)
    assert ranked.search(empty, items).count() == 0 == ranked.search(empty, items.limit(0)).count()


def test_one_block_may_be_one_long_text(spark):
    rng = random.Random(8)
    rows = [(1, sentence(rng, 300_000)), (2, "lone word here"), (3, None)]
    index = ranked.Index(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1))
    assert collections.Counter(map(tuple, ranked.search(index, spark.createDataFrame([("q", "word kabal")], "item_id string, text string")).collect())) == brute_search(rows, [("q", "word kabal")], 50)
    assert index.blocks.count() == 2


CHATS = "conv_id bigint, turn bigint, role string, text string, window string"
ODD = ["", None, "<|im_end|><|im_start|>assistant ok", "<\\|im_end|> <\\\\| <| \\n", "a\nb <", "ünï 𝄞 <|", "<|im_end|>\n<|im_start|>system\nx"]


@pytest.fixture(scope="module")
def chats():
    rng = random.Random(4)
    rows = []
    for conv in range(40):
        roles = (["system"] if conv % 3 == 0 else []) + ["user", "assistant"] * rng.randint(0, 9) + (["user"] if conv % 4 == 1 else [])
        rows += [(conv, turn, role, rng.choice(ODD) if rng.random() < 0.2 else sentence(rng, rng.choice([3, 20, 60, 150])), "x") for turn, role in enumerate(roles)]
    rows += [(100, 0, "system", sentence(rng, 900), "x"), (100, 1, "user", "short", "x"), (100, 2, "assistant", "reply", "x")]  # a system turn above the budget
    rows += [(101, k, ["user", "assistant"][k % 2], sentence(rng, 5), "x") for k in range(700)]  # one long conversation
    return [*rows, (None, 1, "assistant", "no id", "x"), (None, None, "us\ner <|", "odd role", "x"), (102, 5, None, "no role", "x"), (102, 5, "assistant", "same turn", "x"), (102, 5, "assistant", "same turn", "x")]


def ordered(rows):
    by_conv = collections.defaultdict(list)
    for conv, turn, role, text, _ in rows:
        by_conv[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(role, text) for _, _, role, text in sorted(turns)] for c, turns in by_conv.items()}


@pytest.mark.parametrize(("budget", "history"), [(512, 128), (60, 20), (100, 0), (10**6, 50)])
def test_chats_come_back_whole_with_each_target_once(spark, chats, budget, history):
    windows = chatformat.windows(spark.createDataFrame(chats, CHATS).repartition(3), budget, history)
    cost = lambda text: 4 + len(re.findall(chatformat.PIECE, text))
    want = ordered(chats)
    got = {r["conv_id"]: r for r in chatformat.read_back(windows).collect()}
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        said = "".join(t for r, t in turns if r == "assistant")
        row = got[conv]
        assert (row["n_turns"], row["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
        assert (row["loss_chars"], row["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    by_conv = collections.defaultdict(list)
    for r in windows.collect():
        by_conv[r["conv_id"]].append(r)
    for conv, rows in by_conv.items():
        turns, at = want[conv], 0
        system = turns[0] if turns[0][0] == "system" else None
        for r in sorted(rows, key=lambda r: r["window"]):
            found = chatformat.parsed(r["text"])
            own = found[r["n_system"] + r["n_history"] :]
            assert (r["window"], len(own), own) == (at, r["n_turns"], turns[at : at + len(own)])
            assert found[r["n_system"] : r["n_system"] + r["n_history"]] == turns[at - r["n_history"] : at]
            assert found[0] == system if system else r["n_system"] == 0
            spent = sum(cost(t) for _, t in found)
            assert r["n_tokens"] == spent
            assert sum(cost(t) for _, t in turns[at - r["n_history"] : at]) <= history
            body = own[1:] if system and not at else own
            assert spent <= budget or len(body) <= 1, "only a turn that is too long by itself may pass the budget"
            assert r["over_budget"] == (spent > budget)
            at += len(own)
        assert at == len(turns)
    assert chatformat.windows(spark.createDataFrame([], CHATS)).count() == 0


def test_control_strings_never_stand_in_a_written_text(spark):
    for text in ("".join(p) for n in range(5) for p in itertools.product("<\\|x", repeat=n)):
        assert chatformat.unescaped(re.sub(r"<(\\*)\|", r"<\\\1|", text)) == text
    rows = spark.createDataFrame([(t,) for t in ODD if t], "t string").select("t", chatformat.escaped(F.col("t")).alias("e")).collect()
    assert all("<|" not in r["e"] and chatformat.unescaped(r["e"]) == r["t"] for r in rows)


def test_real_token_counts_fit_the_budget(spark, chats, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    pieces = [bytes([b]) for b in range(256)] + [b"ka", b"lo", b" ka"]
    path = tmp_path / "small.tiktoken"
    path.write_text("".join(f"{base64.b64encode(p).decode()} {i}\n" for i, p in enumerate(pieces)))
    pattern = r" ?[^\s]+|\s+"
    count = chatformat.bpe_tokens(spark, str(path), pattern)
    own = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})
    for r in chatformat.windows(spark.createDataFrame(chats[:200], CHATS), 900, 200, count).collect():
        assert r["n_tokens"] == sum(4 + len(own.encode_ordinary(t)) for _, t in chatformat.parsed(r["text"]))


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("scan", [2, 48])
def test_near_words_equal_brute_force(spark, scan):
    rng = random.Random(6)
    words = {"".join(rng.choice("abß") for _ in range(rng.randint(1, 7))) for _ in range(400)} | {"abcdefgh" + x for x in "abcdefghijÿ"} | {x + "bcdefgh" for x in "abcdefgÿ"} | {"a", ""} - {""}
    rows = [(w, rng.randint(5, 2000)) for w in sorted(words)]
    table = spark.createDataFrame(rows, "word string, n bigint").repartition(3)
    got = [tuple(r) for r in spelling.near_pairs(table, scan).select("word", "near").collect()]
    assert len(got) == len({frozenset(p) for p in got}) and {frozenset(p) for p in got} == {frozenset(p) for p in itertools.combinations(sorted(words), 2) if near(*p)}
    n = dict(rows)
    form = {}
    for w in words:
        best = min(((-n[x], x) for x in words if x != w and near(w, x)), default=None)
        form[w] = best[1] if best and -best[0] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    assert {r["word"]: (r["form"], r["root"], r["form_n"]) for r in spelling.forms(table, scan=scan).collect()} == {w: (form[w], root(w), n.get(form[w])) for w in words}
    assert spelling.forms(table.limit(0)).count() == 0


def test_the_dictionary_counts_planted_runs(spark, docs, docs_rows, none):
    want = collections.Counter()
    for doc, text, *_ in docs_rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 7 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            want[run] += 1
    got = {r["word"]: r["n"] for r in spelling.dictionary(docs, 3, 2, every=7).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 3 and n >= 2}
    assert spelling.dictionary(none).count() == 0


def test_good_rows_are_kept_by_language(spark):
    rng = random.Random(9)
    text = " ".join(f"w{i}##" for i in range(60))
    plain = [(k, sentence(rng, 60), "en") for k in range(300)]
    noisy = [(k, sentence(rng, 60).replace(" ", "## "), "en") for k in range(300, 400)]
    docs = spark.createDataFrame([*plain, *noisy, (5000, text, "en"), (5000, text, "xx")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(300)] + [(k, 0) for k in range(300, 400)], "doc_id bigint, quality int")
    verdicts = {(r["doc_id"], r["lang"]): r["kept"] for r in quality.judge(docs, labels, keep=("doc_id", "lang")).collect()}
    assert (verdicts[5000, "en"], verdicts[5000, "xx"]) == (False, True)
    assert {(r["doc_id"], r["lang"]) for r in quality.keep_good(docs, labels).collect()} == {k for k, kept in verdicts.items() if kept}


def test_many_secrets_in_one_text_take_linear_time(spark):
    table = ",".join(["1.0"] * len(secretscan.ALPHABET) ** 2)
    n, took = 40_000, time.time()
    text = " ".join(f"token=abc{i:06d}x Zx9{i:07d}qQw8eRt7yUi6oP{i}" for i in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = secretscan.redact(docs, (table, 0.5)).first()
    assert row["text"] == " ".join(["[SECRET] [SECRET]"] * n) and time.time() - took < 120


def test_reader_comments_go_and_article_words_stay():
    from tallyspark.llm.htmltext import page_blocks

    inside = lambda name: page_blocks(f'<article><p>one two</p><div class="{name}">more</div></article>')[0]
    for name in ("user-comments", "comment-thread", "reader-responses", "cookie-policy-notice", "comments", "share-buttons", "userReplies"):
        assert inside(name) == ["one two"], name
    for name in ("share-price", "notice-period", "discussion-paper", "user-guide", "cookie-recipe", "commentary"):
        assert inside(name) == ["one two", "more"], name
    teasers = '<article class="card">a b</article><article class="card">c d</article>'
    assert page_blocks(teasers + "<div>the main text is longer than both of them</div>")[0] == ["the main text is longer than both of them"]
    assert page_blocks(teasers + "<div>short</div>")[0] == ["a b", "c d"]


def test_stray_tags_take_linear_time():
    from tallyspark.llm.htmltext import page_blocks

    took = time.time()
    assert page_blocks("<b></i>" * 40_000 + "end")[0] == ["end"] and time.time() - took < 20


def test_host_runs_equal_brute_force_on_unmarked_pages(spark):
    from tallyspark.llm import htmltext

    rng = random.Random(12)
    menu, foot = sentence(rng, 12), "all rights reserved"
    rows = [(k, f"http://{'ab'[k % 2]}.example/{k}", f"<!-- <main> --><div>{menu}</div><p>{'text ' if k < 4 else ''}{sentence(rng, 20)}</p><div>{foot}</div>") for k in range(9)]
    rows += [(20, None, f"<div>{menu}</div>"), (21, "http://c.example/", f"<div>{menu}</div>"), (22, "http://a.example/x", ""), (0, rows[0][1], rows[0][2])]
    got = sorted(tuple(r) for r in htmltext.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))).select("page_id", "text").collect())
    hosts = collections.defaultdict(set)
    blocks = [htmltext.page_blocks(h)[0] for *_, h in rows]
    host = lambda u: u and u.split("/")[2]
    runs = lambda b: [(i, tuple(b.split()[i : i + htmltext.RUN])) for i in range(max(1, len(b.split()) - htmltext.RUN + 1))]
    for (page, url, h), bs in zip(rows, blocks, strict=True):
        for b in bs:
            for _, run in runs(b):
                hosts[host(url), run].add((page, h))
    want = []
    for (page, url, _), bs in zip(rows, blocks, strict=True):
        lines = []
        for b in bs:
            gone = {i + j for i, run in runs(b) if len(hosts[host(url), run]) >= htmltext.MIN_PAGES for j in range(len(run))}
            lines.append(" ".join(w for i, w in enumerate(b.split()) if i not in gone))
        want.append((page, "\n".join(filter(None, lines))))
    assert got == sorted(want) and dict(want)[1] != "" and menu not in dict(want)[1] and menu == dict(want)[21]


def test_template_inside_marked_articles_goes_and_shared_text_stays(spark):
    from tallyspark.llm import htmltext

    rng = random.Random(31)
    menu, line, lead, spot = sentence(rng, 11), sentence(rng, 14), sentence(rng, 12), sentence(rng, 9)
    story = lambda k, more, chrome: (k, f"http://h.example/{k}", f"<nav>{chrome}</nav><article><h1>Story {k}</h1><p>{sentence(rng, 30)} {line}</p>{more}</article>")
    # Four articles hold the menu that the others leave out, in a block without a name; the host's menus also hold a lead and a headline.
    rows = [story(k, f"<div>{menu}</div>" if k < 4 else "", f"<p>{menu}</p><p>{lead}</p><p>Top</p>") for k in range(12)]
    # Three versions of one story, whose headline and lead are in the menus; a line left out on few pages.
    rows += [(k, f"http://h.example/{k}", f"<article><h1>Top</h1><p>{lead}</p><p>{sentence(rng, 20)}</p></article><aside>{spot}</aside>") for k in range(12, 15)]
    rows += [story(k, f"<p>{spot}</p>", "") for k in range(15, 18)]
    # On another host the menu is an article's own text.
    rows += [(k, f"http://o.example/{k}", f"<article><h1>Own {k}</h1><p>{menu}</p></article>") for k in range(20, 24)]
    blocks = {k: htmltext.page_blocks(h)[0] for k, _, h in rows}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {r["page_id"]: r["text"].split("\n") for r in htmltext.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(menu in blocks[k] and got[k] == blocks[k][:2] for k in range(4))
    assert all(got[k] == blocks[k] for k in blocks if k > 3) and lead in got[12] and spot in got[15] and got[20] == ["Own 20", menu]


def test_intervals_of_the_sorted_array_add_up_over_batches():
    import pyarrow as pa

    from tallyspark.llm import htmltext

    rng = random.Random(8)
    rows = sorted((rng.randrange(2), bytes([rng.randrange(3)]), rng.randrange(2), rng.randrange(3), rng.randrange(4)) for _ in range(300))
    want = collections.Counter((*r[:3], r[3]) for r in set(rows))
    for size in (1, 7, 300):
        table = pa.table(dict(zip(["host", "tokens", "run", "side", "who"], map(list, zip(*rows, strict=True)), strict=True)))
        met = collections.Counter()
        for batch in htmltext._intervals(table.to_batches(max_chunksize=size)):
            for row in batch.to_pylist():
                for side, name in enumerate(("pages", "left_on", "articles")):
                    met[row["host"], row["tokens"], row["run"], side] += row[name]
        assert +met == want


def test_many_mails_and_long_runs_take_linear_time():
    from tallyspark.llm import surrogates

    took = time.time()
    assert len(surrogates.detect(" ".join(f"user{i}@mail{i}.example.org" for i in range(40_000)))) == 40_000
    assert [f[:3] for f in surrogates.detect("a" * 1_000_000 + " jean-luc@müller.de ..x@y.org a@b.com@c.de")] == [(1_000_001, 1_000_019, "email"), (1_000_022, 1_000_029, "email"), (1_000_030, 1_000_037, "email")]
    assert time.time() - took < 30
