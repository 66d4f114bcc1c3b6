"""Main text of web pages: block structure proposes, the suffix array of the host takes its template out.

A page is cut into blocks. Scripts, styles, menus, headers, footers, sidebars, notices, adverts, forms
and reader comments are left out by their element, role, class or id. Where the page marks its
article (``article``, else ``main``), the blocks inside it are proposed; several articles with less text than what stands around
them are teasers, and what stands around them is proposed. Where it marks none, all blocks that are not left out are.

The token streams of all pages of a host, what is left out included, make one suffix array. It is sorted by range over all
tasks; neighbours that agree on their first RUN tokens form an interval, and the interval tells how many pages of the host it
meets and on which side its suffixes stand. Its runs are boilerplate and go

* from the text of unmarked pages, if they meet MIN_PAGES distinct pages there;
* from marked articles, if they are the host's template: structure leaves them out on MIN_PAGES pages and on at least one page in
  TEMPLATE_OF of the host, and articles of MIN_PAGES different headlines hold them.

Overlapping runs of a text extend each other to the real end of what is repeated, unique runs stay. Runs end with their block; a
block of fewer tokens is one run by itself.

Why a marked article needs more than repetition: a sentence that several articles share is text, and so is an article that was
published under several urls, or a headline that the host's menus repeat. Suffixes whose run cannot reach these bounds, by a count of its hash
with a map-side combine, leave before the sort. A run that a third of all pages hold is sorted by page too, so it is no single task.
Every page is parsed once; marks are read from the parse.

Edge cases: null and empty html give an empty text; a null url is a host of its own; repeated rows and
page_ids are extracted one by one (rows equal in page_id and text are one page to the suffix array); very long pages and pages of
stray tags take linear time; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import signed
from .common import drop, hinted, saved
from .wordhash import Rolling, batches, mix, words

#: Tokens of a repeated run, and the distinct pages of one host that make it boilerplate.
RUN, MIN_PAGES = 8, 3
#: Inside a marked article a run is the host's template if structure leaves it out on one page of so many.
TEMPLATE_OF = 2
#: Runs that may be boilerplate, three short values each, are broadcast up to this number.
COMMON_ROWS = 200_000
#: Where a suffix stands: in the text of an unmarked page, in what structure leaves out, in a marked article.
TEXT, LEFT, ARTICLE = 0, 1, 2

DROP_TAGS = set("head title script style noscript template iframe object embed svg canvas nav footer aside form button select textarea option dialog menu audio video map".split())
#: Those of them that show no text of their own.
UNSEEN_TAGS = set("head title script style noscript template iframe object embed svg canvas audio video map".split())
DROP_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
DROP_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside"
    " footer comment comments respond disqus replies cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup share sharing social"
    " related recommended widget toolbar skip login search pagination pager".split()
)
#: Words that stand beside a dropped one in the same class or id without giving it another meaning ("share-buttons", not "share-price").
LAYOUT_WORDS = set(
    "area articles bar block bottom box btn button buttons card col column container content desktop element field footer form global group head header holder icon icons inner"
    " item items label layer left letter line link links list main message mobile module nav outer page panel position post posts primary right row secondary section site slot sticky"
    " stories story strip tags text title top unit view web wrap wrapper zone".split()
).union(DROP_WORDS)
#: Words of reader comments: the first drop a block whatever stands beside them, the others beside words of the second kind.
COMMENT_WORDS = set("comment comments disqus".split())
REPLY_WORDS, READER_WORDS = set("responses replies discussion thread feedback".split()), set("reader readers user users visitor visitors community".split())
#: Words that belong to a cookie notice beside its own word.
COOKIE_WORDS, POLICY_WORDS = set("cookie cookies consent gdpr".split()), set("policy privacy settings preferences choices accept manager".split())
ARTICLE_DROPS = set("comment comments ad ads advert advertisement sponsored promo related".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre"
    " section summary table tbody tfoot thead tr ul".split()
)
#: Start tags that end an open element of the given kind, as their end tags may be left out.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("article main section div ul ol dl table body td th li blockquote aside nav footer header form".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Blocks have one space between tokens and \n between blocks; other characters belong to tokens.
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True
_RUNS = Rolling(0xA24BAED4963EE407)


def _dropped(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in DROP_TAGS or (tag == "header" and not in_article):
        return True
    if not attrs.strip(" /"):
        return False
    values = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
    if "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", ""):
        return True
    if values.get("role", "").lower() in DROP_ROLES:
        return True
    if tag in ("html", "body", "main"):
        return False
    tokens = [{w.lower() for w in _WORD.findall(t)} for k in ("class", "id") for t in values.get(k, "").split()]
    if any(_is_comments(t) for t in tokens):
        return True
    names = [t for t in tokens if t <= LAYOUT_WORDS or (t & COOKIE_WORDS and t <= LAYOUT_WORDS | POLICY_WORDS)]
    if tag == "article":
        return any(t & ARTICLE_DROPS for t in names)
    return any(t & DROP_WORDS or ("header" in t and not in_article) for t in names)


def _is_comments(name: set[str]) -> bool:
    """Does a class or id name reader comments? A word of replies needs one of readers, and nothing but layout beside them."""
    return bool(name & COMMENT_WORDS) or bool(name & REPLY_WORDS and name & READER_WORDS and name <= LAYOUT_WORDS | REPLY_WORDS | READER_WORDS)


def page_blocks(page: str) -> tuple[list[str], bool]:
    """The blocks of the page's article (or of all that is not left out), and whether it marks one."""
    return page_parts(page)[:2]


def page_parts(page: str) -> tuple[list[str], bool, list[str], str]:
    """``page_blocks``, the visible blocks that its structure leaves out, and its headline (the first h1, else the first block)."""
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, dropped, in article, in main
    open_tags: Counter = Counter()
    found: dict[str, list[str]] = {"article": [], "main": [], "rest": [], "around": []}
    marked = {"article": 0, "main": 0}
    buffer: list[str] = []
    away: list[str] = []
    unseen = 0  # open elements that show no text
    left: list[str] = []
    headline = ""
    dropped = in_article = in_main = False

    def flush() -> None:
        nonlocal headline
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            if not headline and stack and stack[-1][0] == "h1":
                headline = text
            for kind, inside in (("article", in_article), ("main", in_main), ("rest", True), ("around", not in_article)):
                if inside:
                    found[kind].append(text)

    def leave() -> None:
        text = " ".join("".join(away).split())
        away.clear()
        if text:
            left.append(text)

    def pop_to(size: int) -> None:
        nonlocal dropped, in_article, in_main, unseen
        open_tags.subtract(x[0] for x in stack[size:])
        unseen -= sum(x[0] in UNSEEN_TAGS for x in stack[size:])
        del stack[size:]
        dropped, in_article, in_main = stack[-1][1:] if stack else (False, False, False)

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if not dropped:
            buffer.append(entities.unescape(page[at : m.start() if m else len(page)]))
        elif not unseen:
            away.append(entities.unescape(page[at : m.start() if m else len(page)]))
        if m is None:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS and away:
            leave()
        if m[1]:  # an end tag
            if tag in BLOCKS and not dropped:
                flush()
            if open_tags[tag]:
                pop_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in BLOCKS and not dropped:
            flush()
        elif tag in ("br", "td", "th") and not dropped:
            buffer.append(" ")
        elif tag in ("br", "td", "th") and away:
            away.append(" ")
        if tag in VOID:
            continue
        closes = ENDS.get(tag) or ({"p"} if tag in BLOCKS else set())
        for i in range(len(stack) - 1, -1, -1) if any(open_tags[t] for t in closes) else ():
            if stack[i][0] in closes:
                pop_to(i)
                break
            if stack[i][0] in SCOPES:
                break
        drop = dropped or _dropped(tag, m[3], in_article)
        if tag in ("script", "style") and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if not drop:
            marked["article"] += tag == "article" and not in_article
            marked["main"] += tag == "main" or "main" == _role(m[3])
        in_article = in_article or (tag == "article" and not drop)
        in_main = in_main or ((tag == "main" or _role(m[3]) == "main") and not drop)
        dropped = drop
        stack.append((tag, dropped, in_article, in_main))
        open_tags[tag] += 1
        unseen += tag in UNSEEN_TAGS
    leave()
    if not dropped:
        flush()
    kind = "article" if marked["article"] else "main" if marked["main"] else "rest"
    # Several articles with less text than what stands around them are teasers.
    if marked["article"] > 1 and sum(map(len, found["around"])) > sum(map(len, found["article"])):
        kind = "around"
    left += found["around"] if kind == "article" else found["article"] if kind == "around" else ()
    return found[kind], kind != "rest", left, headline or next(iter(found[kind]), "")


def _role(attrs: str) -> str:
    return next((v.strip("\"'").lower() for k, v in _ATTR.findall(attrs) if k.lower() == "role"), "") if "role" in attrs.lower() else ""


def _parsed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        pages = [page_parts(x.as_py() or "") for x in batch.column("html")]
        text, left = (pa.array(["\n".join(p[i]) for p in pages], pa.string()) for i in (0, 2))
        marked, headline = pa.array([p[1] for p in pages], pa.bool_()), pa.array([p[3] for p in pages], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), text, marked, left, headline], ["page_id", "url", "text", "marked", "left", "headline"])


def _suffixes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, hash, tokens in 16 bits each) of the run that every suffix begins with, places counted over the text.

    Runs end with their block, and a block of fewer than RUN tokens is one run.
    """
    for lo, _, data, offsets in batches(column):
        starts, _, hashes, first = words(data, offsets, space=_GAP)
        if not len(starts):
            continue
        text, lines = np.repeat(np.arange(len(offsets) - 1), np.diff(first)), np.searchsorted(np.flatnonzero(data == 10), starts)
        begins = np.concatenate(([True], (text[1:] != text[:-1]) | (lines[1:] != lines[:-1])))
        size = np.diff(np.append(np.flatnonzero(begins), len(starts)))
        n = np.repeat(np.cumsum(size), size) - np.arange(len(starts))  # tokens to the end of the block
        at = np.flatnonzero((n >= RUN) | begins)
        n = np.minimum(n[at], RUN)
        run = mix(_RUNS.ranges(_RUNS.prefix(hashes), at, at + n) ^ n.astype(np.uint64), 17)
        token = np.arange(RUN)
        codes = np.where(token < n[:, None], (hashes >> np.uint64(48)).astype(">u2")[np.minimum(at[:, None] + token, len(starts) - 1)], 0).astype(">u2")
        yield lo + text[at], at - first[text[at]], run, codes


def _sides(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """The suffixes of a batch and their side: TEXT of an unmarked page, LEFT out by structure, or of an ARTICLE."""
    side = np.where(batch.column("marked").to_numpy(zero_copy_only=False), ARTICLE, TEXT).astype(np.int32)
    for column in ("text", "left"):
        for row, *suffix in _suffixes(batch.column(column)):
            yield row, *suffix, side[row] if column == "text" else np.full(len(row), LEFT, np.int32)


def _keys(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Once per page, the runs that may be boilerplate: those of unmarked pages, and those that structure leaves out."""
    for batch in rows:
        for row, _, run, _, side in _sides(batch):
            told = side != ARTICLE
            row, run, left = row[told], run[told], side[told] == LEFT
            order = np.lexsort((left, run, row))
            row, run, left = row[order], run[order], left[order]
            once = np.append(True, (row[1:] != row[:-1]) | (run[1:] != run[:-1]) | (left[1:] != left[:-1]))[: len(row)]
            yield pa.RecordBatch.from_arrays([batch.column("host").take(pa.array(row[once])), signed(run[once]), pa.array(left[once])], ["host", "run", "template"])


def _laid_out(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per suffix; ``who`` tells apart what is counted: pages, or the headlines of articles."""
    for batch in rows:
        page, story = (batch.column(c).to_numpy() for c in ("page", "story"))
        for row, at, run, codes, side in _sides(batch):
            tokens = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(0, 2 * RUN * len(at) + 1, 2 * RUN, np.int32)), pa.py_buffer(codes.tobytes())])
            who = np.where(side == ARTICLE, story[row], page[row])
            yield pa.RecordBatch.from_arrays(
                [batch.column("host").take(pa.array(row)), signed(run), pa.array(side != TEXT), tokens, pa.array(side), pa.array(who), pa.array(page[row]), pa.array(at.astype(np.int32))],
                ["host", "run", "template", "tokens", "side", "who", "page", "at"],
            )


def _intervals(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted suffix array to its intervals: neighbours that agree on a whole run, and what they meet on each side.

    Equal (host, tokens, run, side, who) are never dealt to two partitions, so the counts of an interval that goes on in the next batch or partition add up.
    """
    last = None
    for batch in rows:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("host", "tokens", "run", "side", "who")]
        changed = [np.concatenate(([last is None or k[0] != old], k[1:] != k[:-1])) for k, old in zip(keys, last or keys, strict=True)]
        last = [k[-1] for k in keys]
        new, side = np.logical_or.reduce(changed), keys[3]
        edge = np.logical_or.reduce(changed[:3])
        edge[0] = True
        at = np.flatnonzero(edge)
        met = [pa.array(np.add.reduceat((new & (side == s)).astype(np.int64), at)) for s in (TEXT, LEFT, ARTICLE)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in ("host", "tokens", "run")), *met], ["host", "tokens", "run", "pages", "left_on", "articles"])


def _without(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a page without the tokens that its boilerplate runs cover, each extended to its end by the runs that overlap it."""
    for batch in rows:
        texts = batch.column("text").to_pylist()
        for i, gone in enumerate(batch.column("gone").to_pylist()):
            if not gone:
                continue
            blocks, lines, at = [b.split(" ") for b in texts[i].split("\n")], [], 0
            starts = np.sort(np.array(gone))
            for b in blocks:
                covered = np.zeros(len(b), bool)
                for start in starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + len(b))] - at:
                    covered[start : start + RUN] = True
                lines.append(" ".join(t for t, c in zip(b, covered, strict=True) if not c))
                at += len(b)
            texts[i] = "\n".join(filter(None, lines))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, read from the saved texts of all pages."""
    kind = pages.schema["page_id"].dataType.simpleString()
    parsed = saved(pages.select("page_id", "url", "html").mapInArrow(_parsed, f"page_id {kind}, url string, text string, marked boolean, left string, headline string"))
    host = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("~null"))
    told = parsed.withColumns({"host": F.xxhash64(host), "page": F.xxhash64("page_id", "text"), "story": F.xxhash64("headline")})
    hosts = saved(told.groupBy("host").agg(F.count_distinct("page").alias("on_host")))
    # Counts of rows are upper bounds of the counts of pages: runs that they keep below the bounds leave before the sort.
    common = told.select("host", "text", "left", "marked").mapInArrow(_keys, "host bigint, run bigint, template boolean").groupBy("host", "run", "template").agg(F.count("*").alias("n"))
    common = common.where(F.col("n") >= MIN_PAGES).join(hinted(hosts), "host").where(f"not template or {TEMPLATE_OF} * n >= on_host").select("host", "run", "template")
    common = saved(common)
    layout = "host bigint, run bigint, template boolean, tokens binary, side int, who bigint, page bigint, at int"
    suffixes = told.select("host", "page", "story", "text", "left", "marked").mapInArrow(_laid_out, layout)
    # Saved, as a sort by range reads its input twice.
    suffixes = saved(suffixes.join(hinted(common, COMMON_ROWS), ["host", "run", "template"], "left_semi").drop("template"))
    order = ["host", "tokens", "run", "side", "who"]
    intervals = suffixes.select(order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_intervals, "host bigint, tokens binary, run bigint, pages bigint, left_on bigint, articles bigint")
    met = intervals.groupBy("host", "tokens", "run").agg(*(F.sum(c).alias(c) for c in ("pages", "left_on", "articles"))).join(hinted(hosts), "host")
    met = met.withColumns({"bare": F.col("pages") >= MIN_PAGES, "template": F.expr(f"left_on >= {MIN_PAGES} and {TEMPLATE_OF} * left_on >= on_host and articles >= {MIN_PAGES}")})
    shared = saved(met.where("bare or template").select("host", "tokens", "run", "bare", "template"))
    gone = suffixes.where(F.col("side") != LEFT).join(shared, ["host", "tokens", "run"]).where(F.when(F.col("side") == TEXT, F.col("bare")).otherwise(F.col("template")))
    gone = saved(gone.groupBy("host", "page").agg(F.collect_set("at").alias("gone")))
    drop(hosts, common, suffixes, shared)
    texts = told.select("page_id", "url", "text", "host", "page").join(hinted(gone), ["host", "page"], "left")
    return texts.select("page_id", "url", "text", "gone").mapInArrow(_without, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("bigint"))


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
