"""PII: detected entities get keyed, type-consistent surrogates.

Kinds: email addresses, phone numbers, IPv4 addresses, card numbers, IBANs, and the given and family names of
persons. A surrogate is drawn with a keyed hash of (kind, canonical form, attempt): digits for digits and
letters for letters in the original's own layout, card numbers with the same first digit and the same
Luhn validity, given names of the same gender and script, family names of the same script and ending
gender. The canonical form (folded mail address, bare digits, name) is what is mapped, so one person,
number or address has one surrogate in all texts and spellings.

Distinctness is checked over the whole corpus: all distinct entities are listed, two that share a
surrogate, and a surrogate that is itself a real entity, send the later one to its next attempt,
until nothing collides. Every CROWDED attempts mail parts, phone numbers and names get longer, so that
this ends where all forms of one length are in use; IPv4 addresses, card numbers and IBANs have no longer form,
but 254**4 and at least 10**8 ones. Only entities with a later attempt have to be told to the rewriting tasks: up
to BROADCAST_ROWS of them are shipped as a dictionary, more are joined to their texts.

Detection is bounded. Phone numbers have 9 to 15 digits (11 with the country code 1), separated by single
spaces, dots or hyphens; one without + and brackets begins with 0 or has groups of 3, 3 and 4 digits.
Where other digits follow, it ends at the most digits, or from 9 on at a change of separator. Card numbers
pass the Luhn test. Persons are found by the given names of GIVEN, a title of TITLES or a phrase of CUES
("my name is", "Contact:") before a capitalised Latin or Cyrillic name of three letters or more, hyphens,
Mc, Mac and O' included; other names without such a phrase, lone family names and decomposed accents are not.

Edge cases: null texts stay null and have no entities; empty texts stay empty; null or repeated doc_ids
are handled row by row; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect
from collections.abc import Callable, Iterator
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import id_type, keyed, same_row
from .common import BROADCAST_ROWS, drop, saved

KEY = b"surrogates-1"
#: Attempts after which a surrogate gets longer, once more every so many attempts.
CROWDED = 4
#: Where two overlap, the earlier kind wins.
KINDS = ("email", "iban", "ip", "card", "phone", "name")

#: What follows the @ of a mail address; labels may have letters of any script.
DOMAIN = re.compile(r"@([^\W_](?:[^\W_]|-)*(?:\.[^\W_](?:[^\W_]|-)*)*\.[^\W\d_]{2,})")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
CARD = re.compile(r"(?<![\w+])\d(?:[ -]?\d){12,18}(?!\w)")
#: Where a phone number may begin: +country code, (area) or a bare digit; groups of digits follow.
PHONE = re.compile(r"(?<![\w+])(?:(?:\+\d{1,3}|\(\+\d{1,3}\))[ .-]?(?:\(\d{1,5}\)[ .-]?)?|\(\d{2,5}\)[ .-]?)?(?=\d)")
PHONE_GROUP = re.compile(r"[ .-]?(\d+)")
PHONE_DIGITS = range(9, 16)
#: The only layout of a number that begins neither with + nor a bracket nor 0; others may be years, dates or amounts.
PHONE_BARE = re.compile(r"\d{3}([ .-])\d{3}\1\d{4}(?!\w|[.-]\d)")
#: Four groups of four digits, or a bare run of as many: where such a card number follows, a phone number ends.
CARD_AHEAD = re.compile(r"[ .-](\d{4}([ -]?)\d{4}\2\d{4}\2\d{4})(?!\d)")

MALE = "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Andrew Kenneth George Edward Brian Kevin Jason Jeffrey Gary Hans Pierre Carlos Klaus Jean Miguel".split()
FEMALE = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Betty Sandra Ashley Dorothy Kimberly Emily Donna Michelle Carol Amanda Melissa Ursula Claire Carmen Monika Marie Lucia".split()
MALE_CYR = "Иван Сергей Дмитрий Алексей Андрей Михаил Николай Владимир Павел Олег Борис Виктор".split()
FEMALE_CYR = "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Юлия Екатерина Галина Вера".split()
FAMILY = "Miller Davis Wilson Moore Taylor Anderson Jackson White Harris Martin Thompson Robinson Clark Lewis Walker Hall Allen Young King Wright Hill Scott Green Adams Baker Nelson Carter Mitchell Parker Collins".split()
FAMILY_CYR = "Иванов Петров Сидоров Кузнецов Смирнов Попов Соколов Лебедев Козлов Новиков Морозов Волков".split()
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Dr": "", "Herr": "m", "Frau": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Господин": "m", "Госпожа": "f"}
GIVEN = {**{n: "m:lat" for n in MALE}, **{n: "f:lat" for n in FEMALE}, **{n: "m:cyr" for n in MALE_CYR}, **{n: "f:cyr" for n in FEMALE_CYR}}
#: n: found by a cue, gender not known.
POOLS = {"m:lat": MALE, "f:lat": FEMALE, "n:lat": MALE + FEMALE, "m:cyr": MALE_CYR, "f:cyr": FEMALE_CYR, "n:cyr": MALE_CYR + FEMALE_CYR}
#: What a person's full name follows, with only spaces between.
CUES = ["(?i:my name is)", "(?i:i am called)", "Name:", "Contact:", "Contact person:", "Author:", "Attn:", "Signed:", "Signed by", "Dear", "Sincerely,", "Regards,", "(?i:ich heiße)", "(?i:mein name ist)", "(?i:je m['’]appelle)", "(?i:me llamo)", "(?i:mi nombre es)", "(?i:меня зовут)"]
_UPPER, _LOWER = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĹĻĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽȘȚ", "a-zß-öø-ÿāăąćčďđēėęěğģīįıķĺļľłńņňōőœŕřśşšţťūůűųźżžșț"
_CAP = rf"(?:(?:Mc|Mac|[A-Z]['’])?[{_UPPER}][{_LOWER}]{{2,}}(?:-[{_UPPER}][{_LOWER}]{{2,}})*|[А-ЯЁ][а-яё]{{2,}}(?:-[А-ЯЁ][а-яё]{{2,}})*)"
NAME = re.compile(rf"\b(?:(?P<given>{'|'.join(GIVEN)})[ ](?P<family>{_CAP})|(?P<title>{'|'.join(TITLES)})\.?[ ](?P<family2>{_CAP})|(?:{'|'.join(CUES)})[ ](?P<given3>{_CAP})[ ](?P<family3>{_CAP}))\b")

#: A span of text, its kind, and the parts of it that are mapped: (start, end, key kind, canonical form).
Found = tuple[int, int, str, list[tuple[int, int, str, str]]]


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _is_card(digits: str) -> bool:
    return luhn(digits) and len(set(digits)) > 1


def _script(name: str) -> str:
    return "cyr" if name[0] > "Ѐ" else "lat"


def _family(name: str, gender: str) -> tuple[str, str]:
    """(key kind, canonical form) of a family name: Cyrillic feminine endings belong to the masculine form."""
    if _script(name) == "cyr" and name.endswith(("ова", "ева", "ина")) and gender != "m":
        return "family:cyr", name[:-1]
    return f"family:{_script(name)}", name


def _phone_end(text: str, head: re.Match[str]) -> int:
    """End of the longest phone number that begins with ``head``, 0 if there is none.

    Beyond the fewest digits it goes on only past the separator that it used last, and not into a card
    number or over the most digits (11 with the country code 1), so that a number behind it stays apart.
    """
    bare = re.sub(r"\D", "", head[0])
    least, most = PHONE_DIGITS[0], 11 if "+" in head[0] and bare[:1] == "1" else PHONE_DIGITS[-1]
    if not bare and text[head.end()] != "0":
        return m.end() if (m := PHONE_BARE.match(text, head.end())) else 0
    n, at, groups, sep, end = len(bare), head.end(), int(bool(bare)), None, 0
    while (m := PHONE_GROUP.match(text, at)) and n + len(m[1]) <= most:
        between = text[at] if groups and at > head.end() else None
        if end and (between != sep or (CARD_AHEAD.match(text, at) and luhn(re.sub(r"\D", "", CARD_AHEAD.match(text, at)[1])))):
            break
        n, at, groups, sep = n + len(m[1]), m.end(), groups + 1, between
        if n >= least and groups > 1 and (at == len(text) or not (text[at].isalnum() or text[at] in "_-")):
            end = at
    return end


def phones(text: str) -> Iterator[tuple[int, int]]:
    """Spans of phone numbers; after a beginning that leads to none the search goes on at the next group."""
    at = 0
    while head := PHONE.search(text, at):
        if end := _phone_end(text, head):
            yield head.start(), end
        at = end or (head.end() if head[0] else PHONE_GROUP.match(text, head.end()).end())


def _without(text: str, found: list[Found]) -> str:
    """``text`` with a sign that belongs to no entity in place of every character of ``found``."""
    pieces, at = [], 0
    for a, b, *_ in sorted(found, key=lambda f: f[:2]):
        if b > at:
            pieces += [text[at : max(a, at)], chr(0) * (b - max(a, at))]
            at = b
    return "".join([*pieces, text[at:]])


def mails(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, place of the @, end) of mail addresses, each sought backwards from its @, so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        while start < at and not text[start].isalnum():
            start += 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, at, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def detect(text: str) -> list[Found]:
    """Non-overlapping entities by place; an earlier kind of KINDS wins where two overlap."""
    out: list[Found] = []
    digits = re.search(r"\d", text) is not None
    out += [(a, b, "email", [(a, at, "local", text[a:at].lower()), (at + 1, b, "domain", text[at + 1 : b].lower())]) for a, at, b in mails(text)]
    if digits:
        for m in IBAN.finditer(text):
            if _mod97(form := m[0].replace(" ", "")) == 1:
                out.append((*m.span(), "iban", [(*m.span(), "iban", form)]))
        for m in IP.finditer(_without(text, out)):
            if all(int(x) < 256 for x in m[0].split(".")):
                out.append((m.start(), m.end(), "ip", [(m.start(), m.end(), "ip", m[0])]))
        # What is taken is blanked before the next kind is sought, so that no match runs on into it: phone numbers with
        # a code or an area in brackets, then cards, then bare phone numbers.
        left = _without(text, out)
        marked = [(a, b) for a, b in phones(left) if text[a] in "+("]
        out += [(a, b, "phone", [(a, b, "phone", re.sub(r"\D", "", text[a:b]))]) for a, b in marked]
        left = _without(left, out)
        out += (cards := [(*m.span(), "card", [(*m.span(), "card", re.sub(r"\D", "", m[0]))]) for m in CARD.finditer(left) if _is_card(re.sub(r"\D", "", m[0]))])
        out += [(a, b, "phone", [(a, b, "phone", re.sub(r"\D", "", text[a:b]))]) for a, b in phones(_without(left, cards))]
    for m in NAME.finditer(text):
        if m["given"]:
            gender = GIVEN[m["given"]][0]
            parts = [(*m.span("given"), f"given:{GIVEN[m['given']]}", m["given"]), (*m.span("family"), *_family(m["family"], gender))]
        elif m["given3"]:
            gender = GIVEN.get(m["given3"], "n")[0]
            parts = [(*m.span("given3"), f"given:{gender}:{_script(m['given3'])}", m["given3"]), (*m.span("family3"), *_family(m["family3"], gender))]
        else:
            parts = [(*m.span("family2"), *_family(m["family2"], TITLES[m["title"]]))]
        out.append((parts[0][0], parts[-1][1], "name", parts))
    # Entities that are taken do not overlap, so only the neighbours in order of place can meet the next one.
    taken: list[Found] = []
    for f in sorted(out, key=lambda f: (KINDS.index(f[2]), f[0])):
        i = bisect(taken, f[:1], key=lambda t: t[:1])
        if (i == 0 or taken[i - 1][1] <= f[0]) and (i == len(taken) or f[1] <= taken[i][0]):
            taken.insert(i, f)
    return taken


def _stream(kind: str, form: str, attempt: int, key: bytes) -> Callable[[int], int]:
    """Keyed pseudo-random numbers below a bound."""
    state = {"n": 0, "pool": b""}

    def draw(bound: int) -> int:
        if len(state["pool"]) < 8:
            state["pool"] = hmac.digest(key, f"{kind}|{form}|{attempt}|{state['n']}".encode(), hashlib.sha256)
            state["n"] += 1
        value, state["pool"] = int.from_bytes(state["pool"][:8]), state["pool"][8:]
        return value % bound

    return draw


def _like(form: str, draw: Callable[[int], int]) -> str:
    return "".join(chr(48 + draw(10)) if c.isdigit() and c.isascii() else chr(97 + draw(26)) if "a" <= c <= "z" else c for c in form)


def surrogate(kind: str, form: str, attempt: int = 0, key: bytes = KEY) -> str:
    """Surrogate of a canonical form, itself in canonical form."""
    draw = _stream(kind, form, attempt, key)
    # From CROWDED attempts on the forms of this length may all be in use: surrogates get ever longer.
    more = attempt // CROWDED
    letters = lambda: "".join(chr(97 + draw(26)) for _ in range(more))
    if kind == "local":
        return _like(form, draw) + letters()
    if kind == "domain":
        labels = form.split(".")
        made = [_like(x, draw) for x in labels[:-1]]
        return ".".join([made[0] + letters(), *made[1:], labels[-1]])
    if kind == "ip":
        return ".".join(str(1 + draw(254)) for _ in range(4))
    if kind == "phone":
        return form[:1] + "".join(str(draw(10)) for _ in range(len(form) - 1 + more))
    if kind == "iban":
        body = "".join(str(draw(10)) if c.isdigit() else chr(65 + draw(26)) for c in form[4:])
        return f"{form[:2]}{98 - _mod97(f'{form[:2]}00{body}'):02}{body}"
    if kind == "card":
        body = form[0] + "".join(str(draw(10)) for _ in form[1:-1])
        good = next(d for d in "0123456789" if luhn(body + d))
        return body + (good if luhn(form) else str((int(good) + 1 + draw(9)) % 10))
    script = kind.rpartition(":")[2]
    pool = POOLS[kind.removeprefix("given:")] if kind.startswith("given:") else (FAMILY_CYR if script == "cyr" else FAMILY)
    name = pool[draw(len(pool))]
    if attempt < CROWDED:
        return name
    # The pool is crowded: a composed name of the same script and ending.
    syllables = "ба ви го ду зе ки ло му но ри са ту".split() if script == "cyr" else "ba vi go du ze ki lo mu no ri sa tu".split()
    return "".join(syllables[draw(12)] for _ in range(2 + more)).capitalize() + name.lower()


def poured(original: str, kind: str, new: str) -> str:
    """The canonical surrogate in the layout and case of the original."""
    if kind in ("phone", "card"):
        rest = iter(new)
        return "".join(next(rest) if c.isdigit() else c for c in original) + "".join(rest)
    if kind == "iban":
        rest = iter(new)
        return "".join(c if c == " " else next(rest) for c in original)
    if kind in ("local", "domain"):
        # A local part is cased as a whole, a domain label by label: the made one may be longer.
        pairs = zip(original.split("."), new.split("."), strict=True) if kind == "domain" else [(original, new)]
        return ".".join("".join(n.upper() if o.isupper() else n for o, n in zip_longest(old, made, fillvalue="")) for old, made in pairs)
    if kind == "family:cyr" and original[-1] == "а":
        return new + "а"
    return new


def replace(text: str, found: list[Found], attempts: dict[tuple[str, str], int], key: bytes = KEY) -> str:
    out, at = [], 0
    for _, _, _, parts in found:
        for a, b, kind, form in parts:
            out += [text[at:a], poured(text[a:b], kind, surrogate(kind, form, attempts.get((kind, form), 0), key))]
            at = b
    return "".join([*out, text[at:]]) if out else text


def _listing(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        out: list[tuple] = []
        for i, text in enumerate(batch.column("text")):
            if text.is_valid:
                out += [(i, kind, form) for _, _, _, parts in detect(text.as_py()) for _, _, kind, form in parts]
        row = pa.array([x[0] for x in out], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("th").take(row), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())], ["doc_id", "th", "kind", "form"])


def _drawn(key: bytes):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            made = [surrogate(k, f, a, key) for k, f, a in zip(*(batch.column(c).to_pylist() for c in ("kind", "form", "attempt")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "form", "attempt")), pa.array(made, pa.string())], ["kind", "form", "attempt", "made"])

    return run


def later_attempts(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, form, attempt) of the distinct entities whose first surrogate collides; checked until none does.

    A surrogate loses if it is the entity itself, another entity's of its kind with an earlier attempt (then form),
    or a real entity (not for names: their pools are small and hold real names). Only losers are drawn again.
    """
    real = saved(entities.select("kind", "form").distinct())
    drawn = lambda rows: rows.mapInArrow(_drawn(key), "kind string, form string, attempt int, made string")
    current = saved(drawn(real.withColumn("attempt", F.lit(0))))
    while True:
        first = current.groupBy("kind", "made").agg(F.min(F.struct("attempt", "form")).alias("first"), F.count("*").alias("n"))
        taken = real.where(~F.col("kind").rlike("^(given|family)")).select("kind", F.col("form").alias("made"), F.lit(True).alias("taken"))
        judged = current.join(first, ["kind", "made"]).join(taken, ["kind", "made"], "left")
        lost = (F.col("made") == F.col("form")) | (F.struct("attempt", "form") != F.col("first")) | F.coalesce("taken", F.lit(False))
        judged = saved(judged.select("kind", "form", "attempt", "made", lost.alias("lost")))
        if judged.where("lost").isEmpty():
            drop(real, judged)
            return current.where("attempt > 0").select("kind", "form", "attempt")
        again = drawn(judged.where("lost").select("kind", "form", (F.col("attempt") + 1).alias("attempt")))
        drop(current)
        current = saved(judged.where("not lost").select("kind", "form", "attempt", "made").unionByName(again))
        drop(judged)


def _rewriting(shipped: dict[tuple[str, str], int], key: bytes):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts: list[str | None] = []
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            own = batch.column("attempts") if "attempts" in batch.schema.names else None
            for i, text in enumerate(batch.column("text")):
                found = detect(text.as_py()) if text.is_valid else []
                attempts = shipped
                if own is not None and own[i].is_valid:
                    attempts = {(x["kind"], x["form"]): x["attempt"] for x in own[i].as_py()}
                texts.append(replace(text.as_py(), found, attempts, key) if text.is_valid else None)
                for k in KINDS:
                    counts[k].append(sum(f[2] == k for f in found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), *[pa.array(counts[k], pa.int64()) for k in KINDS]], ["doc_id", "text", *[f"n_{k}" for k in KINDS]])

    return run


def pseudonymise(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, the text with surrogates, and the number of entities of each kind, row by row."""
    kind = id_type(docs)
    texts = keyed(docs)
    listed = texts.mapInArrow(_listing, f"doc_id {kind}, th binary, kind string, form string")
    later = later_attempts(listed, key)
    later = saved(later)
    shipped: dict[tuple[str, str], int] = {}
    if later.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        shipped = {(r["kind"], r["form"]): r["attempt"] for r in later.collect()}  # at most BROADCAST_ROWS
        rows = texts.select("doc_id", "text")
    else:
        own = listed.distinct().join(later, ["kind", "form"]).groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("kind", "form", "attempt")).alias("attempts"))
        rows = texts.join(own, same_row(texts, own), "left").select("doc_id", "text", "attempts")
    return rows.mapInArrow(_rewriting(shipped, key), f"doc_id {kind}, text string, " + ", ".join(f"n_{k} bigint" for k in KINDS))


def op7_surrogates(spark, sf_dir: str) -> DataFrame:
    out = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    total = F.col("n_email") + F.col("n_iban") + F.col("n_phone") + F.col("n_ip") + F.col("n_card") + F.col("n_name")
    return out.withColumn("n_entities", total).select("doc_id", "n_entities", *[f"n_{k}" for k in KINDS], "text")
