"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust a score. Native only.

Positions come from two native passes: the pieces between matches (``split``) and the matches (``regexp_extract_all``)
alternate, so a running sum of their lengths gives each span in code points, with no marker put into the text.

The patterns are the contract's with possessive loops and a start anchor: a match may begin where a run of its first
class begins or right after the previous match (``\\G``). Both leave the leftmost greedy matches unchanged and keep
long runs linear. Sums over matches run in chunks of ``CHUNK``, so that a text with many of them stays near linear too.

Every span has a score: its pattern's, more with words near it that speak for personal data, less with words that speak
against it (a version number, a commit). Spans of the contract's kinds stay whatever their score; those that the method
adds stay from ``LEAST_SCORE`` on, and masking goes by the same bound. So a bare key is a secret only beside a word like
``token``, and 1.2.3.4 beside ``version`` isn't masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import fresh

# Kinds in the contract's order, then the kinds that the method adds.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The head of an IBAN; where it ends is settled by ``_iban_at``, so that nothing after it is swallowed.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})"
SECRET = r"(?i:password|passwd|secret|api_key|token)\x20{0,2}[=:]\x20{0,2}\"?[A-Za-z0-9_-]{16,64}+"
#: Keys without a name before them: of known makers, or 32, 40 or 64 hexadecimal digits.
KEY = r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9_-])"
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "secret", "key")
KINDS = BASE + ADDED
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "secret": SECRET, "key": KEY}
#: Characters of an IBAN by country, as registered; other countries may have any length from 15 to 34.
IBAN_LENGTHS = {
    country: int(n)
    for n, countries in (x.split(":") for x in (
        "15:NO|16:BE|18:DK FI FK FO GL NL SD|19:MK SI|20:AT BA EE KZ LT LU MN XK|21:CH HR LI LV|22:BG BH CR DE GB GE IE ME RS VA|23:AE GI IL IQ OM SO TL|24:AD CZ ES MD PK RO SA SE SK TN VG|25:LY PT ST"
        "|26:IS TR|27:BI DJ FR GR IT MC MR SM|28:AL AZ BY CY DO GT HN HU LB NI PL SV|29:BR EG PS QA UA|30:JO KW MU YE|31:MT SC|32:LC|33:RU"
    ).split("|"))
    for country in countries.split()
}
#: A cheap test that any text with a span of the kind passes; texts that fail it skip the kind's patterns.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]{11}", "secret": r"(?i:password|passwd|secret|api_key|token)\x20{0,2}[=:]", "key": r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|[0-9a-f]{32}"}
#: Words near a span that raise its score, and words that lower it.
CONTEXT = {"email": r"(?i)e-?mail|contact|write|@", "ip": r"(?i)\bip\b|host|server|address", "card": r"(?i)card|visa|credit|payment", "phone": r"(?i)phone|\btel\b|call|mobile|\bfax\b", "iban": r"(?i)iban|account|bank", "secret": r"(?i)password|token|secret|key", "key": r"(?i)password|passwd|token|secret|\bkey\b|api|auth|bearer|credential"}
AGAINST = {"email": r"(?i)user@example|noreply", "ip": r"(?i)version|release|\bsection\b|\bbuild\b", "card": r"(?i)isbn|serial|tracking", "phone": r"(?i)isbn|serial|invoice", "iban": r"(?i)sample iban", "secret": r"(?i)placeholder|changeme", "key": r"(?i)commit|checksum|md5|sha-?\d|\brevision\b"}
#: Score of a span whose pattern and checksum hold, without such words; what they add and take away, and how near they are.
SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.9, "secret": 0.8, "key": 0.4}
FOR, AGAINST_BY, WINDOW = 0.1, 0.3, 40
#: Spans that the method adds, and masked ones, have this score at least.
LEAST_SCORE = 0.5
CHUNK = 256


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chunks(values: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(CHUNK)), lambda at: F.slice(values, at, CHUNK))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes Luhn: from the right, every second digit doubled, digits summed, a multiple of 10."""
    d = F.split(F.reverse(digits), "")
    n = F.transform(F.filter(d, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(n, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN passes: first four characters moved to the end, letters as 10 to 35, remainder 1 by 97."""
    s = F.regexp_replace(iban, " ", "")
    chars = F.filter(F.split(F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4)), ""), lambda c: c != "")
    value = lambda c: F.when(c < "A", c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c < "A", (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97)) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    if kind == "card":
        n = F.length(_digits(m))
        return n.between(13, 19) & F.when(n.between(13, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _iban_at(s: Column) -> Column:
    """The IBAN that ``s`` begins with, null if there is none: of the ends before a blank or a mark those of the
    country's length that pass mod 97, and of several the last."""
    most = F.regexp_extract(s, r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", 0)
    groups = F.split(most, " ")
    ends = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda n: F.array_join(F.slice(groups, 1, n), " "))
    lengths = F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair))

    def passes(m: Column) -> Column:
        n = F.length(F.regexp_replace(m, " ", ""))
        fits = n.between(15, 34) & (n == F.coalesce(F.try_element_at(lengths, F.substring(m, 1, 2)), n))
        return F.when(fits, mod97(m)).otherwise(False)

    return F.try_element_at(F.filter(ends, passes), F.lit(-1))


def _ibans(heads: Column, text: Column) -> Column:
    """The spans of heads made whole; heads without an IBAN, and those inside the one before, are dropped."""
    whole = F.transform(heads, lambda s: F.struct(s["start"].alias("start"), _iban_at(F.substring(text, s["start"] + 1, F.lit(68))).alias("m")))
    start = F.array().cast("array<struct<kind:string,start:int,end:int,match:string>>")

    def step(a: Column, s: Column) -> Column:
        span = F.struct(F.lit("iban").alias("kind"), s["start"].alias("start"), (s["start"] + F.length(s["m"])).alias("end"), s["m"].alias("match"))
        inside = F.coalesce(F.try_element_at(a, F.lit(-1))["end"] > s["start"], F.lit(False))
        return F.when(inside, a).otherwise(F.concat(a, F.array(span)))

    return F.aggregate(F.filter(whole, lambda s: s["m"].isNotNull()), start, step)


def _spans(kind: str, text: Column) -> Column:
    """array<struct<kind,start,end>> of the matches that their validator confirms, by start."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,match:string>>")
    gaps, found = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    pairs = F.zip_with(F.transform(gaps, lambda g: F.length(g)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))

    def step(a: Column, p: Column) -> Column:
        at = a["at"] + p["gap"]
        end = at + F.length(p["m"])
        span = F.array(F.struct(F.lit(kind).alias("kind"), at.alias("start"), end.alias("end"), p["m"].alias("match")))
        return F.when(p["m"].isNull(), F.struct(at.alias("at"), a["out"].alias("out"))).otherwise(F.struct(end.alias("at"), F.concat(a["out"], span).alias("out")))

    def placed(chunks: Column) -> Column:
        sizes = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, p: a + p["gap"] + F.coalesce(F.length(p["m"]), F.lit(0))))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        begins = F.aggregate(sizes, first, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        return F.flatten(F.zip_with(chunks, begins, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"])))

    every = _bound(pairs, lambda p: _bound(_chunks(p), placed))
    needed = text.contains(NEEDS[kind]) if kind == "email" else text.rlike(NEEDS[kind])
    valid = _ibans(every, text) if kind == "iban" else F.filter(every, lambda s: _valid(kind, s["match"]))
    return F.when(needed, valid).otherwise(none)


def _scored(kind: str, spans: Column, text: Column) -> Column:
    def score(s: Column) -> Column:
        left = F.greatest(s["start"] - WINDOW, F.lit(0))
        near = F.concat(F.substring(text, left + 1, s["start"] - left), F.lit(" "), F.substring(text, s["end"] + 1, F.lit(WINDOW)))
        value = F.lit(SCORE[kind]) + F.when(near.rlike(CONTEXT[kind]), FOR).otherwise(0.0) - F.when(near.rlike(AGAINST[kind]), AGAINST_BY).otherwise(0.0)
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.round(value, 2).alias("score"))

    scored = F.transform(spans, score)
    return F.filter(scored, lambda s: s["score"] >= LEAST_SCORE) if kind in ADDED else scored


def _joined(kinds: tuple[str, ...], show) -> Column:
    return F.array_join(F.concat(*(F.transform(f"_{k}", show) for k in kinds)), ",")


def _placed(s: Column) -> Column:
    return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_email`` .. ``_key``: array<struct<kind,start,end,score>> in code points, end exclusive, by start.

    A null or empty text has no spans. A proposal that its validator refuses is dropped and nothing is retried inside
    it; an IBAN, whose blanks may go on into the next word, is tried at every end. Words near a span raise or lower its
    score; spans of the added kinds below ``LEAST_SCORE`` are dropped, others stay. All columns of ``docs`` stay; its
    columns of the added names are replaced.
    """
    docs = docs.drop(*(f"_{k}" for k in KINDS))
    t = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumns({f"_{k}": _spans(k, t) for k in KINDS})
    return docs.withColumns({f"_{k}": _scored(k, F.col(f"_{k}"), t) for k in KINDS})


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find_pii``'s, and the scores of the spans in their order."""
    return found.select(
        "doc_id",
        *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(BASE, _placed).cast("binary"), 256).alias("base_sha256"),
        _joined(KINDS, _placed).alias("spans"),
        _joined(KINDS, lambda s: F.format_string("%.2f", s["score"])).alias("scores"),
    )


def mask(docs: DataFrame, least_score: float = LEAST_SCORE, text: str = "text") -> DataFrame:
    """Replaces each span by its kind in brackets, as ``[email]``; overlapping spans become one of the first's kind.

    Texts without a span stay as they are, null ones too. ``n_chars``, where there is one, follows the new text. A
    span below ``least_score`` stays in the text. Same rows and columns out as in, also columns named like a kind's.
    """
    own = docs.columns
    whole, spans, masks = fresh(docs, "whole", "spans", "masks")
    found = find_pii(docs.select(F.struct(*own).alias(whole), F.col(text).alias(text)), text)
    every = F.transform(F.filter(F.concat(*(F.col(f"_{k}") for k in KINDS)), lambda s: s["score"] >= least_score), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    found = found.select(whole, text, F.array_sort(every).alias(spans))
    t = F.col(text)
    none = F.array().cast("array<string>")

    def step(a: Column, s: Column) -> Column:
        more = F.concat(a["out"], F.array(F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), s["kind"], F.lit("]"))))
        return F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), more.alias("out")))

    def chunk(a: Column, c: Column) -> Column:
        inner = F.aggregate(c, F.struct(a["at"].alias("at"), none.alias("out")), step, lambda x: F.struct(x["at"].alias("at"), F.array_join(x["out"], "").alias("out")))
        return _bound(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(a["out"], F.array(x["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    masked = F.aggregate(_chunks(F.col(spans)), start, chunk, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, a["at"] + 1, F.length(t))))
    some = F.size(spans) > 0
    new = F.when(some, masked).otherwise(t)
    out = found.select(whole, some.alias(masks), new.alias(text))
    change = {text: F.col(text)}
    if "n_chars" in own:
        change["n_chars"] = F.when(F.col(masks), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(f"{whole}.n_chars"))
    return out.select(*((change[c] if c in change else F.col(f"{whole}.`{c}`")).alias(c) for c in own))
