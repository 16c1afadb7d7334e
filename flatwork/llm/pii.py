"""Operator 4: personal data, by native columns only.

A regular expression proposes spans, a checksum or a bound confirms them, and words near by adjust the
score. The patterns match where the plain ones of each kind do (leftmost, non-overlapping) but never go
back over a run of letters or digits, so their time is linear in the text. An IBAN is as long as its country
says; its proposals may overlap, and those that fail mod 97 hide no other (see `_iban_cut`).

Positions come from two native functions: the matches of a pattern, and the text split at it. Both cost one
pass, and only texts that hold a match pay for them. Sums of lengths are taken in two levels, so a text with
very many matches stays cheap. Nothing is shuffled.

Kinds: email, ip, card (Luhn), phone are the base and always reported; iban (mod 97) and ssn are added when
their score reaches MIN_SCORE. Positions are code points, the end exclusive. Null and empty texts hold
nothing. Rows are independent of each other; other columns pass through, and a column with the name of a
result is replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from flatwork.functions.coerce import col

MIN_SCORE = 0.5
CONTEXT_LETTERS = 48
SUM_BLOCK = 256

_LOCAL = "[A-Za-z0-9._%+-]"
_HOST = "[A-Za-z0-9-]"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _between(c: Column, low: int, high: int) -> Column:
    return (c >= low) & (c <= high)


def luhn(match: Column) -> Column:
    """Whether the digits of a text pass the Luhn check."""
    digits = F.reverse(F.filter(F.split(_digits(match), ""), lambda d: d != ""))
    value = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(digits, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether letters and digits pass the mod-97 check of an IBAN: the first four go last, a letter counts 10 to 35."""
    plain = F.upper(F.regexp_replace(match, "[^A-Za-z0-9]", ""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    letters = F.filter(F.split(turned, ""), lambda c: c != "")

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(letters, F.lit(0), step) == 1


def _ip(match: Column) -> Column:
    part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
    return F.forall(F.split(match, r"\."), lambda p: part(p) & (F.right(p, F.lit(3)).cast("int") <= 255))


#: Letters and digits of an IBAN by country: the ISO 13616 registry, and countries that use one without an entry.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}

#: Where an IBAN may begin; it is the group, so that one may begin inside another.
_IBAN = (
    r"(?=[A-Z]{2}[0-9]{2})(?<![A-Za-z0-9])(?=("
    + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, c in IBAN_COUNTRIES.items())
    + "))"
)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    confirm: Callable[[Column], Column]
    likely: str  # words near by that raise the score
    doubtful: str  # and that lower it
    base: bool = True


KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++", 0.9, lambda m: F.lit(True), "mail|contact|write|kontakt|correo|courriel", "example"),
    Kind("ip", r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, _ip, "ip|address|server|host|login", "version|release|section|kapitel"),
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9]){13,}+", 0.7,
        lambda m: _between(F.length(_digits(m)), 14, 19) & luhn(m), "card|visa|mastercard|credit|payment|karte|carte|tarjeta", "order|serial|isbn|tracking",
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7,
        lambda m: _between(F.length(_digits(m)), 10, 15), "phone|call|tel|mobile|fax|telefon|teléfono", "sum|total|plus",
    ),
    Kind(
        "iban", _IBAN, 0.8, mod97, "iban|account|bank|konto|compte|cuenta", "serial|key", False,
    ),
    Kind(
        "ssn", r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4,
        lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"), "ssn|social|security|taxpayer", "order|part|serial", False,
    ),
)


def _add(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda a, x: a + x)


def _blocks(lengths: Column) -> Column:
    """Sums of every SUM_BLOCK lengths."""
    numbers = F.sequence(F.lit(0), F.floor(F.size(lengths) / SUM_BLOCK).cast("int"))
    return F.transform(numbers, lambda b: _add(F.slice(lengths, b * SUM_BLOCK + 1, F.lit(SUM_BLOCK))))


def _upto(lengths: Column, blocks: Column, i: Column) -> Column:
    """The sum of the first i lengths: whole blocks, then the rest of one."""
    whole = F.floor(i / SUM_BLOCK).cast("int")
    return _add(F.slice(blocks, F.lit(1), whole)) + _add(F.slice(lengths, whole * SUM_BLOCK + 1, i - whole * SUM_BLOCK))


def _cut(text: Column, kind: Kind) -> Column:
    """An array of one struct: the matches m of a pattern and the pieces p between them. What follows reads
    them from the element, so each is computed once."""
    if kind.pattern == _IBAN:
        return _iban_cut(text)
    return F.array(F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"), F.split(text, kind.pattern, -1).alias("p")))


def _iban_cut(text: Column) -> Column:
    """The same for IBANs that pass mod 97, leftmost first. The text is split where a proposal begins (a blank in
    front gives every proposal a piece before it), and the pieces between two passed ones are joined again."""
    proposed = F.struct(F.regexp_extract_all(text, F.lit(_IBAN), F.lit(1)).alias("a"), F.split(F.concat(F.lit(" "), text), _IBAN, -1).alias("q"))
    numbers = lambda a: F.filter(F.transform(a, lambda x, i: F.when(mod97(x), i)), lambda i: i.isNotNull())
    passed = F.transform(F.array(proposed), lambda h: F.struct(h["a"].alias("a"), h["q"].alias("q"), numbers(h["a"]).alias("g")))
    between = lambda h, i, j: F.array_join(F.slice(h["q"], i + 2, j - i), "")  # noqa: E731  from the begin of i to that of j
    inside = lambda h, i, j: F.length(between(h, i, j)) < F.length(F.get(h["a"], i))

    def apart(h: Column) -> Column:
        """Those that do not begin inside the last one taken; a fold only where any do."""
        none = F.slice(h["g"], 1, 0)
        taken = lambda t, j: F.when((F.size(t) > 0) & inside(h, F.element_at(t, -1), j), t).otherwise(F.concat(t, F.array(j)))
        meet = F.exists(F.transform(h["g"], lambda j, k: (k > 0) & inside(h, F.get(h["g"], F.greatest(k - 1, F.lit(0))), j)), lambda x: x)
        return F.struct(h["a"].alias("a"), h["q"].alias("q"), F.when(meet, F.aggregate(h["g"], none, taken)).otherwise(h["g"]).alias("g"))

    def cut(h: Column) -> Column:
        ends = F.concat(h["g"], F.array(F.size(h["a"])))
        begins = F.concat(F.array(F.lit(-1)), h["g"])
        skip = lambda i: F.when(i < 0, 1).otherwise(F.length(F.get(h["a"], F.greatest(i, F.lit(0)))))  # noqa: E731  the blank, or the IBAN
        pieces = F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda x: F.substr(between(h, x["b"], x["e"]), skip(x["b"]) + 1))
        return F.struct(F.transform(h["g"], lambda i: F.get(h["a"], i)).alias("m"), pieces.alias("p"))

    return F.transform(F.transform(passed, apart), cut)


def _accepted(kind: Kind, match: Column, pieces: Column, i: Column) -> tuple[Column, Column]:
    """Whether match i counts, and its score."""
    up, down = _near(pieces, i, kind.likely), _near(pieces, i, kind.doubtful)
    score = F.lit(kind.score) + F.when(up, 0.2).otherwise(0.0) - F.when(down, 0.3).otherwise(0.0)
    return (kind.confirm(match) if kind.base else kind.confirm(match) & (score >= MIN_SCORE)), score


def _near(pieces: Column, i: Column, words: str) -> Column:
    """Whether one of the words stands close before or behind match i."""
    around = F.lower(F.concat(F.right(F.get(pieces, i), F.lit(CONTEXT_LETTERS)), F.lit(" "), F.left(F.get(pieces, i + 1), F.lit(CONTEXT_LETTERS))))
    return around.rlike(rf"(?<![a-z])({words})")


def _spans_of(text: Column, kind: Kind, rank: int) -> Column:
    """start, rank, end, kind and score of the confirmed matches of one kind, in order."""
    sized = F.transform(
        _cut(text, kind),
        lambda h: F.struct(h["m"].alias("m"), h["p"].alias("p"), F.transform(h["m"], lambda x: F.length(x)).alias("ml"), F.transform(h["p"], lambda x: F.length(x)).alias("pl")),
    )
    held = F.transform(
        sized, lambda h: F.struct(h["m"].alias("m"), h["p"].alias("p"), h["ml"].alias("ml"), h["pl"].alias("pl"), _blocks(h["ml"]).alias("mb"), _blocks(h["pl"]).alias("pb"))
    )

    def spans(h: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            start = _upto(h["pl"], h["pb"], i + 1) + _upto(h["ml"], h["mb"], i)
            ok, score = _accepted(kind, x, h["p"], i)
            return F.when(ok, F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x)).alias("end"), F.lit(kind.name).alias("kind"), score.alias("score")))

        return F.filter(F.transform(h["m"], span), lambda s: s.isNotNull())

    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>")
    return F.when(text.rlike(kind.pattern), F.flatten(F.transform(held, spans))).otherwise(none)


def find(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Add all spans of a text, ordered by start and then by kind: start, rank (of the kind), end, kind, score."""
    whole = F.coalesce(col(text), F.lit(""))
    return df.withColumn(out, F.array_sort(F.concat(*[_spans_of(whole, k, i) for i, k in enumerate(KINDS)])))


def written(spans: Column, base_only: bool = False) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = [k.name for k in KINDS if k.base]
    picked = F.filter(spans, lambda s: s["kind"].isin(names)) if base_only else spans
    return F.array_join(F.transform(picked, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace personal data by the name of its kind in brackets, kind after kind. A null text stays null."""
    for kind in KINDS:
        df = df.withColumn(text, _redacted(col(text), kind))
    return df


def _redacted(text: Column, kind: Kind) -> Column:
    def joined(h: Column) -> Column:
        def part(p: Column, i: Column) -> Column:
            m = F.get(h["m"], i)
            ok, _ = _accepted(kind, m, h["p"], i)
            return F.when(m.isNull(), p).otherwise(F.concat(p, F.when(ok, F.lit(f"[{kind.name.upper()}]")).otherwise(m)))

        return F.concat_ws("", F.transform(h["p"], part))

    return F.when(text.rlike(kind.pattern), F.get(F.transform(_cut(text, kind), joined), F.lit(0))).otherwise(text)
