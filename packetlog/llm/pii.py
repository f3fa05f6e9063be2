"""Format-preserving Feistel pseudonyms for personal data (operator 9).

Values are found by one pattern, validated by kind, and permuted within their
format by a keyed Feistel network (8 rounds, round function SHA-2 or MD5 of key,
kind, round and the other half). A permutation never joins two values, and equal
values get equal pseudonyms in every document, so records stay linked. Everything
runs as DataFrame functions.

| kind | validated by | permuted | kept |
|-|-|-|-|
| card | 13 to 19 digits, Luhn; also beside further digits (CVV, expiry) | digits between the first and the last | first digit, grouping, a valid check digit |
| date | a day of 1800 to 2199 | day number within the 400 years | order of the parts, separators |
| ssn | area, group and serial in use | the index among valid numbers | dashes |
| ip | four octets up to 255 | the 32-bit address | dots |
| phone | 10 digits of a North American number, or + and 8 to 15 digits | area, exchange and line within their ranges; else all digits after the country code | country code, grouping |
| email | a local part and a domain | letters and digits of the local part, by class | domain, punctuation |
| secret | AKIA keys; values of 8 or more characters after names that end in password, token and the like (a parameter), quoted or not, and after Authorization: Bearer | letters and digits (ASCII) by class (hexadecimal stays so) | name, quotes, punctuation |

Numbers use two halves modulo a and b, where a * b is exactly the number of valid
values, so no value falls outside its format. Texts use halves of characters,
each shifted within its class. Spellings of one number (grouping) share a
pseudonym. d/m/y dates are read as m/d/y where that is a date.

The key is a parameter: a secret of the user, never stored. Values that fail
their validation, and all other text, stay byte by byte. It is one pass over
whole texts without a shuffle; texts without a digit, @, =, : or AKIA, of which
every value has one, skip the pattern.

Edge cases: null text stays null with no values; empty text stays empty. Rows
with null or repeated ids are treated like any other; columns whatever their
names pass through ``pseudonymise``; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlog.llm import common as C

ROUNDS = 8
#: Key of the registered query, which needs a fixed one.
QUERY_KEY = "registered query, not a secret"
DAYS = 146_097  # of 400 Gregorian years: 189 * 773
FIRST_DAY = "1800-01-01"

_START, _STOP = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_AKIA = r"AKIA[0-9A-Z]{16}"
#: What names a secret; a blank stands for an optional _, - or blank.
SECRET_NAMES = ("password", "passwd", "passphrase", "pwd", "token", "secret", "secret key", "api key", "access key", "private key")
_QUOTE = r"\\?[\"']"
_IS = rf"(?:{_QUOTE})?\s*+(?::=|=>|[=:])\s*+"
#: Quoted values run to their closing quote (\" does not close), others to a blank, a
#: closing quote or the next parameter of a URL. Repeated parts are single characters:
#: Java's matcher needs no stack for those, however long the value.
_QUOTED = [rf"{q}(?!(?:[^{q}\\\r\n]|\\[^\r\n]){{0,7}}{q})(?=[^{q}\r\n]*?[\p{{L}}\p{{N}}])[^\r\n]{{8,}}?(?<!\\)(?={q})" for q in "\"'"]
_ESCAPED = r"\\\"[^\"\\\r\n]{8,}+(?=\\\")"
_ENDS = r"[\"'](?![\p{L}\p{N}_])|&\w{1,64}="
_CLOSING = ".,;:!?)]}>\"'\\"
_BARE = (rf"(?:{_QUOTE})?(?![\"']|\\[\"'])(?!\S{{0,7}}?(?:{_ENDS}))(?=\S{{7,}}?[^\s.,;:!?)\]}}>\"'\\])(?=\S*?[\p{{L}}\p{{N}}])"
         rf"\S{{8,}}?(?=\s|\z|{_ENDS})")
_EMAIL = r"(?<![\p{L}\p{N}._%+-])(?=[._%+-]*+[\p{L}\p{N}])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
_DATE = r"(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})"
_SSN = r"\d{3}-\d{2}-\d{4}"
_IP = r"\d{1,3}(?:\.\d{1,3}){3}(?!\.\d)"
_NANP = r"(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}"
_PHONE = r"\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,4}"
_FREE = r"(?<![\p{L}\p{N}_+])"
#: Forms that cards have in print: one run, or groups of four or more and a rest.
_GROUPS = [r"\d{13,19}"] + [r"\d{4,15}" + r"[ -]\d{4,15}" * k + rest for k in range(4) for rest in ("", r"[ -]\d{1,3}")][1:]
_DAY = r"(?:\d{4}(?:-\d{1,2}-|/\d{1,2}/|\.\d{1,2}\.)\d{1,2}|\d{1,2}(?:-\d{1,2}-|/\d{1,2}/|\.\d{1,2}\.)\d{4})"
#: What may follow a card's 13 digits after a blank: never a further part of it.
_NEXT = f"(?:{_DAY}|{_SSN}|{_IP}|{_NANP}|\\d{{13,19}}|\\d{{4}}(?:[ -]\\d{{4}}){{3}}|\\d{{4}}[ -]\\d{{6}}[ -]\\d{{4,5}})"
_CARD = r"\d(?:[ -]?\d){12}(?:(?:[ -](?!" + _NEXT + _STOP + r"))?\d){0,6}"
_DATED = f"{_DATE}(?:{_STOP}|(?=[Tt]\\d))"
#: What every match has at least one of.
NEEDED = "[0-9@=:]|AKIA"
_DATES = f"{_START}(?:{_DATED}|(?:{_SSN}|{_IP}){_STOP})"


def _lead(names) -> str:
    """Pattern of what stands before a secret's value. A name may be the end of a
    longer one (DB_PASSWORD) and stand in quotes."""
    words = "|".join("[ _-]?".join(re.escape(w) for w in n.split()) for n in names)
    scheme = rf"(?i:authorization){_IS}(?:{_QUOTE})?(?i:bearer|basic|token)\s++"
    return f"(?:{scheme}|(?i:{words}){_IS})" if words else f"(?:{scheme})"


def value_pattern(names=SECRET_NAMES, cards: bool = True) -> str:
    """The pattern that finds values, with secrets behind these names."""
    named = f"{_lead(names)}(?:{'|'.join([*_QUOTED, _ESCAPED, _BARE])})"
    numbers = [_NANP, _CARD, _PHONE] if cards else [_NANP, _PHONE]
    return "|".join([_START + _AKIA + _STOP, named, _EMAIL, _DATES, f"{_FREE}(?:{'|'.join(numbers)}){_STOP}"])


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced by ``digits``, in order."""
    def one(c: Column, i: Column) -> Column:
        before = F.length(_digits(F.substring(template, F.lit(1), i)))
        return F.when(c.rlike("[0-9]"), F.substring(digits, before + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(template, ""), one), "")


def _pair(left: Column, right: Column, a: int, b: int, key: str, kind: str) -> Column:
    """Feistel on Z_a x Z_b: struct(left, right)."""
    def draw(r: Column, other: Column, size: int) -> Column:
        code = F.md5(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), other.cast("string")).cast("binary"))
        return F.conv(F.substring(code, 1, 15), 16, 10).cast("long") % F.lit(size)

    def turn(s: Column, r: Column) -> Column:
        even = F.struct(((s["l"] + draw(r, s["r"], a)) % F.lit(a)).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), ((s["r"] + draw(r, s["l"], b)) % F.lit(b)).alias("r"))
        return F.when(r % 2 == 0, even).otherwise(odd)

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _shift(half: Column, other: Column, r: Column, key: str, kind: str) -> Column:
    """Each letter or digit of ``half`` moved within its class."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), other).cast("binary"), 512)
    hexadecimal = "0123456789abcdef"

    def one(code: Column, c: Column, i: Column) -> Column:
        by = F.conv(F.substring(code, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int") + F.floor(i / 64).cast("int") * 7

        def within(first: str, size: int) -> Column:
            return F.char(F.lit(ord(first)) + (F.ascii(c) - F.lit(ord(first)) + by) % F.lit(size))

        if kind == "hex":
            at = F.instr(F.lit(hexadecimal), c) - 1
            return F.when(c == "", c).otherwise(F.substring(F.lit(hexadecimal), (at + by) % 16 + 1, F.lit(1)))
        return (F.when(c.rlike("^[0-9]$"), within("0", 10)).when(c.rlike("^[a-z]$"), within("a", 26))
                .when(c.rlike("^[A-Z]$"), within("A", 26)).otherwise(c))

    # Bound once: a long half would be hashed anew for each of its characters.
    return _let(digest, lambda code: F.array_join(F.transform(F.split(half, ""), lambda c, i: one(code, c, i)), ""))


def _text(value: Column, key: str, kind: str) -> Column:
    """Feistel on the letters and digits of a string, in place. One character
    has no other half: it is shifted by key and kind alone."""
    cut = F.ceil(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), cut).alias("l"), F.substring(value, cut + 1, F.length(value)).alias("r"))

    def turn(s: Column, r: Column) -> Column:
        even = F.struct(_shift(s["l"], s["r"], r, key, kind).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), _shift(s["r"], s["l"], r, key, kind).alias("r"))
        return F.when(r % 2 == 0, even).otherwise(odd)

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
    return F.concat(done["l"], done["r"])


def _luhn(payload: Column) -> Column:
    """Check digit of a string of digits."""
    def term(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    terms = F.transform(F.split(F.reverse(payload), ""), term)
    total = F.aggregate(terms, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return ((F.lit(10) - total % 10) % 10).cast("string")


def _is_card(m: Column) -> Column:
    d = _digits(m)
    return F.length(d).between(13, 19) & (_luhn(F.substring(d, F.lit(1), F.length(d) - 1)) == F.right(d, F.lit(1)))


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    new = F.concat(F.left(d, F.lit(1)), _text(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
    return F.when(_is_card(m), _refill(m, F.concat(new, _luhn(new))))


def _date(m: Column, key: str) -> Column:
    part = F.split(m, "[-/.]")
    a, b, c = (F.get(part, F.lit(k)) for k in range(3))
    first, last = F.make_date(F.lit(1800), F.lit(1), F.lit(1)), F.lit(DAYS)

    def read(y: Column, mo: Column, d: Column) -> Column:
        text = F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(mo, 2, "0"), F.lpad(d, 2, "0"))
        day = F.datediff(F.try_to_date(text, "yyyy-MM-dd"), first)
        return F.when((day >= 0) & (day < last), day)

    def write(day: Column, order: str) -> Column:
        two = _pair(F.floor(day / 773), day % 773, 189, 773, key, "date")
        new = F.date_add(first, (two["l"] * 773 + two["r"]).cast("int"))
        sep = F.regexp_extract(m, "[-/.]", 0)
        names = {"y": F.lpad(F.year(new).cast("string"), 4, "0"), "m": F.lpad(F.month(new).cast("string"), 2, "0"), "d": F.lpad(F.day(new).cast("string"), 2, "0")}
        return F.concat(names[order[0]], sep, names[order[1]], sep, names[order[2]])

    iso, american, european = read(a, b, c), read(c, a, b), read(c, b, a)
    year_first = F.length(a) == 4
    return (F.when(year_first & iso.isNotNull(), write(iso, "ymd")).when(~year_first & american.isNotNull(), write(american, "mdy"))
            .when(~year_first & european.isNotNull(), write(european, "dmy")))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, p, n).cast("int") for p, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    two = _pair(area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    new = two["l"] + 1 + F.when(two["l"] >= 665, 1).otherwise(0)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.when(valid, F.concat_ws("-", pad(new, 3), pad(F.floor(two["r"] / 9999) + 1, 2), pad(two["r"] % 9999 + 1, 4)))


def _ip(m: Column, key: str) -> Column:
    octet = [F.get(F.split(m, r"\."), F.lit(k)).cast("int") for k in range(4)]
    two = _pair(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], 1 << 16, 1 << 16, key, "ip")
    new = [F.floor(two["l"] / 256), two["l"] % 256, F.floor(two["r"] / 256), two["r"] % 256]
    return F.when(F.greatest(*octet) <= 255, F.concat_ws(".", *[x.cast("string") for x in new]))


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    national = F.right(d, F.lit(10))
    area, exchange = F.left(national, F.lit(3)).cast("int"), F.substring(national, 4, 3).cast("int")
    nanp = ((F.length(d) == 10) | ((F.length(d) == 11) & d.startswith("1"))) & (area >= 200) & (exchange >= 200)
    two = _pair(area - 200, (exchange - 200) * 10000 + F.right(national, F.lit(4)).cast("int"), 800, 8_000_000, key, "phone")
    new = F.concat(F.left(d, F.length(d) - 10), (two["l"] + 200).cast("string"), F.lpad((two["r"] + 2_000_000).cast("string"), 7, "0"))
    # Other numbers: everything after the country code keeps its places.
    code = F.regexp_extract(m, r"^(\+\d{1,3}(?=[ .(-])|\+\d{2}|)", 1)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    other = F.concat(code, _refill(rest, _text(_digits(rest), key, "phone")))
    return F.when(nanp, _refill(m, new)).when(F.length(d).between(8, 15), other)


def _email(m: Column, key: str) -> Column:
    return F.concat(_text(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _secrets(names):
    """Kind, pattern and pseudonym of secrets behind these names."""
    lead = f"^{_lead(names)}(?:{_QUOTE})?"

    def work(m: Column, key: str) -> Column:
        name = F.when(m.rlike(f"^{_AKIA}$"), F.lit("AKIA")).otherwise(F.regexp_extract(m, lead, 0))
        rest = F.substring(m, F.length(name) + 1, F.length(m))
        # Punctuation behind a value is none of it: the same secret stays linked.
        value = F.rtrim(rest, F.lit(_CLOSING))
        tail = F.substring(rest, F.length(value) + 1, F.length(rest))
        return F.concat(name, F.when(value.rlike("^[0-9a-f]+$"), _text(value, key, "hex")).otherwise(_text(value, key, "secret")), tail)

    return ("secret", f"{lead}|^{_AKIA}$", work)


_KINDS = (("email", "@", _email), ("date", f"^{_DATE}$", _date), ("ssn", f"^{_SSN}$", _ssn),
          ("ip", r"^\d{1,3}(?:\.\d{1,3}){3}$", _ip), ("phone", f"^(?:{_NANP}|{_PHONE})$", _phone), ("card", f"^{_CARD}$", _card))


def _replacement(m: Column, key: str, kinds: list) -> Column:
    """struct(kind, value) of a match: its pseudonym, null if it isn't valid."""
    chosen = None
    for kind, pattern, work in kinds:
        one = F.struct(F.lit(kind).alias("kind"), m.alias("value"), work(m, key).alias("pseudonym"))
        chosen = F.when(m.rlike(pattern), one) if chosen is None else chosen.when(m.rlike(pattern), one)
    return chosen


def _plain(text: Column) -> Column:
    return F.struct(F.lit("").alias("kind"), text.alias("value"), F.lit(None).cast("string").alias("pseudonym"))


def _pieces(text: Column, pattern: Column, key: str, *kinds: tuple) -> Column:
    """A text cut into an array of struct(kind, value, pseudonym): the valid
    matches of a pattern of these kinds, and the text before, between and after them (pseudonym null)."""
    def cut(parts: Column, found: Column) -> Column:
        def piece(p: Column, q: Column) -> Column:
            """The text between the valid matches p and q, and match q."""
            inner = F.slice(found, p + 2, q - p - 1)
            rest = F.array_join(F.zip_with(F.slice(parts, p + 2, q - p), inner, lambda t, m: F.concat(t, F.coalesce(m["value"], F.lit("")))), "")
            return F.array_compact(F.array(_plain(rest), F.get(found, q)))

        at = F.filter(F.transform(found, lambda m, i: F.when(m["pseudonym"].isNotNull(), i)), lambda i: i.isNotNull())
        ends = F.concat(at, F.array(F.size(found)))
        return _let(ends, lambda e: F.flatten(F.transform(e, lambda q, j: piece(F.coalesce(F.get(e, j - 1), F.lit(-1)), q))))

    matches = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.coalesce(_replacement(m, key, kinds), _plain(m)))
    return _let(F.split(text, pattern, -1), lambda parts: _let(matches, lambda found: cut(parts, found)))


def _within(pieces: Column, use) -> Column:
    """The pieces with those of plain text replaced by the pieces ``use`` makes."""
    return F.flatten(F.transform(pieces, lambda p: F.when(p["pseudonym"].isNull(), use(p["value"])).otherwise(F.array(p))))


def _cards_inside(text: Column, key: str, names) -> Column:
    """Pieces of a text whose longest runs of digits are no card (or other value),
    but may hold some: card and CVV, an expiry or a number before."""
    # Every place where a form fits, overlaps included; years don't start cards.
    forms = [F.regexp_extract_all(text, F.lit(f"{_FREE}(?=((?!0|19|20){g}){_STOP})"), F.lit(1)) for g in _GROUPS]
    cards = F.filter(F.array_distinct(F.concat(*forms)), _is_card)
    # Digits, blanks and dashes only: as a pattern they mean themselves.
    own = lambda c: F.concat(F.lit(f"{_FREE}(?:"), F.array_join(F.reverse(F.array_sort(c)), "|"), F.lit(f"){_STOP}"))
    some = _let(cards, lambda c: F.when(F.size(c) > 0, _pieces(text, own(c), key, _KINDS[-1])))
    return _within(F.coalesce(some, F.array(_plain(text))), lambda t: _pieces(t, F.lit(value_pattern(names, cards=False)), key, _secrets(names), *_KINDS[:-1]))


def find_values(docs: DataFrame, key: str, column: str = C.TEXT, names=SECRET_NAMES) -> Column:
    """The text in order as an array of struct(kind, value, pseudonym): its values
    and, with a null pseudonym, what stands between them. Null without values."""
    text = F.col(column).cast("string")
    long_run = r"\d(?:[ -]?\d){12}"
    first = _pieces(text, F.lit(value_pattern(names)), key, _secrets(names), *_KINDS)
    found = _within(first, lambda t: F.when(t.rlike(long_run), _cards_inside(t, key, names)).otherwise(F.array(_plain(t))))
    return F.when(text.rlike(NEEDED), found)


def pseudonymise(docs: DataFrame, key: str, names=SECRET_NAMES) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``__values``: the replaced values
    as an array of struct(kind, value, pseudonym). ``names`` name the secrets."""
    text = F.col(C.TEXT).cast("string")
    rows = docs.withColumn("__found", find_values(docs, key, names=names))
    joined = F.array_join(F.transform("__found", lambda m: F.coalesce(m["pseudonym"], m["value"])), "")
    valid = F.filter("__found", lambda m: m["pseudonym"].isNotNull())
    rows = rows.withColumn("__values", F.coalesce(valid, F.filter(F.array(F.struct(F.lit("").alias("kind"), F.lit("").alias("value"), F.lit("").alias("pseudonym"))), lambda m: F.lit(False))))
    rows = rows.withColumn(C.TEXT, F.when(F.size("__values") > 0, joined).otherwise(text))
    return rows.select(*docs.columns, "__values")


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(C.table(spark, sf_dir, "documents"), QUERY_KEY)
    return found.select("doc_id", "text", F.size("__values").alias("n_values"), F.array_join(F.transform("__values", lambda v: v["kind"]), ",").alias("kinds"))
