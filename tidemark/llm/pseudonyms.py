"""Format-preserving pseudonyms of personal numbers and dates, in DataFrame operations only.

Candidates are found by one pattern and validated by kind: payment cards (Luhn), IBANs (mod 97), US social security
numbers (ranges that are issued), IPv4 addresses (octets up to 255), telephone numbers (formats), calendar dates, and the
local part of e-mail addresses. Each valid value is permuted within its format by a keyed, alternating Feistel network
over its characters: in a round one half of the characters is shifted, each within its own alphabet (digits, a-z, A-Z),
by numbers drawn from SHA-256 of the key, the kind, the round and the other half. Social security numbers are permuted among the
issued ones; a telephone number's country code is read from its digits, so that it stays and separators don't matter. Every round can be undone with the key, so
different values stay different, and equal values get equal pseudonyms in every document. Check digits are worked out
afresh; octets are permuted modulo 256; dates are permuted as day numbers within a block of 73,000 days (1900-01-01
begins one). What fails validation is left as it is.

Defined results: a null text stays null with no values; repeated rows give repeated results; a date that is valid
both day-first and month-first counts as day-first; other columns are kept as they are by pseudonymise().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import unused

KEY, ROUNDS = "tidemark-demo-key", 8
BLOCK_DAYS, DAY_HIGH, DAY_LOW, FIRST_DAY = 73_000, 292, 250, -25_567

# The formats of candidates, tried in this order at each place.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,10}[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-]|\.[0-9])",
    "ipv4": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[0-9]{8,15}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]\(?[0-9]{1,4}\)?){2,5}(?![0-9A-Za-z])",
}
# Country calling codes of one and of two digits; all others have three.
CALLING_CODE = r"^(?:[17]|2[07]|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
CANDIDATE = "|".join(FORMATS.values())
#: What every candidate contains; other texts aren't split.
HINT = r"@[A-Za-z0-9]|[0-9][^A-Za-z]{0,3}[0-9]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once: an array of one binds it, where a plain reference in a loop is worked out each time."""
    return F.transform(F.array(value), use)[0]


def draw(key: str, tweak: Column, i: Column, part: Column) -> Column:
    """A keyed number below 2**60."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), part), 256), 1, 15), 16, 10).cast("long")


def feistel_text(value: Column, key: str, tweak: Column, rounds: int = ROUNDS) -> Column:
    """The keyed permutation of the strings of one format: digits, a-z and A-Z change within their alphabets, all else stays."""
    half = F.floor(F.length(value) / 2).cast("int")

    def shift(text: Column, other: Column, i: Column) -> Column:
        """Four hexadecimal digits of SHA-256 move a character; a digest serves sixteen."""
        digest = lambda block: F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), block.cast("string"), other), 256)
        digests = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / 16).cast("int")), digest), "")

        def one(pos: Column, hexes: Column) -> Column:
            c = F.substring(text, pos, F.lit(1))
            code = F.ascii(c).cast("long")
            by = F.conv(F.substring(hexes, pos * 4 - 3, F.lit(4)), 16, 10).cast("long")
            moved = lambda base, n: F.chr((code - base + by) % n + base)
            return F.when(c.between("0", "9"), moved(48, 10)).when(c.between("a", "z"), moved(97, 26)).when(c.between("A", "Z"), moved(65, 26)).otherwise(c)

        done = bound(digests, lambda hexes: F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), lambda pos: one(pos, hexes)), ""))
        return F.when(F.length(text) > 0, done).otherwise(text)

    start = F.struct(F.substring(value, F.lit(1), half).alias("a"), F.substring(value, half + 1, F.length(value)).alias("b"))

    def step(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(F.when(odd, shift(acc["a"], acc["b"], i)).otherwise(acc["a"]).alias("a"), F.when(odd, acc["b"]).otherwise(shift(acc["b"], acc["a"], i)).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda acc: F.concat(acc["a"], acc["b"]))


def feistel_pair(high: Column, low: Column, n_high: int, n_low: int, key: str, tweak: Column, rounds: int = ROUNDS) -> Column:
    """struct(a, b): the keyed permutation of pairs of numbers below n_high and n_low."""
    start = F.struct(high.cast("long").alias("a"), low.cast("long").alias("b"))

    def step(acc: Column, i: Column) -> Column:
        a, b, odd = acc["a"], acc["b"], i % 2 == 1
        return F.struct(
            F.when(odd, (a + draw(key, tweak, i, b.cast("string"))) % n_high).otherwise(a).alias("a"), F.when(odd, b).otherwise((b + draw(key, tweak, i, a.cast("string"))) % n_low).alias("b")
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)


def luhn_sum(whole: Column, first_doubled: int) -> Column:
    """Sum over digits from the right; first_doubled: 0 doubles the last digit, 1 the one before it."""

    def add(digits: Column, acc: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, F.length(digits) - i, F.lit(1))) - 48
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == first_doubled, twice).otherwise(d)

    return bound(whole, lambda digits: F.aggregate(F.sequence(F.lit(0), F.greatest(F.length(digits) - 1, F.lit(0))), F.lit(0), lambda acc, i: add(digits, acc, i)))


def iban_mod(text: Column) -> Column:
    """The number of an IBAN, rearranged and with letters as 10 to 35, modulo 97."""
    moved = bound(text, lambda t: F.concat(F.substring(t, F.lit(5), F.length(t)), F.substring(t, 1, 4)))

    def add(rearranged: Column, acc: Column, i: Column) -> Column:
        code = F.ascii(F.substring(rearranged, i, F.lit(1)))
        return F.when(code >= 65, acc * 100 + code - 55).otherwise(acc * 10 + code - 48) % 97

    return bound(moved, lambda r: F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(r), F.lit(1))), F.lit(0), lambda acc, i: add(r, acc, i)))


def refill(shape: Column, plain: Column) -> Column:
    """The characters of plain in the places of shape's letters and digits; separators stay."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def add(plain: Column, acc: Column, i: Column) -> Column:
        c = F.substring(shape, i, F.lit(1))
        kept = c.rlike("[^0-9A-Za-z]")
        return F.struct(F.concat(acc["out"], F.when(kept, c).otherwise(F.substring(plain, acc["n"] + 1, F.lit(1)))).alias("out"), (acc["n"] + F.when(kept, 0).otherwise(1)).alias("n"))

    places = F.sequence(F.lit(1), F.greatest(F.length(shape), F.lit(1)))
    return bound(plain, lambda p: F.aggregate(places, start, lambda acc, i: add(p, acc, i), lambda acc: acc["out"]))


def kind_of(value: Column) -> Column:
    """The kind of a candidate: the first format it has as a whole and is valid in; null if none."""
    bare = F.regexp_replace(value, "[^0-9A-Za-z]", "")
    is_format = lambda kind: value.rlike(f"^(?:{FORMATS[kind]})$")
    octets = F.split(value, r"\.")
    digits = F.length(bare)
    ssn = ~F.substring(bare, 1, 3).isin("000", "666") & (F.substring(bare, 1, 1) != "9") & (F.substring(bare, 4, 2) != "00") & (F.substring(bare, 6, 4) != "0000")
    return (
        F.when(is_format("email"), "email")
        .when(is_format("iban") & (iban_mod(bare) == 1), "iban")
        .when(is_format("date") & date_of(value).isNotNull(), "date")
        .when(is_format("ipv4") & F.forall(octets, lambda o: o.cast("int") <= 255), "ipv4")
        .when(is_format("ssn") & ssn, "ssn")
        .when(is_format("card") & (luhn_sum(bare, 1) % 10 == 0) & digits.between(13, 19), "card")
        .when(is_format("phone") & digits.between(7, 15), "phone")
    )


def date_of(value: Column) -> Column:
    """The calendar date, day-first where that is valid, else month-first; null if there is none."""
    parse = lambda p: F.try_to_timestamp(value, F.lit(p)).cast("date")
    return F.when(value.rlike("^[0-9]{4}-"), parse("yyyy-MM-dd")).when(value.contains("/"), F.coalesce(parse("dd/MM/yyyy"), parse("MM/dd/yyyy"))).otherwise(F.coalesce(parse("dd.MM.yyyy"), parse("MM.dd.yyyy")))


def _date_pseudonym(value: Column, key: str) -> Column:
    day = F.unix_date(date_of(value)) - FIRST_DAY
    block = F.floor(day / BLOCK_DAYS).cast("long")
    index = F.pmod(day, F.lit(BLOCK_DAYS))
    pair = feistel_pair(F.floor(index / DAY_LOW), index % DAY_LOW, DAY_HIGH, DAY_LOW, key, F.concat(F.lit("date"), block.cast("string")))
    new = F.date_from_unix_date((block * BLOCK_DAYS + pair["a"] * DAY_LOW + pair["b"] + FIRST_DAY).cast("int"))
    text = F.date_format(new, "yyyy-MM-dd")
    y, m, d = F.substring(text, 1, 4), F.substring(text, 6, 2), F.substring(text, 9, 2)
    day_first = F.try_to_timestamp(F.translate(value, "./", "--"), F.lit("dd-MM-yyyy")).isNotNull()
    joined = lambda sep: F.when(day_first, F.concat_ws(sep, d, m, y)).otherwise(F.concat_ws(sep, m, d, y))
    return F.when(value.rlike("^[0-9]{4}-"), text).when(value.contains("/"), joined("/")).otherwise(joined("."))


def _ipv4_pseudonym(value: Column, key: str) -> Column:
    o = [F.split(value, r"\.")[i].cast("long") for i in range(4)]
    pair = feistel_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65_536, 65_536, key, F.lit("ipv4"))
    return F.concat_ws(".", *(x.cast("long").cast("string") for x in (F.floor(pair["a"] / 256), pair["a"] % 256, F.floor(pair["b"] / 256), pair["b"] % 256)))


def pseudonym(value: Column, kind: Column, key: str = KEY) -> Column:
    """The pseudonym of a valid value of a kind."""
    bare = F.regexp_replace(value, "[^0-9A-Za-z]", "")
    payload = F.substring(bare, F.lit(1), F.length(bare) - 1)
    # A card keeps its first digit, the network; the check digit follows from the new digits.
    card = F.concat(F.substring(payload, 1, 1), feistel_text(F.substring(payload, F.lit(2), F.length(payload)), key, F.lit("card")))
    checked = bound(card, lambda c: F.concat(c, ((10 - luhn_sum(c, 0) % 10) % 10).cast("string")))
    # An IBAN keeps its country; its check digits follow from the new account.
    account = feistel_text(F.substring(bare, F.lit(5), F.length(bare)), key, F.lit("iban"))
    country = F.substring(bare, 1, 2)
    iban = bound(account, lambda a: F.concat(country, F.lpad((98 - iban_mod(F.concat(country, F.lit("00"), a))).cast("string"), 2, "0"), a))
    digits = F.regexp_replace(value, "[^0-9]", "")
    country_code = F.when(value.startswith("+"), F.regexp_extract(digits, CALLING_CODE, 0)).otherwise(F.lit(""))
    national = F.substring(digits, F.length(country_code) + 1, F.length(digits))
    phone = refill(value, F.concat(country_code, feistel_text(national, key, F.concat(F.lit("phone+"), country_code))))
    # Issued areas are 1 to 899 without 666, groups 1 to 99, serials 1 to 9999.
    area, group, serial = (F.substring(bare, at, n).cast("long") for at, n in ((1, 3), (4, 2), (6, 4)))
    pair = feistel_pair((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1, serial - 1, 898 * 99, 9999, key, F.lit("ssn"))

    def issued(p: Column) -> Column:
        number = F.floor(p["a"] / 99) + 1
        number = number + F.when(number >= 666, 1).otherwise(0)
        return F.concat(F.lpad(number.cast("string"), 3, "0"), F.lpad((p["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["b"] + 1).cast("string"), 4, "0"))

    ssn = bound(pair, issued)
    local = F.substring_index(value, "@", 1)
    return (
        F.when(kind == "email", F.concat(feistel_text(local, key, F.lit("email")), F.substring(value, F.length(local) + 1, F.length(value))))
        .when(kind == "iban", refill(value, iban))
        .when(kind == "date", _date_pseudonym(value, key))
        .when(kind == "ipv4", _ipv4_pseudonym(value, key))
        .when(kind == "ssn", refill(value, ssn))
        .when(kind == "card", refill(value, checked))
        .when(kind == "phone", phone)
    )


def pseudonymise(docs: DataFrame, key: str = KEY, text_col: str = "text", values_col: str = "pii") -> DataFrame:
    """docs with valid values in text_col replaced, and values_col: array of struct(kind, pseudonym) in order of place.

    A narrow, one-pass projection: the text is split at candidates and zipped with their replacements. A column named values_col is replaced.
    """
    text = F.col(text_col)
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    names = [c for c in docs.columns if c != values_col]
    values, kinds, new = unused(docs, "found", "kinds", "new")
    step = docs.select(*names, F.coalesce(found, F.array().cast("array<string>")).alias(values))
    step = step.withColumn(kinds, F.transform(values, kind_of))
    made = F.zip_with(values, kinds, lambda v, k: F.struct(k.alias("kind"), F.when(k.isNull(), v).otherwise(pseudonym(v, k, key)).alias("pseudonym")))
    step = step.withColumn(new, made)
    pieces = F.split(text, CANDIDATE, -1)
    after = F.concat(F.transform(new, lambda x: x["pseudonym"]), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(pieces, after, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    done = F.when(F.size(values) == 0, text).otherwise(joined)
    return step.select(*(done.alias(c) if c == text_col else F.col(c) for c in names), F.filter(new, lambda x: x["kind"].isNotNull()).alias(values_col))


def pii_digest(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(doc_id, text, one count a kind): the query's columns."""
    out = pseudonymise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key)
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", "text", *map(count, FORMATS))
