"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

Matches of one pattern are cut out of a text, permuted under a key and put back. The permutation is a Feistel network inside the
format of the match, so different values stay different, equal values stay equal in all documents, and the text keeps its shape:

card, account   13 to 19 digits, in one run or in the usual groups, whose last digit is the Luhn check digit: all but the last are
                permuted, and the last is the check digit of the new number
phone           digits permuted, all other characters (and a country code) in place
ssn             a number of an area, group and serial that exist, permuted among these
ip              four octets up to 255, permuted as a 32-bit number
date            a real calendar day of 1900 to 2099, permuted among these days, year-month-day or day/month/year as written
key             32 to 64 hexadecimal digits, permuted as such
email           letters and digits of the local part permuted within their kinds

What only looks like such a value (a number that fails its check digit, an octet over 255, a 13th month, an area 000, 666 or from
900 on) is left alone and not counted. The key is a secret of the caller.

Defined cases: null text stays null and empty text empty, with nothing found; texts without a digit or @ are passed
over; repeated rows are changed alike; an empty table gives an empty result. ``pseudonymize`` keeps all columns of its input and adds ``pii_found``
(replacing a column of that name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

DIGITS, HEX = "0123456789", "0123456789abcdef"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIRST_DAY, DAYS, DAY_HALF = "1900-01-01", 73049, 271

PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}",
    "key": r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![0-9])",
    "phone": r"\+[0-9]{1,3} ?\([0-9]{3}\) ?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "number": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9])",
}
ANY = "|".join(PATTERNS[k] for k in PATTERNS)


def _hash(key: str, kind: str, turn: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string")), 256)


def _shift(c: Column, by: Column, alphabets: tuple[str, ...]) -> Column:
    """The character ``by`` places on in its alphabet; itself if it is in none."""
    out = c
    for a in alphabets:
        at = F.instr(F.lit(a), c)
        out = F.when(at > 0, F.substring(F.lit(a), F.pmod(at - 1 + by, F.lit(len(a))).cast("int") + 1, F.lit(1))).otherwise(out)
    return out


def _add(text: Column, digest: Column, alphabets: tuple[str, ...]) -> Column:
    """Each character of ``text`` shifted by its own byte of ``digest``."""
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(digest, (F.pmod(i - 1, F.lit(32)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    return F.array_join(F.transform(places, lambda i: _shift(F.substring(text, i, F.lit(1)), byte(i), alphabets)), "")


def permute_text(value: Column, key: str, kind: str, alphabets: tuple[str, ...]) -> Column:
    """A permutation of the strings with the format of ``value``: characters stay within their alphabet, others stay."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("a"), F.substring(value, half + 1, F.length(value)).alias("b"))
    turn = lambda s, r: F.struct(
        F.when(r % 2 == 0, _add(s["a"], _hash(key, kind, r, s["b"]), alphabets)).otherwise(s["a"]).alias("a"),
        F.when(r % 2 == 1, _add(s["b"], _hash(key, kind, r, s["a"]), alphabets)).otherwise(s["b"]).alias("b"),
    )
    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, turn, lambda s: F.concat(s["a"], s["b"]))


def permute_number(value: Column, key: str, kind: str, half: int) -> Column:
    """A permutation of 0 .. half**2 - 1."""
    number = lambda h: F.conv(F.substring(h, 1, 8), 16, 10).cast("long")
    start = F.struct(F.floor(value / half).cast("long").alias("a"), (value % half).cast("long").alias("b"))
    turn = lambda s, r: F.struct(s["b"].alias("a"), F.pmod(s["a"] + number(_hash(key, kind, r, s["b"])), F.lit(half)).cast("long").alias("b"))
    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, turn, lambda s: s["a"] * half + s["b"])


def luhn_digit(digits: Column) -> Column:
    """The check digit that belongs after ``digits``."""
    place = lambda c, i: c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), place)
    total = F.aggregate(values, F.lit(0), lambda s, x: s + x - F.when(x > 9, 9).otherwise(0))
    return (10 - total % 10) % 10


def _number(v: Column, key: str) -> Column:
    plain = F.regexp_replace(v, "[^0-9]", "")
    n = F.length(plain)
    body = F.substring(plain, F.lit(1), n - 1)
    new = permute_text(body, key, "number", (DIGITS,))
    valid = F.substring(plain, n, F.lit(1)).cast("int") == luhn_digit(body)
    digits = F.concat(new, luhn_digit(new).cast("string"))
    # The n-th digit of the match takes the n-th new digit; blanks and hyphens stay.
    chars = F.filter(F.split(v, ""), lambda c: c != "")
    placed = F.aggregate(
        chars, F.struct(F.lit("").alias("out"), F.lit(1).alias("i")),
        lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substring(digits, s["i"], F.lit(1))).alias("out"), (s["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["i"].alias("i"))),
        lambda s: s["out"],
    )
    return F.when(~valid, v).when(v.rlike("^[0-9]+$"), digits).otherwise(placed)


def _ssn(v: Column, key: str) -> Column:
    exists = lambda x: x.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    # Permuted again until the number exists, which keeps the permutation within those.
    again = lambda s, _: F.when(exists(s), s).otherwise(permute_text(s, key, "ssn", (DIGITS,)))
    new = F.aggregate(F.array(*map(F.lit, range(20))), permute_text(v, key, "ssn", (DIGITS,)), again)
    return F.when(exists(v) & exists(new), new).otherwise(v)


def _ip(v: Column, key: str) -> Column:
    octets = F.transform(F.split(v, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    new = permute_number(number, key, "ip", 65536)
    part = lambda k: F.pmod(F.floor(new / 256**k), F.lit(256)).cast("string")
    # An octet with a leading zero is no address: as a number it would be one with the address without the zero.
    return F.when(F.forall(octets, lambda x: x < 256) & ~v.rlike(r"(^|\.)0[0-9]"), F.concat_ws(".", part(3), part(2), part(1), part(0))).otherwise(v)


def _date(v: Column, key: str) -> Column:
    iso = v.contains("-")
    day = F.when(iso, F.try_to_date(v, "yyyy-MM-dd")).otherwise(F.try_to_date(v, "dd/MM/yyyy"))
    number = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
    # Numbers past the last day are permuted again until they fall on a day.
    walk = lambda s, _: F.when(s >= DAYS, permute_number(s, key, "date", DAY_HALF)).otherwise(s)
    new = F.aggregate(F.array(*map(F.lit, range(12))), permute_number(number, key, "date", DAY_HALF), walk)
    moved = F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int"))
    return F.when(day.isNull() | (new >= DAYS), v).when(iso, F.date_format(moved, "yyyy-MM-dd")).otherwise(F.date_format(moved, "dd/MM/yyyy"))


def _phone(v: Column, key: str) -> Column:
    country = F.regexp_extract(v, r"^\+[0-9]{1,3}(?= ?\()", 0)
    return F.concat(country, permute_text(F.substring(v, F.length(country) + 1, F.length(v)), key, "phone", (DIGITS,)))


def _email(v: Column, key: str) -> Column:
    local = F.substring_index(v, "@", 1)
    return F.concat(permute_text(local, key, "email", (DIGITS, LOWER, UPPER)), F.substring(v, F.length(local) + 1, F.length(v)))


def pseudonym(v: Column, key: str) -> Column:
    """What stands in for a match."""
    whole = lambda name: v.rlike(f"^(?:{PATTERNS[name]})$")
    return (
        F.when(v.contains("@"), _email(v, key)).when(whole("key"), permute_text(v, key, "key", (HEX,))).when(whole("ip"), _ip(v, key))
        .when(whole("date"), _date(v, key)).when(whole("phone"), _phone(v, key)).when(whole("ssn"), _ssn(v, key)).otherwise(_number(v, key))
    )


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the personal data of ``text`` replaced, and ``pii_found``, the number of values replaced."""
    has = F.col("text").rlike("[0-9@]")
    found = F.when(has, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    names = [c for c in docs.columns if c not in ("text", "pii_found")]
    row = F.struct(*names).alias("__row") if names else F.lit(None).alias("__row")
    rows = docs.select(row, "text", F.coalesce(found, F.array().cast("array<string>")).alias("__found"))
    rows = rows.withColumn("__new", F.transform("__found", lambda v: pseudonym(v, key)))
    pieces = F.zip_with(F.split("text", ANY, -1), F.concat("__new", F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    text = F.when(F.size("__found") > 0, F.array_join(pieces, "")).otherwise(F.col("text"))
    changed = F.size(F.filter(F.arrays_zip("__found", "__new"), lambda p: p["__found"] != p["__new"])).cast("long")
    own = [text.alias("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c != "pii_found"]
    return rows.select(*own, changed.alias("pii_found"))
