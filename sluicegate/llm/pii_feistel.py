"""Format-preserving pseudonyms by Feistel networks, in Spark functions only.

Numbers and dates that pass validation are permuted under a key within their own format: the
digits change, separators and length rules stay, and the pseudonym is valid again (check digit,
octets, calendar).  The permutation depends on the key and the kind alone, so equal values get
equal pseudonyms in all documents, whatever separators they were written with, and the holder of
the key can invert it.

Kinds: ``email`` (letters and digits of the local part), ``phone`` (ten digits after an optional
country code 1, or the digits after another country code; ten digits without a plus, brackets or
two separators only if area and exchange begin with 2 to 9, and so does their pseudonym),
``card`` (13 to 19 digits with a Luhn check digit, unbroken or in the groups cards are printed
in), ``ssn`` (valid area, group and serial), ``ip`` (dotted quad without leading zeros), ``date``
(real days of 1900 to 2099).  What fails validation stays as it is.  One to three digits after a
space behind four groups of four belong to the card only if the sixteen are no card.

A null text stays null with no pseudonyms, texts of any length are read whole, repeated rows
give equal results, an empty table no rows; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.llm.base import table

#: For tests and the registered query; a deployment passes a key of its own.
DEMO_KEY = "demonstration key"
ROUNDS = 10

_DATE_YMD = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}"
_DATE_DMY = r"\d{1,2}[./]\d{1,2}[./]\d{4}|\d{1,2}-\d{1,2}-\d{4}"
_IP = r"\d{1,3}(?:\.\d{1,3}){3}"
_SSN = r"\d{3}-\d{2}-\d{4}"
#: A short last group is not the beginning of a number, date or address of its own.
_LAST = r"(?![\w%+/.-]{0,64}+@|[\w%+/]|[ .,:-]{1,2}[(+]?[0-9])"
_CARD = (
    rf"\d{{4}}(?:[ -]\d{{4}}){{3}}(?:[ -]\d{{1,3}}{_LAST})?|\d{{4}}(?:[ -]\d{{4}}){{2}}[ -]\d{{1,3}}{_LAST}|"
    r"\d{4}[ -]\d{6}[ -](?:\d{5}|\d{4}(?![-/]))|\d{4}[ -]\d{4}[ -]\d{5}|\d{4}[ -]\d{5}[ -]\d{6}|"
    r"\d{6}[ -]\d{7,13}|\d{13,19}")
_PHONE = r"(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}"
#: Marked by a plus or brackets; without them, letters around or decimal places tell other numbers apart.
_MARKED = r"(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})|(?:1[ .-]?)?\(\d{3}\))[ .-]?\d{3}[ .-]?\d{4}"
_BARE = (
    r"(?<![A-Za-z_])(?<![0-9][.,])(?:1?\d{10}|(?:1[ -])?(?:\d{10}|\d{3}[ -]\d{7}|\d{6}[ -]\d{4}))"
    r"(?![A-Za-z_]|[.,][0-9])")
_ABROAD = r"\+[2-9]\d{0,2}(?:[ .-]?\(0\))?(?:[ .-]?\(?\d{2,4}\)?){2,5}"
#: Country codes in use, 1 aside; none begins another.
_COUNTRY = (
    r"2(?:[07]|1[12368]|[2346]\d|5[0-8]|9[01789])|3(?:[0-469]|[57]\d|8[0-35-79])|4(?:[013-9]|2[013])|5(?:[1-8]|[09]\d)|"
    r"6(?:[0-6]|7[02-9]|8[0-35-9]|9[0-2])|7|8(?:[1246]|0[08]|5[02356]|7[08]|8[0-368])|9(?:[0-58]|6[0-8]|7[0-79]|9[2-68])")
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}"
PATTERN = (
    rf"{_EMAIL}|(?<![0-9])(?=[+(0-9])(?:{_IP}|{_DATE_YMD}|{_DATE_DMY}|{_SSN}|{_CARD}|{_PHONE}|{_MARKED}|{_BARE}|{_ABROAD})(?![0-9])")

_FIRST_DAY, _DAYS = "1900-01-01", (17, 4297)  # 17 * 4297 days are 1900 to 2099


def _prf(key: str, kind: str, step: Column, value: Column) -> Column:
    """A keyed number below 2**56 for a step and the other half."""
    return F.conv(F.substring(F.sha2(F.concat_ws(
        "|", F.lit(key), F.lit(kind), step.cast("string"), value.cast("string")), 256), 1, 14), 16, 10).cast("long")


def feistel(value: Column, kind: str, left: Column | int, right: Column | int, key: str, inverse: bool = False) -> Column:
    """Permutation of the numbers below left * right (each half fits a long)."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (left, right))
    steps = list(range(ROUNDS))[:: -1 if inverse else 1]
    sign = -1 if inverse else 1

    def step(halves: Column, i: Column) -> Column:
        low, high = halves["low"], halves["high"]
        return F.struct(
            F.when(i % 2 == 0, F.pmod(high + sign * F.pmod(_prf(key, kind, i, low), a), a)).otherwise(high).alias("high"),
            F.when(i % 2 == 1, F.pmod(low + sign * F.pmod(_prf(key, kind, i, high), b), b)).otherwise(low).alias("low"))

    start = F.struct(F.floor(value / b).cast("long").alias("high"), F.pmod(value, b).alias("low"))
    if isinstance(left, Column):  # integer division, beyond what a double can tell apart
        start = F.struct(((value - F.pmod(value, b)).cast("decimal(20,0)") / b.cast("decimal(20,0)")).cast("long").alias("high"),
                         F.pmod(value, b).alias("low"))
    return F.aggregate(F.array(*[F.lit(i) for i in steps]), start, step, lambda h: h["high"] * b + h["low"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10 ** i).cast("long") for i in range(19)]), n.cast("int") + 1)


def _permuted_digits(digits: Column, kind: str, key: str, inverse: bool) -> Column:
    """Up to 18 digits, permuted among all strings of their length."""
    n = F.length(digits)
    right = F.floor(n / 2)
    out = feistel(digits.cast("long"), kind, _power(n - right), _power(right), key, inverse)
    return F.lpad(out.cast("string"), n, "0")


def _into(shape: Column, digits: Column) -> Column:
    """The digits of ``shape`` replaced, in order, by others."""
    return F.aggregate(
        F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("next")),
        lambda acc, c: F.when(
            c.rlike("[0-9]"),
            F.struct(F.concat(acc["out"], F.substring(digits, acc["next"], F.lit(1))).alias("out"), (acc["next"] + 1).alias("next")),
        ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["next"].alias("next"))),
        lambda acc: acc["out"])


def _luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Luhn sum; the last digit is doubled if a check digit is still to follow."""
    odd = 0 if doubled_last else 1

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(F.pmod(i, F.lit(2)) == odd, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _check(digits: Column) -> Column:
    """The check digit to follow."""
    return F.pmod(10 - F.pmod(_luhn_sum(digits, True), F.lit(10)), F.lit(10)).cast("string")


def _card(m: Column, key: str, inverse: bool) -> Column:
    """Beyond 16 digits the Luhn sum of the first 16 stays, so that these are a card before and
    after or neither time."""
    digits = _digits(m)
    sixteen = F.pmod(_luhn_sum(F.substring(digits, 1, 16), False), F.lit(10))
    apart = m.rlike(r"^\d{4}(?:[ -]\d{4}){3} \d{1,3}$") & (sixteen == 0)
    number = F.when(apart, F.substring(digits, 1, 16)).otherwise(digits)
    long = F.length(number) > 16
    body = F.when(long, F.concat(F.substring(number, 1, 15), F.substring(number, F.lit(17), F.length(number) - 17))).otherwise(
        F.substring(number, F.lit(1), F.length(number) - 1))

    def completed(new: Column) -> Column:
        head = F.substring(new, 1, 15)
        return F.when(long, F.concat(
            head, F.pmod(sixteen - _luhn_sum(head, True), F.lit(10)).cast("string"), F.substring(new, 16, 3))).otherwise(new)

    # Results are used more than once, as the one element of an array.
    whole = F.transform(F.transform(F.array(_permuted_digits(body, "card", key, inverse)), completed),
                        lambda new: F.concat(new, _check(new), F.when(apart, F.substring(digits, 17, 3)).otherwise("")))
    return F.when(F.pmod(_luhn_sum(number, False), F.lit(10)) == 0, _into(m, F.element_at(whole, 1)))


def _phone(m: Column, key: str, inverse: bool) -> Column:
    """Numbers whose area and exchange begin with 2 to 9 are permuted among themselves, as are the others."""
    digits = _digits(m)
    own = F.substring(digits, -10, 10)
    code = F.substring(digits, F.lit(1), F.length(digits) - 10)
    a, b = F.substring(own, 1, 1).cast("long"), F.substring(own, 4, 1).cast("long")
    rest = F.concat(F.substring(own, 2, 2), F.substring(own, 5, 6)).cast("long")
    usual = (a >= 2) & (b >= 2)
    pair = F.when(usual, (a - 2) * 8 + b - 2).when(a < 2, a * 10 + b).otherwise(16 + a * 2 + b)  # 64, or 36
    new = feistel(pair * 10 ** 8 + rest, "phone", F.when(usual, 640_000).otherwise(360_000).cast("long"), 10_000, key, inverse)

    def written(v: Column) -> Column:
        pair, rest = F.floor(v / 10 ** 8), F.lpad(F.pmod(v, F.lit(10 ** 8)).cast("string"), 8, "0")
        first = F.when(usual, F.floor(pair / 8) + 2).when(pair < 20, F.floor(pair / 10)).otherwise(F.floor((pair - 16) / 2))
        fourth = F.when(usual, F.pmod(pair, F.lit(8)) + 2).when(pair < 20, F.pmod(pair, F.lit(10))).otherwise(F.pmod(pair, F.lit(2)))
        return F.concat(first.cast("string"), F.substring(rest, 1, 2), fourth.cast("string"), F.substring(rest, 3, 6))

    valid = F.length(digits).between(10, 11) & (m.rlike(r"[+(]") | m.rlike(rf"^{_PHONE}$") | usual)
    return F.when(valid, _into(m, F.concat(code, F.element_at(F.transform(F.array(new), written), 1))))


def _abroad(m: Column, key: str, inverse: bool) -> Column:
    """The country code is the listed one; an unlisted one is told by the separator after it."""
    listed = F.regexp_extract(m, rf"^\+({_COUNTRY})", 1)
    code = F.when(listed != "", listed).otherwise(F.regexp_extract(m, r"^\+(\d{1,3})[ .-]", 1))
    trunk = F.when(m.rlike(r"^\+\d+[ .-]?\(0\)"), "0").otherwise("")  # written, but not part of the number
    own = F.substring(_digits(m), F.length(code) + F.length(trunk) + 1, F.lit(20))
    valid = (F.length(code) > 0) & F.length(own).between(6, 12) & (
        (trunk == "") | (F.regexp_extract(m, r"^\+(\d+)[ .-]?\(0\)", 1) == code))
    return F.when(valid, _into(m, F.concat(code, trunk, _permuted_digits(own, "abroad", key, inverse))))


def _ssn(m: Column, key: str, inverse: bool) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas
    number = (place * 99 + group - 1) * 9999 + serial - 1
    new = feistel(number, "ssn", 898, 99 * 9999, key, inverse)
    # The result is taken apart once, as the one element of an array.
    text = F.transform(F.array(new), lambda v: F.concat_ws(
        "-",
        F.lpad((F.floor(v / (99 * 9999)) + F.when(v >= 665 * 99 * 9999, 2).otherwise(1)).cast("string"), 3, "0"),
        F.lpad((F.pmod(F.floor(v / 9999), F.lit(99)) + 1).cast("string"), 2, "0"),
        F.lpad((F.pmod(v, F.lit(9999)) + 1).cast("string"), 4, "0")))
    return F.when(valid, F.element_at(text, 1))


def _ip(m: Column, key: str, inverse: bool) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    valid = F.forall(octets, lambda x: x <= 255) & ~m.rlike(r"(^|\.)0[0-9]")
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x)
    text = F.transform(F.array(feistel(number, "ip", 65536, 65536, key, inverse)), lambda v: F.concat_ws(
        ".", *[F.shiftright(v, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]))
    return F.when(valid, F.element_at(text, 1))


def _date(m: Column, key: str, inverse: bool) -> Column:
    """Year first, else day first, else month first; the order and the separator stay."""
    separator = F.regexp_extract(m, r"([-./])", 1)
    p = F.transform(F.split(m, "[-./]"), lambda x: x.cast("int"))
    wide = F.length(m) == 10

    def day(y: Column, mo: Column, d: Column) -> Column:
        text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(mo.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
        ok = mo.between(1, 12) & d.between(1, 31) & y.between(1900, 2099)
        return F.when(ok, F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))

    year_first = m.rlike(r"^\d{4}")
    ymd = day(p[0], p[1], p[2])
    dmy, mdy = day(p[2], p[1], p[0]), day(p[2], p[0], p[1])
    found = F.when(year_first, ymd).otherwise(F.coalesce(dmy, mdy))
    number = F.datediff(found, F.lit(_FIRST_DAY).cast("date")).cast("long")

    def padded(n: Column) -> Column:
        return F.when(wide, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))

    def written(v: Column) -> Column:
        new = F.date_add(F.lit(_FIRST_DAY).cast("date"), v.cast("int"))
        y, mo, d = F.year(new).cast("string"), padded(F.month(new)), padded(F.dayofmonth(new))
        return F.when(year_first, F.concat(y, separator, mo, separator, d)).when(
            dmy.isNotNull(), F.concat(d, separator, mo, separator, y)).otherwise(F.concat(mo, separator, d, separator, y))

    text = F.transform(F.array(feistel(number, "date", *_DAYS, key, inverse)), written)
    return F.when(found.isNotNull(), F.element_at(text, 1))


def _email(m: Column, key: str, inverse: bool) -> Column:
    """Letters and digits of the local part, each within its class; halves alternate."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    n = F.length(local)
    half = F.ceil(n / 2).cast("int")
    sign = -1 if inverse else 1

    def shifted(part: Column, other: Column, i: Column) -> Column:
        # Up to 32 characters of a half take four hex digits each.
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), other), 512)

        def one(c: Column, k: Column) -> Column:
            shift = F.conv(F.substring(stream, k * 4 + 1, F.lit(4)), 16, 10).cast("int")
            code = F.ascii(c)

            def turned(first: int, size: int) -> Column:
                return F.char(F.lit(first) + F.pmod(code - first + sign * shift, F.lit(size)))

            return (F.when(c.rlike("[0-9]"), turned(48, 10)).when(c.rlike("[a-z]"), turned(97, 26))
                    .when(c.rlike("[A-Z]"), turned(65, 26)).otherwise(c))

        return F.array_join(F.transform(F.filter(F.split(part, ""), lambda c: c != ""), one), "")

    def step(halves: Column, i: Column) -> Column:
        a, b = halves["a"], halves["b"]
        return F.struct(F.when(i % 2 == 0, shifted(a, b, i)).otherwise(a).alias("a"),
                        F.when(i % 2 == 1, shifted(b, a, i)).otherwise(b).alias("b"))

    steps = list(range(ROUNDS))[:: -1 if inverse else 1]
    start = F.struct(F.substring(local, F.lit(1), half).alias("a"), F.substring(local, half + 1, n).alias("b"))
    new = F.aggregate(F.array(*[F.lit(i) for i in steps]), start, step, lambda h: F.concat(h["a"], h["b"]))
    return F.concat(new, F.lit("@"), domain)


_KINDS = (("email", "@", _email), ("ip", rf"^{_IP}$", _ip), ("date", rf"^(?:{_DATE_YMD}|{_DATE_DMY})$", _date),
          ("ssn", rf"^{_SSN}$", _ssn), ("card", rf"^(?:{_CARD})$", _card), ("phone", rf"^(?:{_PHONE}|{_MARKED}|{_BARE})$", _phone),
          ("phone", rf"^{_ABROAD}$", _abroad))


def pseudonym(m: Column, key: str, inverse: bool = False) -> Column:
    """kind and pseudonym of a matched string; both null if it is not valid."""
    kind = new = None
    for name, shape, rule in _KINDS:
        value = rule(m, key, inverse)
        new = F.when(m.rlike(shape), value) if new is None else new.when(m.rlike(shape), value)
        kind = F.when(m.rlike(shape), F.lit(name)) if kind is None else kind.when(m.rlike(shape), F.lit(name))
    return F.struct(kind.alias("kind"), m.alias("value"), new.alias("pseudonym"))


def pseudonymised(docs: DataFrame, key: str, inverse: bool = False) -> DataFrame:
    """A row per row of docs: doc_id, text, and ``pseudonyms``, an array of (kind, value, pseudonym)
    of the validated values in the order of the text.  ``inverse`` gives the values back."""
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).select(
        # Every kind needs a digit or an @; most texts hold neither.
        "doc_id", "text", F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("found"))
    some = F.size("found") > 0
    named = found.select("doc_id", "text", F.when(some, F.transform("found", lambda m: pseudonym(m, key, inverse))).alias("named"))
    rebuilt = F.array_join(F.zip_with(
        F.split("text", PATTERN, -1), F.col("named"),
        lambda part, n: F.concat(part, F.coalesce(n["pseudonym"], n["value"], F.lit("")))), "")
    empty = F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")
    return named.select(
        "doc_id", F.when(F.col("named").isNull(), F.col("text")).otherwise(rebuilt).alias("text"),
        F.coalesce(F.filter("named", lambda n: n["pseudonym"].isNotNull()), empty).alias("pseudonyms"))


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymised(table(spark, sf_dir, "documents"), DEMO_KEY)

    def number(kind: str) -> Column:
        return F.size(F.filter("pseudonyms", lambda n: n["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(
        "doc_id", "text", *[number(k) for k in ("email", "phone", "card", "ssn", "ip", "date")],
        F.transform("pseudonyms", lambda n: n["pseudonym"]).alias("pseudonyms"))


QUERIES = {"op1_feistel_pseudonyms": op1_feistel_pseudonyms}
SQL: dict[str, str] = {}
