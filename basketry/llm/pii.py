"""Format-preserving pseudonyms for personal data in text.

Values are found by shape and validated (card numbers by their check digit,
addresses by octet range, social security numbers by their ranges, dates by
the calendar). Numbers and dates are then permuted within their format by a
keyed Feistel network on Z_a x Z_b: each round adds a keyed hash of one half
to the other, which is a bijection, so equal values get equal pseudonyms in
every document, different values different ones, and the result has the same
layout and passes the same validation. E-mail addresses and secrets have no
such number format; they get a keyed hash in their place (equal values stay
linked).

  kind    halves                                      stays
  card    all digits but the last, split in two       length, separators, valid check digit
  phone   the last ten digits after the country code  country code, layout
  ssn     898 areas x 99 * 9,999 numbers              layout, valid ranges
  ipv4    two octets each                             dotted form
  date    day in a 400-year cycle, 189 x 773          layout, valid date, 1800 to 2199
          day-first with slashes: its days from the   the same, and a day from the 13th on
          13th on, 9 x 9833

Phones: + and 8 to 15 digits in any grouping, or 3-3-4 digits with equal
separators, parentheses or a leading 1, also before an extension after a slash.
Cards: 13 to 19 digits together, 4-4-4-4 (also with dots),
4-6-5 and 4-6-4. Dates: year first with - or /, month first with /, day first
with . (and with / if it can't be month first), of one or two digits, also
before a time of day after T and at both ends of a range (ends after year-first dates
with / between them, after year-last ones with -); equal dates stay linked over layouts, but for day-first slash dates, which are linked
among themselves. Left out: national phones in other groupings and without
separators, cards in other groupings, dates with two-digit years, month names,
or day or month first with -; social security numbers without separators;
IPv6. A number that only looks like a phone (3-3-4 digits, + and 8 digits) is
replaced too.

All of it is DataFrame expressions: one pattern cuts a text at its candidates,
candidates are replaced, and the parts are put together again. No row meets
another, so nothing is shuffled.

Defined cases: a null text stays null and an empty one empty; text without
values stays as it is; a candidate that fails validation stays as it is;
rows that repeat are each treated alike; an empty table gives an empty
result; other columns are kept by ``pseudonymise`` whatever their names, but a
column with the name of the kinds column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# Shapes of candidates. No digit, or part of a longer token, may touch a number.
SHAPES = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*(?<=\.[A-Za-z]{2,24})",
    "secret": r"(?i:(?:token|secret|password|api[_\-]?key)\s{0,4}[=:]\s{0,4}[\"'])[0-9A-Za-z_\-]{16,128}(?=[\"'])",
    "phone": r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .\-]?\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}(?!\d)"
             r"|(?<![\p{L}\p{N}+])\+\d{1,3}[ .\-]\d{3}[ .\-]\d{3}[ .\-]\d{4}(?!\d)"
             r"|(?<![\p{L}\p{N}+])\+[1-9](?:[ .\-]?\(?\d\)?){7,14}(?!\d)"
             r"|(?<![\p{L}\p{N}(])\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}(?!\d)"
             r"|(?<![\p{L}\p{N}+./\-])(?:1[ .\-])?(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3} \d{3} \d{4})"
             # a slash may lead to an extension
             r"(?![\p{L}\p{N}]|[.\-]\d|/(?!\d{1,4}(?![\p{L}\p{N}./\-]))\d)",
    "ipv4": r"(?<![\p{L}\p{N}.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\p{L}\p{N}]|\.\d)",
    # a date may be followed by a time of day after T, and be either end of a range
    # (year-last dates around -, year-first dates around /)
    "date": r"(?:(?<![\p{L}\p{N}./\-])|(?<=\d[./]\d{4}-)|(?<=\d{4}-\d{1,2}-\d{1,2}/)|(?<=[\dZ]/)(?<=T\d{2}:[\d:.]{2,12}Z?/))"
            r"(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})"
            r"(?!(?!T\d{2}:?\d{2})[\p{L}\p{N}]|\.\d|/(?!\d{4}-\d{1,2}-\d)\d|-(?!(?:\d{1,2}/\d{1,2}/|\d{1,2}\.\d{1,2}\.)\d{4}(?!\d))\d)",
    "ssn": r"(?<![\p{L}\p{N}.\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|[.\-]\d)",
    "card": r"(?<![\p{L}\p{N}.\-])(?:\d{13,19}|\d{4}[ .\-]\d{4}[ .\-]\d{4}[ .\-]\d{4}|\d{4}[ \-]\d{6}[ \-]\d{4,5})(?![\p{L}\p{N}]|[.\-]\d)",
}
CANDIDATE = "|".join(f"(?:{shape})" for shape in SHAPES.values())
# what every candidate holds: an at sign, a quoted value after = or :, or three digits in some grouping
HINT = r"@|[=:]\s{0,4}[\"']|\d[\d.\-/() ]{5}"

KINDS = ("email", "secret", "phone", "ipv4", "date", "ssn", "card")
CYCLE_DAYS = 146_097                                  # days of 400 years, 189 * 773
CYCLE_START = "1800-01-01"
LATE_DAYS = CYCLE_DAYS - 12 * 4800                     # those from the 13th on, 9 * 9833
# of the shapes that fit a date the last one holds
DATE_FORMATS = ((r"^\d{4}-", "yyyy-M-d"), (r"^\d{4}-\d\d-\d\d$", "yyyy-MM-dd"),
                (r"^\d{4}/", "yyyy/M/d"), (r"^\d{4}/\d\d/\d\d$", "yyyy/MM/dd"),
                (r"^\d{1,2}/", "M/d/yyyy"), (r"^\d\d/\d\d/", "MM/dd/yyyy"),
                (r"^(1[3-9]|[23]\d)/", "d/M/yyyy"), (r"^(1[3-9]|[23]\d)/\d\d/", "dd/MM/yyyy"),
                (r"^\d{1,2}\.", "d.M.yyyy"), (r"^\d\d\.\d\d\.", "dd.MM.yyyy"))
DAY_FIRST_SLASH = r"^(1[3-9]|[23]\d)/"
# country codes of one and of two digits; the others have three
SHORT_CODES = r"^[17]", r"^(2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"


def let(value: Column, of) -> Column:
    """``of(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), of), 0)


def keyed(key: str, kind: str, *parts: Column) -> Column:
    """Hex digest of key, kind and values."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts]), 256)


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """Struct (left, right): a keyed permutation of Z_a x Z_b."""
    def number(i, x, modulus):
        return F.conv(F.substring(keyed(key, kind, i, x, a, b), 1, 15), 16, 10).cast("long") % modulus

    def turn(h, i):
        return F.when(i % 2 == 0, F.struct(((h["left"] + number(i, h["right"], a)) % a).alias("left"),
                                           h["right"].alias("right"))) \
            .otherwise(F.struct(h["left"].alias("left"), ((h["right"] + number(i, h["left"], b)) % b).alias("right")))

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]),
                       F.struct(left.cast("long").alias("left"), right.cast("long").alias("right")), turn)


def power10(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), F.lit("0")).cast("long")


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A digit string of 2 to 36 digits, permuted among those of its length."""
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")
    high = (n - low).cast("int")
    h = feistel(F.substr(digits, F.lit(1), high).cast("long"), F.substr(digits, high + 1, low).cast("long"),
                power10(high), power10(low), key, kind)
    return F.concat(F.lpad(h["left"].cast("string"), high, F.lit("0")),
                    F.lpad(h["right"].cast("string"), low, F.lit("0")))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def lay(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced one after another by ``digits``."""
    def step(s, c):
        is_digit = c.between("0", "9")
        return F.when(is_digit, F.struct(F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"),
                                         (s["at"] + 1).alias("at"))) \
            .otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))

    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step,
                       lambda s: s["out"])


def check_digit(body: Column) -> Column:
    """The digit that makes ``body`` plus itself pass the mod 10 check."""
    doubled = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(
        i % 2 == 0, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5)).otherwise(c.cast("int")).cast("int"))
    total = F.aggregate(doubled, F.lit(0), lambda s, x: s + x)
    return ((10 - total % 10) % 10).cast("string")


def valid_card(value: Column) -> Column:
    d = digits_of(value)
    body = F.substr(d, F.lit(1), F.length(d) - 1)
    return (F.right(d, F.lit(1)) == check_digit(body)) & ~d.rlike("^0+$")


def card_pseudonym(value: Column, key: str) -> Column:
    d = digits_of(value)
    body = permute_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
    return lay(value, F.concat(body, check_digit(body)))


def country_code_digits(value: Column) -> Column:
    """Digits of the country code: those before the first separator, or by the plan if there is none."""
    first = F.regexp_extract(value, r"^\+(\d+)", 1)
    one, two = SHORT_CODES
    by_plan = F.when(first.rlike(one), 1).when(first.rlike(two), 2).otherwise(3)
    return F.when(F.length(first) <= 3, F.length(first)).otherwise(by_plan)


def phone_pseudonym(value: Column, key: str) -> Column:
    def of(d, code):
        n = F.least(F.lit(10), F.length(d) - code).cast("int")
        return let(F.right(d, n), lambda x: F.concat(F.substr(d, F.lit(1), F.length(d) - F.length(x)),
                                                     permute_digits(x, key, "phone")))

    parts = F.struct(digits_of(value).alias("digits"), country_code_digits(value).alias("code"))
    return lay(value, let(parts, lambda s: of(s["digits"], s["code"])))


def ssn_parts(value: Column) -> tuple[Column, Column, Column]:
    return tuple(F.element_at(F.split(value, "-"), k).cast("int") for k in (1, 2, 3))


def valid_ssn(value: Column) -> Column:
    area, group, serial = ssn_parts(value)
    return area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)


def ssn_pseudonym(value: Column, key: str) -> Column:
    area, group, serial = ssn_parts(value)
    h = feistel(area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1,
                F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), key, "ssn")
    a = h["left"] + 1 + F.when(h["left"] >= 665, 1).otherwise(0)
    return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"),
                       F.lpad((F.floor(h["right"] / 9999) + 1).cast("string"), 2, "0"),
                       F.lpad((h["right"] % 9999 + 1).cast("string"), 4, "0"))


def octets(value: Column) -> list[Column]:
    return [F.element_at(F.split(value, r"\."), k).cast("int") for k in (1, 2, 3, 4)]


def valid_ipv4(value: Column) -> Column:
    ok = None
    for o in octets(value):
        ok = (o <= 255) if ok is None else ok & (o <= 255)
    return ok & ~value.rlike(r"(^|\.)0\d")


def ipv4_pseudonym(value: Column, key: str) -> Column:
    a, b, c, d = octets(value)
    side = F.lit(65536).cast("long")
    h = feistel(a * 256 + b, c * 256 + d, side, side, key, "ipv4")
    return F.concat_ws(".", *[x.cast("string") for x in (F.floor(h["left"] / 256), h["left"] % 256,
                                                         F.floor(h["right"] / 256), h["right"] % 256)])


def read_date(value: Column) -> Column:
    out = F.lit(None).cast("date")
    for shape, form in DATE_FORMATS:
        out = F.when(value.rlike(shape), F.try_to_timestamp(value, F.lit(form)).cast("date")).otherwise(out)
    return out


def valid_date(value: Column) -> Column:
    day = F.datediff(read_date(value), F.lit(CYCLE_START).cast("date"))
    return F.coalesce(day.between(0, CYCLE_DAYS - 1), F.lit(False))


def permute_day(date: Column, key: str) -> Column:
    """A date of the cycle, permuted among all of them."""
    start = F.lit(CYCLE_START).cast("date")
    new = let(F.datediff(date, start), lambda day: feistel(F.floor(day / 773), day % 773, F.lit(189).cast("long"),
                                                           F.lit(773).cast("long"), key, "date"))
    return let(new, lambda h: F.date_add(start, (h["left"] * 773 + h["right"]).cast("int")))


def permute_late_day(date: Column, key: str) -> Column:
    """A date of the cycle from the 13th of a month on, permuted among those."""
    start = F.lit(CYCLE_START).cast("date")

    def rank(d):                        # among late days; each month up to this one has 12 others
        return F.datediff(d, start) - 12 * ((F.year(d) - 1800) * 12 + F.month(d))

    def late_day(r):
        # months have 18.4 late days on average; the one that holds a rank is at most one off
        near = F.floor(r * 4800 / LATE_DAYS).cast("int")
        months = F.filter(F.array(near - 1, near, near + 1), lambda m: F.datediff(F.add_months(start, m), start) - 12 * m <= r)
        return F.date_add(start, (r + 12 * (F.array_max(months) + 1)).cast("int"))

    new = let(let(date, rank), lambda r: feistel(F.floor(r / 9833), r % 9833, F.lit(9).cast("long"),
                                                 F.lit(9833).cast("long"), key, "late date"))
    return let(let(new, lambda h: h["left"] * 9833 + h["right"]), late_day)


def date_pseudonym(value: Column, key: str) -> Column:
    new = let(read_date(value), lambda d: F.when(value.rlike(DAY_FIRST_SLASH), permute_late_day(d, key))
              .otherwise(permute_day(d, key)))
    return let(new, lambda d: write_date(value, d))


def write_date(value: Column, new: Column) -> Column:
    """``new`` in the layout of ``value``."""
    out = F.lit(None).cast("string")
    for shape, form in DATE_FORMATS:
        out = F.when(value.rlike(shape), F.date_format(new, form)).otherwise(out)
    return out


def email_pseudonym(value: Column, key: str) -> Column:
    """Keyed letters for the local part, a reserved domain for the rest."""
    letters = F.translate(F.substring(keyed(key, "email", F.lower(value)), 1, 16), "0123456789", "ghijklmnop")
    return F.concat(letters, F.lit("@mail.invalid"))


def secret_pseudonym(value: Column, key: str) -> Column:
    """The name and opening quote, then a keyed hash as long as the secret."""
    head = F.regexp_extract(value, r"^(.*[\"'])", 1)
    secret = F.substr(value, F.length(head) + 1)
    digest = F.concat(keyed(key, "secret", secret), keyed(key, "secret2", secret))
    return F.concat(head, F.substr(digest, F.lit(1), F.length(secret)))


def kind_of(value: Column) -> Column:
    """The kind of a candidate if it is valid, else null."""
    return (F.when(value.contains("@"), F.lit("email"))
            .when(value.rlike("[\"']"), F.lit("secret"))
            .when(value.rlike(r"^\+|\(|^(1[ .\-])?\d{3}([ .\-])\d{3}\2\d{4}$"), F.lit("phone"))
            .when(value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(valid_ipv4(value), F.lit("ipv4")))
            .when(value.rlike(r"^(\d{4}([/\-])\d\d?\2\d\d?|\d\d?([/.])\d\d?\3\d{4})$"),
                  F.when(valid_date(value), F.lit("date")))
            .when(value.rlike(r"^\d{3}-\d\d-\d{4}$"), F.when(valid_ssn(value), F.lit("ssn")))
            .otherwise(F.when(valid_card(value), F.lit("card"))))


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    return (F.when(kind == "email", email_pseudonym(value, key))
            .when(kind == "secret", secret_pseudonym(value, key))
            .when(kind == "phone", phone_pseudonym(value, key))
            .when(kind == "ipv4", ipv4_pseudonym(value, key))
            .when(kind == "date", date_pseudonym(value, key))
            .when(kind == "ssn", ssn_pseudonym(value, key))
            .when(kind == "card", card_pseudonym(value, key))
            .otherwise(value))


def pseudonymise(df: DataFrame, key: str, text_col: str = "text", out_col: str = "text",
                 kinds_col: str = "pii_kinds") -> DataFrame:
    """``df`` with the values of ``text_col`` replaced in ``out_col``, and their kinds in order."""
    text = F.col(text_col)
    no_strings = F.array().cast("array<string>")
    found, parts = "__pii_found", "__pii_parts"
    hinted = F.coalesce(text.rlike(HINT), F.lit(False))
    out = (df.withColumn(found, F.when(hinted, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(no_strings))
           .withColumn(parts, F.when(F.size(found) > 0, F.split(text, CANDIDATE, -1)))
           .withColumn(found, F.transform(found, lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind"))))
           .withColumn(found, F.transform(found, lambda s: F.struct(
               pseudonym(s["value"], s["kind"], key).alias("value"), s["kind"].alias("kind")))))
    put = F.array_append(F.transform(found, lambda s: s["value"]), F.lit(""))
    joined = F.array_join(F.zip_with(parts, put, lambda p, v: F.concat(p, v)), "")
    return (out.withColumn(kinds_col, F.filter(F.transform(found, lambda s: s["kind"]), lambda k: k.isNotNull()))
            .withColumn(out_col, F.when(F.col(parts).isNull(), text).otherwise(joined)).drop(found, parts))
