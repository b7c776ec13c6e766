"""Format-preserving pseudonyms for personal data, in DataFrame expressions alone.

Candidates are found by one pattern and validated by kind: card numbers by their check digit,
account numbers by their remainder, dates by the calendar, addresses by their octets. A valid
number or date is permuted within its own format by a keyed Feistel network over two residues,
so it stays valid, equal values get equal pseudonyms in every document, and different values
different ones. Mail addresses and secrets, which have no number format, get keyed digests.

Secrets are found behind a name and a sign (the name may be quoted, as in JSON), at any length of 8
and more, of any characters: one in quotes runs to the closing quote of its line, over quotes
behind a backslash; one without, or without a closing quote, to the next white space, less closing
punctuation.
Dates are found as year-month-day with dashes, and with two-digit days and months before the year
behind ``.``, ``/`` or ``-``: day first where that is a date, otherwise month first. Dates that
can only be read month first are permuted among themselves, so they keep apart from all others
but are not linked to other notations of the same day. Two-digit years, one-digit days and months
and names of months are not found.

Without the key a pseudonym can't be led back; with it the permutations can be inverted.

Nulls: a null text stays null, an empty one empty; every other column is left alone. Repeated
rows get equal results.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscan.llm.order_minhash import let

KEY_SETTING = "spark.shelfscan.pseudonymKey"
ROUNDS = 10
FIRST_DAY, LAST_DAY = "1900-01-01", "2099-12-31"
DAYS = 73_049
DAY_PARTS = (271, 270)  # their product is the next domain above DAYS; the few beyond are walked over
LATE_DAYS = 44_249  # days after the 12th of their month
LATE_DAY_PARTS = (211, 210)
MONTHS = 2400

_BARE = r"[^\s\"']\S{6,}[^\s.,;:!?)\]}\"'>]"  # eight characters or more, without closing punctuation
_SECRET = (
    r"(?:\"(?:[^\"\\\r\n]|\\.){8,}+\"|'(?:[^'\\\r\n]|\\.){8,}+'|[\"'](?![^\r\n]*[\"'])" + _BARE + "|" + _BARE + ")"
)

#: Candidates by kind, in the order in which they are tried at a place. Group 1 is the mark in a
#: date and group 2 that in a card number, counted over all patterns together.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}",
    "secret": r"(?<![A-Za-z0-9])(?i:password|passwd|token|secret|api[_-]?key)[\"']?\s*+[=:]\s*+" + _SECRET,
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+])\+[0-9]{1,3}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})){2,6}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|-[0-9])",
    "date": r"(?<![A-Za-z0-9./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./-])[0-9]{2}\1(?:19|20)[0-9]{2})(?![A-Za-z0-9]|[./-][0-9])",
    "ip": r"(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9]|\.[0-9])",
    "card": r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![A-Za-z0-9])",
}
ANY = "|".join(PATTERNS.values())


def keyed_number(key: str, tweak: Column, turn: Column, value: Column) -> Column:
    """A number below 2^60 that follows from the key and the arguments."""
    text = F.concat_ws(":", F.lit(key), tweak, turn.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def feistel(high: Column, low: Column, high_size: Column, low_size: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of the pairs (high, low) with high < high_size and low < low_size.

    Rounds add a keyed function of one half to the other, modulo the size of that one in turn,
    so each round is one to one whatever the two sizes are.
    """

    def turn(pair: Column, r: Column) -> Column:
        moved_high = F.struct(
            F.pmod(pair["high"] + F.pmod(keyed_number(key, tweak, r, pair["low"]), high_size), high_size).alias("high"),
            pair["low"].alias("low"),
        )
        moved_low = F.struct(
            pair["high"].alias("high"),
            F.pmod(pair["low"] + F.pmod(keyed_number(key, tweak, r, pair["high"]), low_size), low_size).alias("low"),
        )
        return F.when(r % 2 == 0, moved_high).otherwise(moved_low)

    start = F.struct(high.cast("bigint").alias("high"), low.cast("bigint").alias("low"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permuted_digits(digits: Column, key: str, tweak: str) -> Column:
    """A string of 2 to 34 digits, permuted among the strings of its length."""

    def permute(n: Column) -> Column:
        left = F.floor(n / 2).cast("int")
        power = lambda length: F.pow(F.lit(10.0), length).cast("bigint")
        pair = feistel(
            F.substring(digits, F.lit(1), left).cast("bigint"),
            F.substring(digits, left + 1, n - left).cast("bigint"),
            power(left),
            power(n - left),
            key,
            F.concat(F.lit(tweak), n.cast("string")),
        )
        return let(
            pair,
            lambda p: F.concat(F.lpad(p["high"].cast("string"), left, "0"), F.lpad(p["low"].cast("string"), n - left, "0")),
        )

    return F.when(F.length(digits) < 2, digits).otherwise(let(F.length(digits), permute))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def with_digits(value: Column, digits: Column, keep: int = 0) -> Column:
    """``value`` with its digits, from the one after the first ``keep``, replaced one by one."""

    def place(c: Column, i: Column) -> Column:
        number = F.length(digits_of(F.substring(value, F.lit(1), i + 1)))
        return F.when(c.rlike("[0-9]") & (number > keep), F.substring(digits, number - keep, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), place), "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits from the right, every second one doubled and folded below ten."""
    reverse = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    folded = F.transform(reverse, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(folded, F.lit(0), lambda total, d: total + d)


def remainder_97(text: Column) -> Column:
    """Remainder by 97 of a text whose letters count as two digits each, A as 10."""
    return F.aggregate(
        F.split(text, ""),
        F.lit(0),
        lambda total, c: F.when(c.rlike("[0-9]"), (total * 10 + F.ascii(c) - 48) % 97).otherwise(
            (total * 100 + F.ascii(c) - 55) % 97
        ),
    )


def _card(value: Column, key: str) -> Column:
    """All digits but the first and the check digit are permuted; the check digit is renewed."""

    def replaced(digits: Column) -> Column:
        n = F.length(digits)
        inner = permuted_digits(F.substring(digits, F.lit(2), n - 2), key, "card")
        body = F.concat(F.substring(digits, 1, 1), inner)
        return let(
            body,
            lambda b: with_digits(value, F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string"))),
        )

    return let(digits_of(value), lambda d: F.when((luhn_sum(d) % 10 == 0) & (d.cast("decimal(19,0)") > 0), replaced(d)))


def _iban(value: Column, key: str) -> Column:
    """The digits behind the check digits are permuted, letters stay; the check digits are renewed."""

    def replaced(plain: Column) -> Column:
        body = F.substring(plain, F.lit(5), F.length(plain) - 4)
        changed = with_digits(body, permuted_digits(digits_of(body), key, "iban"))
        return let(
            changed,
            lambda b: let(
                F.lpad(
                    (98 - remainder_97(F.concat(b, F.substring(plain, 1, 2), F.lit("00")))).cast("string"), 2, "0"
                ),
                lambda check: with_digits(value, F.concat(check, digits_of(b))),
            ),
        )

    return let(
        F.regexp_replace(value, " ", ""),
        lambda p: F.when(
            F.length(p).between(15, 34)
            & (remainder_97(F.concat(F.substring(p, F.lit(5), F.length(p) - 4), F.substring(p, 1, 4))) == 1),
            replaced(p),
        ),
    )


def _phone(value: Column, key: str) -> Column:
    """The national number is permuted; ten digits in the North American plan stay in that plan.

    A number has 8 to 15 digits in all.
    """
    country = F.regexp_extract(value, r"^\+([0-9]{1,3}?)(?=[ .(-]|[0-9]{10}$)", 1)

    def replaced(all_digits: Column) -> Column:
        code = F.length(country)
        national = F.substring(all_digits, code + 1, F.length(all_digits) - code)
        area, office = F.substring(national, 1, 3).cast("int"), F.substring(national, 4, 3).cast("int")
        planned = (F.length(national) == 10) & (area >= 200) & (office >= 200) & country.isin("", "1")
        # 800 areas by 800 offices by 10,000 lines, halved into two equal parts
        number = (area.cast("bigint") - 200) * 8_000_000 + (office - 200) * 10_000 + F.substring(national, 7, 4).cast("int")
        half = F.lit(80_000).cast("bigint")
        moved = let(
            number,
            lambda x: let(
                feistel(F.floor(x / 80_000), x % 80_000, half, half, key, F.lit("phone")),
                lambda p: p["high"] * 80_000 + p["low"],
            ),
        )
        in_plan = let(
            moved,
            lambda x: F.concat(
                (F.floor(x / 8_000_000) + 200).cast("string"),
                (F.floor(x / 10_000) % 800 + 200).cast("string"),
                F.lpad((x % 10_000).cast("string"), 4, "0"),
            ),
        )
        digits = F.when(planned, in_plan).otherwise(permuted_digits(national, key, "phone"))
        return with_digits(value, F.concat(F.substring(all_digits, F.lit(1), code), digits))

    return let(digits_of(value), lambda d: F.when(F.length(d).between(8, 15), replaced(d)))


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.substring(value, at, n).cast("bigint") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    rank = area - 1 - F.when(area > 666, 1).otherwise(0)

    def joined(p: Column) -> Column:
        number = p["high"] + 1 + F.when(p["high"] >= 665, 1).otherwise(0)
        return F.concat_ws(
            "-",
            F.lpad(number.cast("string"), 3, "0"),
            F.lpad((F.floor(p["low"] / 9999) + 1).cast("string"), 2, "0"),
            F.lpad((p["low"] % 9999 + 1).cast("string"), 4, "0"),
        )

    pair = feistel(
        rank,
        (group - 1) * 9999 + serial - 1,
        F.lit(898).cast("bigint"),
        F.lit(99 * 9999).cast("bigint"),
        key,
        F.lit("ssn"),
    )
    return F.when(valid, let(pair, joined))


def _ip(value: Column, key: str) -> Column:
    def replaced(octets: Column) -> Column:
        valid = F.forall(octets, lambda o: o <= 255)
        size = F.lit(65_536).cast("bigint")
        pair = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], size, size, key, F.lit("ip"))
        return F.when(
            valid,
            let(
                pair,
                lambda p: F.concat_ws(
                    ".",
                    *[x.cast("string") for part in ("high", "low") for x in (F.floor(p[part] / 256), p[part] % 256)],
                ),
            ),
        )

    return let(F.transform(F.split(value, r"\."), lambda o: o.cast("int")), replaced)


def _permuted_day(day: Column, days: int, parts: tuple[int, int], key: str, tweak: str) -> Column:
    """A number below ``days``, permuted among those."""
    high, low = (F.lit(n).cast("bigint") for n in parts)

    def step(day: Column) -> Column:
        return let(
            feistel(F.floor(day / parts[1]), day % parts[1], high, low, key, F.lit(tweak)),
            lambda p: p["high"] * parts[1] + p["low"],
        )

    # A walk ends within the number of places beyond the last day; nearly all end at once.
    beyond = parts[0] * parts[1] - days
    return F.aggregate(F.sequence(F.lit(1), F.lit(beyond)), step(day), lambda d, _: F.when(d < days, d).otherwise(step(d)))


def _late_days_before(month: Column) -> Column:
    """How many days after the 12th lie before a month, counted from the first."""
    first = F.lit(FIRST_DAY).cast("date")
    return F.datediff(F.add_months(first, month), first) - 12 * month


def _late_day(number: Column) -> Column:
    """The date of a day by its number among the days after the 12th."""
    guess = F.greatest(F.floor(number * MONTHS / LATE_DAYS).cast("int") - 3, F.lit(0))
    month = F.aggregate(
        F.sequence(F.lit(1), F.lit(7)),
        guess,
        lambda m, _: F.when(_late_days_before(m + 1) <= number, m + 1).otherwise(m),
    )
    return let(
        month,
        lambda m: F.date_add(
            F.add_months(F.lit(FIRST_DAY).cast("date"), m), (number - _late_days_before(m)).cast("int") + 12
        ),
    )


def _date(value: Column, key: str) -> Column:
    """A day of 1900 to 2099 becomes another one, in the same notation."""
    year_first = value.rlike("^[0-9]{4}")
    year, first, second = F.substring(value, 7, 4), F.substring(value, 1, 2), F.substring(value, 4, 2)
    start, mark = F.lit(FIRST_DAY).cast("date"), F.substring(value, 3, 1)

    def written(day: Column) -> Column:
        date = F.date_add(start, day.cast("int")).cast("string")
        return F.when(year_first, date).otherwise(
            F.concat(F.substring(date, 9, 2), mark, F.substring(date, 6, 2), mark, F.substring(date, 1, 4))
        )

    # If the second number is no month, the day is after the 12th.
    parsed = F.when(year_first, value).otherwise(F.concat_ws("-", year, second, first)).try_cast("date")
    month_first = F.when(~year_first & (second > "12"), F.concat_ws("-", year, first, second)).try_cast("date")
    day = F.datediff(parsed, start).cast("bigint")
    month = ((F.year(month_first) - 1900) * 12 + F.month(month_first) - 1).cast("int")
    late = (F.datediff(month_first, start) - 12 * (month + 1)).cast("bigint")
    return F.when(parsed.isNotNull(), let(_permuted_day(day, DAYS, DAY_PARTS, key, "date"), written)).when(
        month_first.isNotNull(),
        let(
            _permuted_day(late, LATE_DAYS, LATE_DAY_PARTS, key, "late date"),
            lambda n: let(
                _late_day(n).cast("string"),
                lambda d: F.concat(F.substring(d, 6, 2), mark, F.substring(d, 9, 2), mark, F.substring(d, 1, 4)),
            ),
        ),
    )


def _digest(key: str, kind: str, value: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), value), 256)


def _email(value: Column, key: str) -> Column:
    return F.concat(F.lit("user-"), F.substring(_digest(key, "email", F.lower(value)), 1, 24), F.lit("@example.com"))


def _secret(value: Column, key: str) -> Column:
    """The part behind the sign is replaced by as many digits of a keyed digest."""
    parts = r"(?s)^([A-Za-z_-]+[\"']?\s*[=:]\s*[\"']?)(.*?)([\"']?)\z"
    secret = F.regexp_extract(value, parts, 2)
    digest = F.repeat(_digest(key, "secret", secret), F.ceil(F.length(secret) / 64).cast("int"))
    return F.concat(
        F.regexp_extract(value, parts, 1),
        F.substring(digest, F.lit(1), F.length(secret)),
        F.regexp_extract(value, parts, 3),
    )


KINDS = {
    "email": _email,
    "secret": _secret,
    "iban": _iban,
    "phone": _phone,
    "ssn": _ssn,
    "date": _date,
    "ip": _ip,
    "card": _card,
}


def _kind(value: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name in reversed(PATTERNS):
        own = PATTERNS[name].replace("\\2", "\\1")
        kind = F.when(value.rlike(rf"\A(?:{own})\z"), F.lit(name)).otherwise(kind)
    return kind


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a candidate, or null if it isn't valid."""
    out = F.lit(None).cast("string")
    for name, replace in KINDS.items():
        out = F.when(kind == name, replace(value, key)).otherwise(out)
    return out


def found(text: Column, key: str) -> Column:
    """The candidates of a text in order: value, kind and pseudonym (null: not valid, left alone)."""

    def judged(value: Column) -> Column:
        return let(
            _kind(value),
            lambda kind: F.struct(value.alias("value"), kind.alias("kind"), pseudonym(value, kind, key).alias("pseudonym")),
        )

    return F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), judged)


def rewritten(text: Column, values: Column) -> Column:
    """The text with each candidate that has a pseudonym replaced by it."""
    pieces = F.zip_with(
        F.split(text, ANY, -1),
        values,
        lambda piece, v: F.concat(piece, F.coalesce(v["pseudonym"], v["value"], F.lit(""))),
    )
    return F.when(F.size(values) > 0, F.array_join(pieces, "")).otherwise(text)


def session_key(spark: SparkSession, default: str | None = None) -> str:
    """The key that the session is set to use; ``default``, with a warning, or an error if there is none."""
    key = spark.conf.get(KEY_SETTING, default)
    if key is None:
        raise ValueError(f"set {KEY_SETTING} to a key of your own: with a known key pseudonyms can be led back")
    if key == default:
        warnings.warn(f"{KEY_SETTING} is not set; pseudonyms are made with a key that everyone knows", stacklevel=2)
    return key


def masked(documents: DataFrame, key: str) -> DataFrame:
    """The documents with their texts rewritten; all other columns as they were."""
    text = let(found(F.col("text"), key), lambda values: rewritten(F.col("text"), values))
    return documents.withColumn("text", text)


def pseudonymise(documents: DataFrame, key: str) -> DataFrame:
    """Per document: doc_id, the text rewritten, n_replaced, and the kinds of data replaced."""
    valid = F.filter(F.col("values"), lambda v: v["pseudonym"].isNotNull())
    return documents.select("doc_id", "text", found(F.col("text"), key).alias("values")).select(
        "doc_id",
        rewritten(F.col("text"), F.col("values")).alias("text"),
        F.coalesce(F.size(valid).cast("long"), F.lit(0).cast("long")).alias("n_replaced"),
        F.coalesce(
            F.array_join(F.array_sort(F.array_distinct(F.transform(valid, lambda v: v["kind"]))), ","), F.lit("")
        ).alias("kinds"),
    )
