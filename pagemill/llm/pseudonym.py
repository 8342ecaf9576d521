"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Candidates are found by one pattern per text, then validated (calendar dates,
Luhn numbers, address octets, assigned social-security areas); what fails is
left alone.  Values are permuted by a keyed, balanced-by-turns Feistel network
over their own format: equal values get equal pseudonyms in every document,
different ones different pseudonyms, and the holder of the key can invert it.

Kinds: email (local part), aws_key, secret (value after password= and the like;
hexadecimal stays so), ipv4, card (issuer digit kept, check digit recomputed),
phone (country code kept; the same number gets the same digits however it is written,
with or without +1; without a country code or brackets, its area and exchange must begin
with 2 to 9; ten digits in a row without a plus are no phone), ssn, date (1800 to 2199).

Rounds use SHA-256 of key, kind, round and the other half.  The key has no default: whoever
has it can invert the pseudonyms.  `session_key` reads it from a setting of the session.

Defined results: a null text stays null with nothing found; an empty text stays
empty; the key column may be null; repeated rows give repeated results; all
other columns are untouched, whatever their names.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
KEY_SETTING = "spark.pagemill.pseudonym.key"
#: The formats that are looked for. All start at a word's begin, so scanning is linear.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}+@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "aws_key": r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "secret": r"(?i:password|passwd|secret|token|api_key)\s{0,3}[=:]\s{0,3}\"?[0-9A-Za-z]{12,128}+",
    "ipv4": r"(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z])(?!\.[0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])",
    "date": r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z\-/])",
    "card": r"[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z])",
    "phone": r"(?:(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\)[ .\-]?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}|\+1[0-9]{10})(?![0-9A-Za-z\-])",
}
# a card's number doesn't run on into another value after a blank
_OTHER = "|".join(PATTERNS[k] for k in ("ssn", "date", "ipv4"))
PATTERNS["card"] = rf"[0-9](?:(?:[ \-](?!{_OTHER}))?[0-9]){{12,18}}(?![0-9A-Za-z])"
#: Lengths of card numbers in the order they are looked for inside a longer match.
CARD_LENGTHS = (16, 15, 13, 19, 14)
MAY_HOLD = r"[0-9@]|AKIA|(?i:password|passwd|secret|token|api_key)\s{0,3}[=:]"
ANY = r"(?<![A-Za-z0-9_@+])(?=[A-Za-z0-9(+])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: Fixed values of the calendar: 400 years of the Gregorian calendar have 146097 = 27 * 5411 days.
FIRST_DAY, DAYS_HIGH, DAYS_LOW = "1800-01-01", 27, 5411
#: 898 assignable areas (1..899 without 666), 99 groups, 9999 serials.
SSN_HIGH, SSN_LOW = 898 * 99, 9999


def _once(value: Column, step) -> Column:
    """step(value) with value computed once."""
    return F.get(F.transform(F.array(value), step), F.lit(0))


def session_key(spark: SparkSession) -> str:
    """The session's key; where none is set, a random one is made and set, so that values are linked within the session only."""
    key = spark.conf.get(KEY_SETTING, "") or secrets.token_hex(32)
    spark.conf.set(KEY_SETTING, key)
    return key


def _digest(kind: str | Column, turn: Column, half: Column, key: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind) if isinstance(kind, str) else kind, turn.cast("string"), half.cast("string")), 256)


def _number_from(digest: Column, modulus: int | Column) -> Column:
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(modulus))


def feistel_number(value: Column, high: int | Column, low: int, kind: str | Column, key: str, rounds: int = ROUNDS) -> Column:
    """Permutation of 0 .. high*low-1: the two digits of mixed radix are shifted by turns."""
    start = F.struct((F.floor(value / low)).cast("long").alias("l"), F.pmod(value.cast("long"), F.lit(low)).cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + _number_from(_digest(kind, i, s["r"], key), high), F.lit(high))
        right = F.pmod(s["r"] + _number_from(_digest(kind, i, s["l"], key), low), F.lit(low))
        return F.when(i % 2 == 0, F.struct(left.cast("long").alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), right.cast("long").alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn, lambda s: s["l"] * low + s["r"])


def _shift(text: Column, digest: Column, hexadecimal: bool) -> Column:
    """Each letter or digit moved within its class by a number from the digest."""

    def one(j: Column) -> Column:
        letter = F.substr(text, j, F.lit(1))
        by = F.conv(F.substr(digest, F.pmod((j - 1) * 4, F.lit(61)) + 1, F.lit(4)), 16, 10).cast("int")
        code = F.ascii(letter)
        if hexadecimal:
            digits = "0123456789abcdef"
            place = F.instr(F.lit(digits), letter) - 1
            return F.when(place >= 0, F.substr(F.lit(digits), F.pmod(place + by, F.lit(16)) + 1, F.lit(1))).otherwise(letter)
        rotate = lambda first, size: F.char(F.lit(first) + F.pmod(code - first + by, F.lit(size)))
        return F.when(code.between(48, 57), rotate(48, 10)).when(code.between(65, 90), rotate(65, 26)).when(code.between(97, 122), rotate(97, 26)).otherwise(letter)

    return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), one), ""))


def feistel_text(text: Column, kind: str | Column, key: str, rounds: int = ROUNDS, hexadecimal: bool = False) -> Column:
    """Permutation of the texts of one form: every letter and digit keeps its class and place."""

    def permuted(t: Column) -> Column:
        half = F.floor(F.length(t) / 2).cast("int")
        start = F.struct(F.substr(t, F.lit(1), half).alias("l"), F.substr(t, half + 1).alias("r"))

        def turn(s: Column, i: Column) -> Column:
            left = _once(_digest(kind, i, s["r"], key), lambda d: _shift(s["l"], d, hexadecimal))
            right = _once(_digest(kind, i, s["l"], key), lambda d: _shift(s["r"], d, hexadecimal))
            return F.when(i % 2 == 0, F.struct(left.alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), right.alias("r")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))

    return _once(text, permuted)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(form: Column, digits: Column) -> Column:
    """form with its digits replaced, in order, by the given ones."""

    def one(j: Column) -> Column:
        letter = F.substr(form, j, F.lit(1))
        before = F.length(_digits(F.substr(form, F.lit(1), j)))
        return F.when(letter.between("0", "9"), F.substr(digits, before, F.lit(1))).otherwise(letter)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), one), "")


def _luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Luhn sum; the digits at this parity from the right (last is 0) are doubled."""

    def add(total: Column, j: Column) -> Column:
        digit = F.substr(digits, j, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(F.pmod(F.length(digits) - j, F.lit(2)) == doubled_from_right, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _inner_card(match: Column) -> Column:
    """Struct (rank, s, n) of the valid number inside a match, between ends of its groups of digits; null if there is none."""
    places = F.sequence(F.lit(1), F.length(match))
    digit = lambda p: F.substr(match, p, F.lit(1)).between("0", "9")
    starts = F.filter(places, lambda p: digit(p) & ((p == 1) | ~digit(p - 1)))
    ends = F.filter(places, lambda p: digit(p) & ((p == F.length(match)) | ~digit(p + 1)))

    def piece(s: Column, e: Column) -> Column:
        d = _digits(F.substr(match, s, F.greatest(e - s + 1, F.lit(0))))
        rank = F.array_position(F.lit(list(CARD_LENGTHS)), F.length(d))
        valid = (rank > 0) & (F.pmod(_luhn_sum(d, 1), F.lit(10)) == 0)
        return F.when(valid, F.struct(rank.alias("rank"), s.alias("s"), (e - s + 1).alias("n")))

    return F.array_min(F.flatten(F.transform(starts, lambda s: F.transform(ends, lambda e: piece(s, e)))))


def _card(match: Column, key: str) -> Column:
    """The match with the valid number in it changed: all of it, else the first inner one."""

    def inner(c: Column) -> Column:
        number = _whole_card(F.substr(match, c["s"], c["n"]), key)
        return F.when(c.isNull(), match).otherwise(F.concat(F.substr(match, F.lit(1), c["s"] - 1), number, F.substr(match, c["s"] + c["n"])))

    valid = F.pmod(_luhn_sum(_digits(match), 1), F.lit(10)) == 0
    return F.when(valid, _whole_card(match, key)).otherwise(_once(_inner_card(match), inner))


def _whole_card(match: Column, key: str) -> Column:
    def changed(d: Column) -> Column:
        n = F.length(d)
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), feistel_text(F.substr(d, F.lit(2), n - 2), "card", key))
        whole = _once(body, lambda b: F.concat(b, F.pmod(10 - F.pmod(_luhn_sum(b, 0), F.lit(10)), F.lit(10)).cast("string")))
        return F.when(F.pmod(_luhn_sum(d, 1), F.lit(10)) == 0, _once(whole, lambda w: _refill(match, w))).otherwise(match)

    return _once(_digits(match), changed)


def _ipv4(match: Column, key: str) -> Column:
    part = lambda i: F.split_part(match, F.lit("."), F.lit(i)).cast("long")
    valid = F.forall(F.split(match, r"\."), lambda x: x.cast("int") <= 255)
    number = ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4)
    octet = lambda v, p: F.pmod(F.floor(v / p), F.lit(256)).cast("int").cast("string")
    made = _once(feistel_number(number, 65536, 65536, "ipv4", key), lambda v: F.concat_ws(".", *[octet(v, 256**p) for p in (3, 2, 1, 0)]))
    return F.when(valid, made).otherwise(match)


def _ssn(match: Column, key: str) -> Column:
    area, group, serial = (F.split_part(match, F.lit("-"), F.lit(i)).cast("int") for i in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1).cast("long") * SSN_LOW + serial - 1

    def spelled(v: Column) -> Column:
        high = F.floor(v / SSN_LOW).cast("int")
        a = F.floor(high / 99).cast("int")
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.concat_ws("-", pad(a + F.when(a >= 665, 2).otherwise(1), 3), pad(F.pmod(high, F.lit(99)) + 1, 2), pad(F.pmod(v, F.lit(SSN_LOW)) + 1, 4))

    return F.when(valid, _once(feistel_number(rank, SSN_HIGH, SSN_LOW, "ssn", key), spelled)).otherwise(match)


def _date(match: Column, key: str) -> Column:
    def changed(form: str) -> Column:
        parsed = F.try_to_date(match, form)
        day = F.date_diff(parsed, F.lit(FIRST_DAY).cast("date"))
        moved = F.date_add(F.lit(FIRST_DAY).cast("date"), feistel_number(day, DAYS_HIGH, DAYS_LOW, "date", key).cast("int"))
        return F.when(parsed.isNull() | ~day.between(0, DAYS_HIGH * DAYS_LOW - 1), match).otherwise(F.date_format(moved, form))

    def month_first() -> Column:
        # these have days over 12 and are moved among themselves, so that none gets the pseudonym of a day-first date
        form = "MM/dd/yyyy"
        parsed = F.try_to_date(match, form)
        first = F.lit(FIRST_DAY).cast("date")
        turned = lambda v: feistel_number(v, DAYS_HIGH, DAYS_LOW, "date", key)
        late = lambda v: F.dayofmonth(F.date_add(first, v.cast("int"))) > 12
        day = F.date_diff(parsed, first).cast("long")
        moved = F.aggregate(F.sequence(F.lit(1), F.lit(100)), turned(day), lambda v, _: F.when(late(v), v).otherwise(turned(v)))
        return F.when(parsed.isNull() | ~day.between(0, DAYS_HIGH * DAYS_LOW - 1), match).otherwise(F.date_format(F.date_add(first, moved.cast("int")), form))

    slashed = F.when(F.try_to_date(match, "dd/MM/yyyy").isNotNull(), changed("dd/MM/yyyy")).otherwise(month_first())
    return F.when(F.substr(match, F.lit(5), F.lit(1)) == "-", changed("yyyy-MM-dd")).otherwise(slashed)


def _secret(match: Column, key: str) -> Column:
    value = F.regexp_extract(match, r"([0-9A-Za-z]+)$", 1)
    head = F.substr(match, F.lit(1), F.length(match) - F.length(value))
    return F.concat(head, F.when(value.rlike("^[0-9a-f]+$"), feistel_text(value, "secret", key, hexadecimal=True)).otherwise(feistel_text(value, "secret", key)))


def _phone(match: Column, key: str) -> Column:
    """The digits behind the country code changed.

    In the North American plan (no code, or 1), areas and exchanges that begin with 2 to 9
    (800 each) stay so, and the 200 others stay others.
    """

    def parts(d: Column) -> Column:
        national = F.right(d, F.lit(10))
        place = lambda i, n: F.substr(national, F.lit(i), F.lit(n)).cast("long")
        return F.struct(F.left(d, F.length(d) - 10).alias("code"), national.alias("national"), place(1, 3).alias("area"), place(4, 3).alias("exchange"), place(7, 4).alias("line"))

    def placed(p: Column) -> Column:
        low = lambda c: F.when(p[c] >= 200, 200).otherwise(0).cast("long")
        size = lambda c: F.when(p[c] >= 200, 800).otherwise(200).cast("long")
        kind = F.concat(F.lit("phone"), (p["area"] >= 200).cast("int").cast("string"), (p["exchange"] >= 200).cast("int").cast("string"))
        rank = ((p["area"] - low("area")) * size("exchange") + p["exchange"] - low("exchange")) * 10_000 + p["line"]
        return F.struct(p["code"].alias("code"), p["national"].alias("national"), low("area").alias("a"), low("exchange").alias("e"), size("exchange").alias("m"), (size("area") * size("exchange")).alias("high"), kind.alias("kind"), rank.alias("rank"))

    def digits(p: Column) -> Column:
        pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")

        def spelled(v: Column) -> Column:
            high = F.floor(v / 10_000)
            return F.concat(pad(F.floor(high / p["m"]) + p["a"], 3), pad(F.pmod(high, p["m"]) + p["e"], 3), pad(F.pmod(v, F.lit(10_000)), 4))

        home = _once(feistel_number(p["rank"], p["high"], 10_000, p["kind"], key), spelled)
        abroad = feistel_text(p["national"], F.concat(F.lit("phone"), p["code"]), key)
        return F.concat(p["code"], F.when(p["code"].isin("", "1"), home).otherwise(abroad))

    changed = _once(_once(_once(_once(_digits(match), parts), placed), digits), lambda new: _refill(match, new))
    marked = match.startswith("+") | match.contains("(")
    return F.when(marked | match.rlike(r"^[2-9]..[ .\-][2-9]"), changed).otherwise(match)


def kind_of(match: Column) -> Column:
    """The first kind whose format the match has as a whole."""
    out = None
    for kind, pattern in PATTERNS.items():
        test = match.rlike(f"^(?:{pattern})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def pseudonym(match: Column, kind: Column, key: str) -> Column:
    at = F.instr(match, "@")
    return (
        F.when(kind == "email", F.concat(feistel_text(F.substr(match, F.lit(1), at - 1), "email", key), F.substr(match, at)))
        .when(kind == "aws_key", F.concat(F.lit("AKIA"), feistel_text(F.substr(match, F.lit(5)), "aws_key", key)))
        .when(kind == "secret", _secret(match, key))
        .when(kind == "ipv4", _ipv4(match, key))
        .when(kind == "ssn", _ssn(match, key))
        .when(kind == "date", _date(match, key))
        .when(kind == "card", _card(match, key))
        .when(kind == "phone", _phone(match, key))
        .otherwise(match)
    )


def pseudonymised(text: Column, key: str) -> Column:
    """Struct (text, n_replaced): the text with all validated values replaced."""
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    changed = F.transform(found, lambda m: pseudonym(m, kind_of(m), key))

    def joined(new: Column) -> Column:
        gaps = F.split(text, ANY)
        pieces = F.zip_with(gaps, new, lambda g, n: F.concat(g, F.coalesce(n, F.lit(""))))
        replaced = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
        return F.struct(F.array_join(pieces, "").alias("text"), replaced.cast("long").alias("n_replaced"))

    untouched = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_replaced"))
    # every pattern needs one of these; texts without aren't searched any further
    return F.when(text.rlike(MAY_HOLD) & (F.size(found) > 0), _once(changed, joined)).otherwise(untouched)


def pseudonymise(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(row, text, n_replaced): row is the whole input row, so that no name can clash."""
    chosen = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), pseudonymised(F.col(f"`{text}`").cast("string"), key).alias("p"))
    return chosen.select("row", "p.text", "p.n_replaced")
