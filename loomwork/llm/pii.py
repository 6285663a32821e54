"""Personal data under format-preserving Feistel pseudonyms, in DataFrame functions only.

Found values are validated (check digit, octets, calendar, number plan) and then permuted with a key within their own
format: a card number becomes another valid card number, a date another date, an address another address of the same
shape. The permutation is a Feistel network: the value is halved, and each half is shifted in turn by a keyed SHA-512 of
the other half, so equal values get equal pseudonyms in every document and no table of pseudonyms is needed. Valid values
stay valid: the network runs over the numbers of the valid values (dates, addresses, social security numbers, phone
numbers of the North American plan), or check digits are computed anew (cards, accounts), or the cycle of the permutation
is walked until the value reads as it did before. International phone numbers keep their country code and the first digit
behind it. With the key, ``pseudonym(..., back=True)`` gives the value back. Values that fail validation, and everything
around the values, stay as they are; phone numbers are known by their shape, and those outside the number plan are
permuted among themselves. The key is a parameter or the session's ``loomwork.pseudonym.secret``; a plan holds keys that are
derived from it for each permutation, and Spark is told to leave those out of the plans that it shows.

Kinds, in the order in which they are tried: e-mail addresses, secrets (cloud access keys; hexadecimal values of 16 digits
or more after any key with = or :, and values with digits and letters of both cases after a key that names a credential),
dates (1800 to 2199, a full Gregorian cycle; yyyy-mm-dd, d/m/yyyy and m/d/yyyy with - / or ., English month names), IPv4 and
IPv6 addresses, international bank account numbers (check digits), phone numbers (+1 (ddd) ddd-dddd, ddd-ddd-dddd,
international ones with or without separators, ten digits with spaces that fit the North American plan), social security
numbers, card numbers (13 to 19 digits in one piece, in groups of four or 4-6-5, with a valid check digit).

A slashed date that can be read both ways counts as month first, one with dots or hyphens as day first.

Defined results: null text stays null, empty text empty; a text is searched whole, however long; repeated rows get equal
results; an empty table gives an empty one; a column named like a result is replaced, other columns pass through,
whatever they are called.
"""

from __future__ import annotations

import hmac
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm._common import documents, free_names, own_columns

_YEAR = r"(?:1[89]|2[01])\d\d"
_MONTH = (
    r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?"
    r"|Nov(?:ember)?|Dec(?:ember)?)"
)
_DAY = r"[0-3]?\d(?:st|nd|rd|th)?"
_HEX = r"[0-9A-Fa-f]"
#: After a key: its quote, = or :, and the value's quote; the last of these characters belongs to the value found.
_ASSIGNED = r"[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?"
_NO_ADDRESS = r"(?![A-Za-z0-9._%+\-]{0,63}@)"
#: What each kind looks like. No groups that capture, and no look-behind of open length.
KINDS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]{0,63})@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62})\.)+[A-Za-z]{2,24}",
    "secret": r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
    rf"|[=: \t\"'](?={_HEX}{{16}})(?<=[A-Za-z0-9_\-]{_ASSIGNED})(?=\d*[A-Fa-f]){_HEX}{{16,}}+(?![A-Za-z0-9]){_NO_ADDRESS}"
    rf"|[=: \t\"'](?=[A-Za-z0-9_+/\-]{{16}})(?<=(?i:token|password|passwd|pwd|secret|key|credential)(?:[_\-][A-Za-z0-9]{{1,16}})?{_ASSIGNED})"
    rf"(?:(?=\d+(?![A-Za-z0-9_+/\-]))|(?=[A-Za-z_+/\-]*\d)(?=[A-Z0-9_+/\-]*[a-z])(?=[a-z0-9_+/\-]*[A-Z]))"
    rf"[A-Za-z0-9_+/\-]{{16,}}+={{0,2}}{_NO_ADDRESS}",
    "date": rf"(?<!\d)(?<!\d[\-./]){_YEAR}(?:-(?:0[1-9]|1[0-2])-|/(?:0[1-9]|1[0-2])/|\.(?:0[1-9]|1[0-2])\.)(?:0[1-9]|[12]\d|3[01])(?!\d|[\-.]\d|/\d(?!\d\d\d-))"
    rf"|(?<=\d\d\d\d-\d\d-\d\d/){_YEAR}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?!\d|[\-./]\d)"
    rf"|(?<!\d)(?<!\d[\-./])[0-3]?\d(?:/[0-3]?\d/|\.[01]?\d\.|-[0-3]?\d-){_YEAR}(?!\d|[\-./]\d)"
    rf"|(?<![A-Za-z]){_MONTH}\.? {_DAY},? {_YEAR}(?!\d)|(?<!\d){_DAY} {_MONTH}\.?,? {_YEAR}(?!\d)",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "ipv6": rf"(?<![A-Za-z0-9:.])(?={_HEX}{{0,4}}:)(?=[A-Fa-f:]*\d)(?:(?:{_HEX}{{1,4}}:){{7}}{_HEX}{{1,4}}"
    rf"|(?={_HEX}{{3}})(?!(?:{_HEX}*:+){{8}})(?:{_HEX}{{1,4}}:){{1,6}}(?::{_HEX}{{1,4}}){{1,6}}|(?={_HEX}{{3}})(?:{_HEX}{{1,4}}:){{1,7}}:)(?![A-Za-z0-9]|:)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d\d(?:[A-Z0-9]{11,30}| [A-Z0-9]{4}(?: (?=[A-Z]{0,3}\d)[A-Z0-9]{4}){1,6}(?: (?=[A-Z]{0,2}\d)[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "phone": r"(?<![\d+])(?:\+1 ?\(\d{3}\) ?|\+1[ .\-]\d{3}[ .\-]|\(\d{3}\) |\d{3}[.\-](?=\d{3}[.\-]\d{4}))\d{3}[ .\-]\d{4}(?!\d)"
    r"|(?<![\d+])\+[2-9]\d{0,2}(?:[ \-]\d{2,4}){2,5}(?!\d)"
    r"|(?<![\d+])\+[1-9]\d{7,14}(?!\d)"
    r"|(?<![\d+])(?<!\d[ .,\-])[2-9]\d\d [2-9]\d\d \d{4}(?!\d|[ .,\-]\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<!\d)(?<!\d[.\-])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d|-\d)",
}
#: Every value of every kind has a part that this finds; texts without it are not searched.
MAY_HOLD = r"[0-9@]|AKIA|[A-Fa-f]{16}"
MONTHS = "January February March April May June July August September October November December".split()
#: Where a session has its key. Spark hides settings with this word in their names from its pages and logs.
KEY_SETTING = "loomwork.pseudonym.secret"
#: What plans hold are keys derived from it; this finds them, so that Spark leaves them out of what it shows of plans.
ROUND_KEY = r"fpk_[0-9a-f]{64}"
REDACTION = "spark.sql.redaction.string.regex"
ROUNDS = 8
#: Steps of a walk along a cycle; of a permutation's values at least six tenths end it, so a longer walk has a chance of 1e-25.
WALK = 64
#: Country calling codes of one and two digits; the others have three.
COUNTRY_CODE = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
CYCLE_DAYS = 146097
FIRST_DAY = "1800-01-01"


def _pattern() -> str:
    return "|".join(f"(?:{p})" for p in KINDS.values())


def round_key(key: str | None, tweak: str) -> str:
    """The key of one permutation. Without a ``key`` it is the session's; there is none to fall back on."""
    session = SparkSession.getActiveSession()
    key = key or (session.conf.get(KEY_SETTING, None) if session else None)
    if not key:
        raise ValueError(f"pseudonyms need a key: give one, or set {KEY_SETTING}")
    return "fpk_" + hmac.new(key.encode(), tweak.encode(), "sha256").hexdigest()


def _shift_half(half: Column, other: Column, tweak: str, key: str | None, hex_only: bool | Column, back: bool) -> Column:
    """Each character moved within its own class by a byte of the keyed digest of the other half."""
    digest = F.sha2(F.concat(F.lit(f"{round_key(key, tweak)}|"), other), 512)
    letters = F.when(F.lit(hex_only) if isinstance(hex_only, bool) else hex_only, 6).otherwise(26)

    def moved(c: Column, i: Column) -> Column:
        byte = F.conv(F.substr(digest, (i % 63) * 2 + 1, F.lit(4)), 16, 10).cast("int")
        byte = -byte if back else byte

        def within(first: str, size: Column) -> Column:
            return F.char(F.pmod(F.ascii(c) - ord(first) + byte, size) + ord(first))

        return (
            F.when(c.rlike("^[0-9]$"), within("0", F.lit(10)))
            .when(c.rlike("^[a-z]$"), within("a", letters))
            .when(c.rlike("^[A-Z]$"), within("A", letters))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(half, ""), moved), "")


def _rounds(back: bool) -> Column:
    return F.sequence(F.lit(ROUNDS // 2), F.lit(1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS // 2))


def permuted_string(
    value: Column, tweak: str, key: str | None = None, hex_only: bool | Column = False, back: bool = False
) -> Column:
    """A string of the same shape: digits for digits, letters for letters of the same case, the rest in place."""
    cut = (F.length(value) / 2).cast("int")
    halves = F.struct(F.substr(value, F.lit(1), cut).alias("l"), F.substr(value, cut + 1, F.length(value)).alias("r"))

    def left(half: Column, other: Column, n: Column) -> Column:
        return _shift_half(half, F.concat(n.cast("string"), F.lit("L"), other), tweak, key, hex_only, back)

    def right(half: Column, other: Column, n: Column) -> Column:
        return _shift_half(half, F.concat(n.cast("string"), F.lit("R"), other), tweak, key, hex_only, back)

    def one(state: Column, n: Column) -> Column:
        if back:
            return let(right(state["r"], state["l"], n), lambda r: F.struct(left(state["l"], r, n).alias("l"), r.alias("r")))
        return let(left(state["l"], state["r"], n), lambda x: F.struct(x.alias("l"), right(state["r"], x, n).alias("r")))

    return F.aggregate(_rounds(back), halves, one, lambda s: F.concat(s["l"], s["r"]))


def permuted_number(
    value: Column, a: int | Column, b: int | Column, tweak: str, key: str | None = None, back: bool = False
) -> Column:
    """A bijection of 0 .. a*b-1, as a Feistel network over the pair (value div b, value mod b)."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    start = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, b).cast("long").alias("r"))

    def drawn(other: Column, n: Column, side: str) -> Column:
        text = F.concat(F.lit(f"{round_key(key, tweak)}|{side}|"), n.cast("string"), F.lit("|"), other.cast("string"))
        number = F.conv(F.substring(F.sha2(text, 256), 1, 14), 16, 10).cast("long")
        return -number if back else number

    def one(state: Column, n: Column) -> Column:
        def left(other: Column) -> Column:
            return F.pmod(state["l"] + drawn(other, n, "l"), a).cast("long")

        def right(other: Column) -> Column:
            return F.pmod(state["r"] + drawn(other, n, "r"), b).cast("long")

        if back:
            return let(right(state["l"]), lambda r: F.struct(left(r).alias("l"), r.alias("r")))
        return let(left(state["r"]), lambda x: F.struct(x.alias("l"), right(x).alias("r")))

    return F.aggregate(_rounds(back), start, one, lambda s: s["l"] * b + s["r"])


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it: inside lambdas nothing else sees to that."""
    return F.element_at(F.transform(F.array(value), use), 1)


def walked(start: Column, step, holds) -> Column:
    """The first value after ``start`` on its cycle for which ``holds``: a bijection of the values for which it holds."""
    state = F.struct(start.alias("x"), F.lit(False).alias("done"))

    def one(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(let(step(s["x"]), lambda y: F.struct(y.alias("x"), holds(y).alias("done"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), state, one, lambda s: s["x"])


def _digit_sum(digits: Column, doubled: int) -> Column:
    """Sum of a digit string as check digits count it; digits at an even distance + ``doubled`` from the end count twice."""
    return F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda d, i: F.when(
                (i + doubled) % 2 == 1, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)
            ).otherwise(d.cast("int")),
        ),
        F.lit(0),
        lambda s, d: s + d,
    )


def _in_shape(value: Column, signs: Column, kind: str = "[0-9]") -> Column:
    """``value`` with its characters of a kind replaced, one by one, by ``signs``; the rest keeps its place."""
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(
        F.split(value, ""),
        state,
        lambda s, c: F.struct(
            F.concat(s["out"], F.when(c.rlike(f"^{kind}$"), F.substr(signs, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            (s["at"] + F.when(c.rlike(f"^{kind}$"), 1).otherwise(0)).alias("at"),
        ),
        lambda s: s["out"],
    )


def _luhn(value: Column) -> Column:
    return _digit_sum(F.regexp_replace(value, r"\D", ""), 0) % 10 == 0


def _card(value: Column, key: str, back: bool) -> Column:
    digits = F.regexp_replace(value, r"\D", "")
    body = permuted_string(F.substr(digits, F.lit(1), F.length(digits) - 1), "card", key, back=back)
    whole = let(body, lambda b: F.concat(b, F.pmod(10 - _digit_sum(b, 1) % 10, F.lit(10)).cast("string")))
    return F.when(_luhn(value), _in_shape(value, whole)).otherwise(value)


def _date(value: Column, key: str, back: bool) -> Column:
    iso, named = value.rlike(r"^\d{4}"), value.rlike("[A-Z]")
    parts = F.split(value, r"[\-./]")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    slashed = value.contains("/")
    # try_cast: parts of the other shapes are not numbers.
    month_first = F.when(slashed, first.try_cast("int") <= 12).otherwise(second.try_cast("int") > 12)
    # Only a day above 12 tells these from the other order, so their pseudonyms need one too.
    late = ~iso & ~named & (month_first != slashed)
    names = F.array(*[F.lit(m) for m in MONTHS])
    word = F.regexp_extract(value, "[A-Z][a-z]+", 0)
    number = F.array_position(F.transform(names, lambda m: F.substr(m, F.lit(1), F.lit(3))), F.substr(word, F.lit(1), F.lit(3)))
    year = F.regexp_extract(value, r"\d{4}", 0)
    month = F.when(iso, second).when(named, number.cast("string")).when(month_first, first).otherwise(second)
    in_name = F.regexp_extract(value, r"(?<!\d)\d{1,2}(?!\d)", 0)
    day = F.when(iso, F.get(parts, F.lit(2))).when(named, in_name).when(month_first, second).otherwise(first)
    written = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    start = F.lit(FIRST_DAY).cast("date")
    count = F.datediff(F.try_to_date(written, "yyyy-MM-dd"), start)
    shape = F.struct(
        count.alias("count"), late.alias("late"), iso.alias("iso"), named.alias("named"), month_first.alias("month_first"),
        word.alias("word"),
    )

    def moved_by(x: Column) -> Column:
        moved = walked(
            x["count"].cast("long"),
            lambda n: permuted_number(n, 189, 773, "date", key, back),
            lambda n: ~x["late"] | (F.day(F.date_add(start, n.cast("int"))) > 12),
        )
        written = let(F.date_add(start, moved.cast("int")), lambda d: _written_date(value, d, x))
        return F.when(x["count"].between(0, CYCLE_DAYS - 1), written).otherwise(value)

    return let(shape, moved_by)


def _written_date(value: Column, moved: Column, shape: Column) -> Column:
    """A date as ``value`` writes its own."""
    month_first, word = shape["month_first"], shape["word"]
    names = F.array(*[F.lit(m) for m in MONTHS])
    separator = F.regexp_extract(value, r"[\-./]", 0)
    short = value.rlike(r"(?:^|[\-./])\d[\-./]")
    d, m = F.day(moved).cast("string"), F.month(moved).cast("string")
    d, m = (F.when(short, x).otherwise(F.lpad(x, 2, "0")) for x in (d, m))
    numeric = F.concat_ws("", F.when(month_first, m).otherwise(d), separator, F.when(month_first, d).otherwise(m))
    numeric = F.concat(numeric, separator, F.date_format(moved, "yyyy"))
    name = F.element_at(names, F.month(moved))
    name = F.when((F.length(word) <= 4) & ~word.isin("May", "June", "July"), F.substr(name, F.lit(1), F.lit(3))).otherwise(name)
    at = F.day(moved)
    suffix = F.when((at % 10 == 1) & (at != 11), "st").when((at % 10 == 2) & (at != 12), "nd")
    suffix = suffix.when((at % 10 == 3) & (at != 13), "rd").otherwise("th")
    text = F.regexp_replace(value, F.lit(r"(?<!\d)\d{1,2}(?!\d)"), at.cast("string"))
    text = F.regexp_replace(text, F.lit(r"(?<=\d)(?:st|nd|rd|th)"), suffix)
    text = F.regexp_replace(text, F.lit("[A-Z][a-z]+"), name)
    text = F.regexp_replace(text, F.lit(r"\d{4}"), F.date_format(moved, "yyyy"))
    new = F.when(shape["iso"], _in_shape(value, F.date_format(moved, "yyyyMMdd")))
    return new.when(shape["named"], text).otherwise(numeric)


def _ip(value: Column, key: str, back: bool) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    moved = permuted_number(number, 65536, 65536, "ip", key, back)
    dotted = let(moved, lambda x: F.concat_ws(".", *[F.pmod(F.floor(x / 256**k), F.lit(256)).cast("string") for k in (3, 2, 1, 0)]))
    return F.when(F.forall(parts, lambda x: x.between(0, 255)), dotted).otherwise(value)


def _plan_code(code: Column) -> Column:
    """Of three digits (size, number, kind): how many codes are like them in the plan, their number among those, their kind.

    Area and exchange codes begin with 2 to 9 and don't end in 11; those with 11, and those with 0 or 1 in front, are no
    such codes and are counted apart.
    """
    n = code.cast("long") - 200
    hundred, rest = F.floor(n / 100), F.pmod(n, F.lit(100))
    kind = F.when(n < 0, 0).when(rest == 11, 1).otherwise(2)
    number = F.when(kind == 0, n + 200).when(kind == 1, hundred).otherwise(hundred * 99 + rest - (rest > 11).cast("long"))
    size = F.when(kind == 0, 200).when(kind == 1, 8).otherwise(792)
    return F.struct(size.cast("long").alias("size"), number.cast("long").alias("number"), kind.alias("kind"))


def _code_of(number: Column, kind: Column) -> Column:
    hundred, rest = F.floor(number / 99), F.pmod(number, F.lit(99))
    code = F.when(kind == 0, number).when(kind == 1, 211 + 100 * number)
    return F.lpad(code.otherwise(200 + hundred * 100 + rest + (rest >= 11).cast("long")).cast("string"), 3, "0")


def _plan_number(ten: Column, key: str, back: bool) -> Column:
    """Ten digits of the North American plan: another number with codes of the same kinds."""

    def moved(x: Column) -> Column:
        area, exchange = x["area"], x["exchange"]
        number = (area["number"] * exchange["size"] + exchange["number"]) * 10_000 + F.substring(ten, 7, 4).cast("long")
        return let(permuted_number(number, area["size"] * 100, exchange["size"] * 100, "phone", key, back), lambda n: written(x, n))

    def written(x: Column, n: Column) -> Column:
        codes = F.floor(n / 10_000)
        return F.concat(
            _code_of(F.floor(codes / x["exchange"]["size"]), x["area"]["kind"]),
            _code_of(F.pmod(codes, x["exchange"]["size"]), x["exchange"]["kind"]),
            F.lpad(F.pmod(n, F.lit(10_000)).cast("string"), 4, "0"),
        )

    codes = F.struct(_plan_code(F.substring(ten, 1, 3)).alias("area"), _plan_code(F.substring(ten, 4, 3)).alias("exchange"))
    return let(codes, moved)


def _phone(value: Column, key: str, back: bool) -> Column:
    digits = F.regexp_replace(value, r"\D", "")
    abroad = F.startswith(value, F.lit("+"))
    in_plan = F.when(abroad, F.startswith(digits, F.lit("1")) & (F.length(digits) == 11)).otherwise(F.length(digits) == 10)
    country = F.when(in_plan & ~abroad, 0).when(in_plan, 1).otherwise(F.length(F.regexp_extract(digits, COUNTRY_CODE, 0)) + 1)
    kept, own = F.substr(digits, F.lit(1), country), F.substr(digits, country + 1, F.length(digits))
    new = F.when(in_plan, _plan_number(own, key, back)).otherwise(permuted_string(own, "phone", key, back=back))
    return _in_shape(value, F.concat(kept, new))


def _ipv6(value: Column, key: str, back: bool) -> Column:
    return permuted_string(value, "ipv6", key, hex_only=True, back=back)


def _remainder(signs: Column) -> Column:
    """Of a number with letters from A = 10, modulo 97."""
    return F.aggregate(
        F.split(signs, ""),
        F.lit(0),
        lambda s, c: F.when(c.rlike("^[0-9]$"), s * 10 + F.ascii(c) - 48).otherwise(s * 100 + F.ascii(c) - 55) % 97,
    )


def _iban_holds(value: Column) -> Column:
    signs = F.replace(value, F.lit(" "))
    whole = _remainder(F.concat(F.substr(signs, F.lit(5), F.length(signs)), F.substr(signs, F.lit(1), F.lit(4))))
    return (whole == 1) & F.substr(signs, F.lit(3), F.lit(2)).between("02", "98")


def _iban(value: Column, key: str, back: bool) -> Column:
    signs = F.replace(value, F.lit(" "))
    country = F.substr(signs, F.lit(1), F.lit(2))
    body = permuted_string(F.substr(signs, F.lit(5), F.length(signs)), "iban", key, back=back)

    def whole(b: Column) -> Column:
        check = F.lpad((98 - _remainder(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(country, check, b)

    return F.when(_iban_holds(value), _in_shape(value, let(body, whole), "[A-Z0-9]")).otherwise(value)


def _ssn(value: Column, key: str, back: bool) -> Column:
    """Areas 001 to 899 without 666, groups from 01, serial numbers from 0001."""
    plausible = ~value.rlike(r"^(?:000|666|9)|-00-|-0000$")
    area = F.substring(value, 1, 3).cast("long")
    area = area - 1 - (area > 666).cast("long")
    group, serial = F.substring(value, 5, 2).cast("long") - 1, F.substring(value, 8, 4).cast("long") - 1
    moved = permuted_number((area * 99 + group) * 9999 + serial, 898 * 99, 9999, "ssn", key, back)

    def written(n: Column) -> Column:
        pair, serial = F.floor(n / 9999), F.pmod(n, F.lit(9999)) + 1
        area, group = F.floor(pair / 99) + 1, F.pmod(pair, F.lit(99)) + 1
        area = area + (area >= 666).cast("long")
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in ((area, 3), (group, 2), (serial, 4))])

    return F.when(plausible, let(moved, written)).otherwise(value)


def _email(value: Column, key: str, back: bool) -> Column:
    """The part before @ and the first label of the domain are permuted together; the rest of the domain stays."""
    mailbox = F.regexp_extract(value, r"^([^@]+@[^.]+)", 1)
    return F.concat(permuted_string(mailbox, "email", key, back=back), F.substr(value, F.length(mailbox) + 1, F.length(value)))


def _secret(value: Column, key: str, back: bool) -> Column:
    """Behind the character that ends its assignment a value is a card or an account number if its check digits hold."""
    cloud = permuted_string(F.substr(value, F.lit(5), F.lit(16)), "secret", key, back=back)
    own = F.substr(value, F.lit(2), F.length(value))

    def card(x: Column) -> Column:
        return x.rlike(r"^\d{13,19}$") & _luhn(x)

    def account(x: Column) -> Column:
        return x.rlike(r"^[A-Z]{2}\d\d[A-Z0-9]{11,30}$") & _iban_holds(x)

    def shape(x: Column) -> Column:
        return x.rlike("^[0-9A-Fa-f]+$")

    def step(x: Column) -> Column:
        return permuted_string(x, "secret", key, hex_only=shape(own), back=back)

    other = walked(own, step, lambda x: ~card(x) & ~account(x) & (shape(x) == shape(own)))
    new = F.when(card(own), _card(own, key, back)).when(account(own), _iban(own, key, back)).otherwise(other)
    cloud = F.concat(F.lit("AKIA"), cloud)
    return F.when(F.startswith(value, F.lit("AKIA")), cloud).otherwise(F.concat(F.substr(value, F.lit(1), F.lit(1)), new))


def kind_of(value: Column) -> Column:
    """The kind of a found value, told by its shape alone."""
    return (
        F.when(value.rlike("^AKIA[A-Z0-9]{16}$|^[=: \t\"']"), "secret")
        .when(F.instr(value, "@") > 0, "email")
        .when(value.rlike(r"^\d{4}([\-./])\d\d\1\d\d$|^\d{1,2}([\-./])\d{1,2}\2\d{4}$|[A-Z][a-z]{2}"), "date")
        .when(value.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(F.instr(value, ":") > 0, "ipv6")
        .when(value.rlike(r"^[A-Z]{2}\d\d"), "iban")
        .when(value.rlike(r"^\d{3}-\d\d-\d{4}$"), "ssn")
        .when(value.rlike(r"^(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5})$"), "card")
        .otherwise("phone")
    )


def pseudonym(value: Column, key: str | None = None, back: bool = False) -> Column:
    """The pseudonym of a found value; with ``back``, the value of a pseudonym."""
    made_by = {"secret": _secret, "date": _date, "ip": _ip, "ipv6": _ipv6, "iban": _iban, "ssn": _ssn, "card": _card}

    def of_kind(kind: Column) -> Column:
        out = F.when(kind == "email", _email(value, key, back))
        for name, made in made_by.items():
            out = out.when(kind == name, made(value, key, back))
        return out.otherwise(_phone(value, key, back))

    return let(kind_of(value), of_kind)


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str | None = None) -> DataFrame:
    """``docs`` with ``text_col`` rewritten, and ``found``: the number of replaced values."""
    hidden = docs.sparkSession.conf.get(REDACTION, None)
    if not hidden or ROUND_KEY not in hidden:
        docs.sparkSession.conf.set(REDACTION, f"{hidden}|{ROUND_KEY}" if hidden else ROUND_KEY)
    text = F.col(text_col)
    values = F.when(text.rlike(MAY_HOLD), F.regexp_extract_all(text, F.lit(_pattern()), F.lit(0)))
    columns = own_columns(docs, "found")
    old, new = free_names(docs, "old", "new")
    cut = docs.select(*columns, values.alias(old))
    made = cut.withColumn(new, F.when(F.size(old) > 0, F.transform(old, lambda m: pseudonym(m, key))))
    between = F.split(text, _pattern(), -1)
    woven = F.array_join(F.flatten(F.zip_with(between, new, lambda t, n: F.array(t, n))), "")
    differ = F.filter(F.zip_with(old, new, lambda o, n: o != n), lambda x: x)
    found = F.when(F.col(new).isNull(), 0).otherwise(F.coalesce(F.size(differ), F.lit(0)))
    rewritten = F.when(F.col(new).isNull(), text).otherwise(woven).alias(text_col)
    return made.select(*[rewritten if c == text_col else c for c in columns], found.alias("found"))


def pseudonymised_documents(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with rewritten texts under their own columns; n_chars, where there is one, follows the text."""
    (kept,) = free_names(docs, "kept")
    has_found = len(own_columns(docs, "found")) < len(docs.columns)
    own = docs.withColumnRenamed("found", kept) if has_found else docs
    done = pseudonymise(own, key=key).drop("found")
    done = done.withColumnRenamed(kept, next(c for c in docs.columns if c.lower() == "found")) if has_found else done
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


_OWN_KEY = secrets.token_hex(32)


def key_of(spark: SparkSession) -> str:
    """The key that the session sets. Where it sets none, one that this process made and nothing keeps: values are linked
    within the run, and nobody can turn them back."""
    return spark.conf.get(KEY_SETTING, None) or _OWN_KEY


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), key=key_of(spark))
