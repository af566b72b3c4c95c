"""Format-preserving pseudonyms for personal data, with column functions only.

Numbers, dates and addresses that pass the checks of their kind are permuted by a keyed Feistel
network within their own format, so the pseudonym passes the same checks, and equal values get
equal pseudonyms in every document.  Whoever has the key can invert the permutation.

* A number below ``a * b`` is a pair (left, right); rounds add, in turn, a keyed hash of one
  half to the other, modulo its size.  Dates move within their century, NANP phone numbers,
  social security numbers and IPv4 addresses within all valid ones.
* A string is cut in two halves; rounds shift each letter or digit of one half within its class
  by a keyed hash of the other half.  Card numbers keep their first digit and get a new check digit, bank
  account numbers (IBAN) their country and new check digits, mail addresses their domain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
WALK = 64  # steps; fewer than one date in 10**25 needs more

# fixed values: what each kind looks like
# the bounds are those of a valid address, so that a hostile text costs neither stack nor time; local parts may hold Latin letters beyond ASCII
EMAIL = r"[0-9A-Za-z\u00C0-\u024F][0-9A-Za-z\u00C0-\u024F._%+-]{0,63}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,126}\.[A-Za-z]{2,63}"
SECRET = (
    r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])|gh[opsu]_[0-9A-Za-z]{20,64}(?![0-9A-Za-z])"
    r"|sk[-_](?:live|test)[-_][0-9A-Za-z]{16,64}(?![0-9A-Za-z])|(?i:password|passwd|secret|token)\s?[=:]\s?[0-9A-Za-z]{8,}"
)
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
# the digits of a date or of a phone number that follow a card are not the card's
CARD = r"\d(?:[ -]?\d){12,18}(?![0-9A-Za-z]|/\d|[-.]\d{2}[-.]\d|[ .-]\d{3}[ .-]\d{4}(?!\d))"
PHONE = r"(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?![0-9A-Za-z])"
ABROAD = r"\+[2-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?![0-9A-Za-z])"
SSN = r"\d{3}-\d{2}-\d{4}(?![0-9A-Za-z-])"
IPV4 = r"(?:\d{1,3}\.){3}\d{1,3}(?![0-9A-Za-z]|\.\d)"
DATE = r"\d{4}([-/.])\d{2}\1\d{2}(?![0-9A-Za-z])|\d{2}([-/.])\d{2}\2\d{4}(?![0-9A-Za-z])"

KINDS = ("email", "secret", "iban", "phone", "abroad", "ssn", "ipv4", "date", "card")
_PATTERNS = (EMAIL, SECRET, IBAN, PHONE, ABROAD, SSN, IPV4, DATE.replace(r"\1", "[-/.]").replace(r"\2", "[-/.]"), CARD)
#: no kind starts within a word; these do not start after such characters either
_NOT_AFTER = {"email": r"(?<![\u00C0-\u024F])", "phone": r"(?<!\+)(?<!\d[.-])", "abroad": r"(?<!\+)", "ssn": r"(?<!\d-)", "ipv4": r"(?<!\d\.)"}
_STARTED = [f"{_NOT_AFTER.get(kind, '')}(?:{pattern})" for kind, pattern in zip(KINDS, _PATTERNS)]
ANY = r"(?<![0-9A-Za-z])(?:" + "|".join(_STARTED) + ")"
#: what is looked for again beside or instead of a bank account number
INNER = r"(?<![0-9A-Za-z])(?:" + "|".join(p for kind, p in zip(KINDS, _STARTED) if kind != "iban") + ")"


def _hash(key: str, part: Column, step: Column, size: int) -> Column:
    return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), step, part).cast("binary"), 256), 1, 15), 16, 10).cast("long"), F.lit(size))


def permuted_number(value: Column, a: int, b: int, key: str) -> Column:
    """A keyed permutation of the numbers from 0 below ``a * b``."""
    start = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, F.lit(b)).cast("long").alias("r"))

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        left = F.when(even, (acc["l"] + _hash(key, acc["r"].cast("string"), i, a)) % a).otherwise(acc["l"])
        right = F.when(even, acc["r"]).otherwise((acc["r"] + _hash(key, acc["l"].cast("string"), i, b)) % b)
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: acc["l"] * b + acc["r"])


def _shifted(half: Column, other: Column, step: Column, key: str, hexadecimal: bool) -> Column:
    """Each letter and digit of ``half`` moved on within its class by a hash of ``other`` and its place."""

    def moved(c: Column, i: Column) -> Column:
        # 15 hex digits per place, drawn in blocks of four places from one digest
        block = F.sha2(F.concat_ws("|", F.lit(key), step, F.floor(i / 4), other).cast("binary"), 256)
        by = F.conv(F.substr(block, (i % 4) * 15 + 1, F.lit(15)), 16, 10).cast("long")
        code = F.ascii(c)
        turn = lambda first, size: F.char((code - ord(first) + by) % size + ord(first))
        hexed = F.substr(F.lit("0123456789abcdef"), (F.instr(F.lit("0123456789abcdef"), c) - 1 + by) % 16 + 1, F.lit(1))
        if hexadecimal:
            return F.when(c.rlike("^[0-9a-f]$"), hexed).otherwise(c)
        return (
            F.when(c.rlike("^[0-9]$"), turn("0", 10)).when(c.rlike("^[a-z]$"), turn("a", 26)).when(c.rlike("^[A-Z]$"), turn("A", 26)).otherwise(c)
        )

    return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), moved), "")


def permuted_text(value: Column, key: str, hexadecimal: bool = False) -> Column:
    """A keyed permutation of strings that keeps the length and the class of every character."""
    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), cut).alias("l"), F.substr(value, cut + 1, F.length(value)).alias("r"))

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        left = F.when(even, _shifted(acc["l"], acc["r"], i, key, hexadecimal)).otherwise(acc["l"])
        right = F.when(even, acc["r"]).otherwise(_shifted(acc["r"], acc["l"], i, key, hexadecimal))
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _in_places(value: Column, filling: Column, place: str = "[0-9]") -> Column:
    """``value`` with the characters of class ``place`` replaced, in order, by those of ``filling``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        takes = c.rlike(f"^{place}$")
        return F.struct(
            F.concat(acc["out"], F.when(takes, F.substr(filling, acc["at"], F.lit(1))).otherwise(c)).alias("out"),
            (acc["at"] + takes.cast("int")).alias("at"),
        )

    return F.aggregate(F.filter(F.split(value, ""), lambda c: c != ""), start, step, lambda acc: acc["out"])


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    numbers = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10


def _mod97(account: Column) -> Column:
    """A bank account number's digits, letters counted from 10, modulo 97, first four characters last."""
    turned = F.concat(F.substr(account, F.lit(5), F.length(account)), F.substr(account, F.lit(1), F.lit(4)))
    letters = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.aggregate(
        letters,
        F.lit(0),
        lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _is_card(value: Column) -> Column:
    digits = _digits(value)
    return F.length(digits).between(13, 19) & (_luhn(digits) == 0)


def _is_iban(value: Column) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    return F.length(plain).between(15, 34) & (_mod97(plain) == 1)


def _card(value: Column, key: str) -> Column:
    digits = _digits(value)
    body = F.substr(digits, F.lit(2), F.length(digits) - 2)
    fresh = F.concat(F.substr(digits, F.lit(1), F.lit(1)), permuted_text(body, key))
    check = (10 - _luhn(F.concat(fresh, F.lit("0")))) % 10
    return F.when(_is_card(value), _in_places(value, F.concat(fresh, check.cast("string"))))


def _iban(value: Column, key: str) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    fresh = permuted_text(F.substr(plain, F.lit(5), F.length(plain)), key)
    zero = F.concat(F.substr(plain, F.lit(1), F.lit(2)), F.lit("00"), fresh)
    made = F.concat(F.substr(plain, F.lit(1), F.lit(2)), _padded(98 - _mod97(zero), 2), fresh)
    return F.when(_is_iban(value), _in_places(value, made, "[0-9A-Z]"))


def _phone(value: Column, key: str) -> Column:
    """Area code and exchange from 200 to 999, line from 0000 to 9999; the country code stays."""
    digits = F.right(_digits(value), F.lit(10))
    part = lambda at, n: F.substr(digits, F.lit(at), F.lit(n)).cast("long")
    number = (part(1, 3) - 200) * 8_000_000 + (part(4, 3) - 200) * 10_000 + part(7, 4)
    fresh = permuted_number(number, 80_000, 80_000, key)
    made = F.concat(
        F.substr(_digits(value), F.lit(1), F.length(_digits(value)) - 10),
        (F.floor(fresh / 8_000_000) + 200).cast("string"),
        (F.floor(fresh % 8_000_000 / 10_000) + 200).cast("string"),
        _padded(fresh % 10_000, 4),
    )
    return _in_places(value, made)


def _abroad(value: Column, key: str) -> Column:
    """The country code up to the first separator, or its first two digits, stays."""
    head = F.regexp_extract(value, r"^(\+\d{1,3}(?=[ .-])|\+\d\d)", 1)
    rest = F.substr(value, F.length(head) + 1, F.length(value))
    return F.when(F.length(_digits(value)).between(8, 15), F.concat(head, permuted_text(rest, key)))


def _ssn(value: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.split_part(value, F.lit("-"), F.lit(i)).cast("long") for i in (1, 2, 3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    number = ((F.when(area > 666, area - 2).otherwise(area - 1)) * 99 + group - 1) * 9999 + serial - 1
    fresh = permuted_number(number, 898 * 99, 9999, key)
    row = F.floor(fresh / (99 * 9999))
    made = F.concat_ws(
        "-", _padded(F.when(row >= 665, row + 2).otherwise(row + 1), 3), _padded(F.floor(fresh / 9999) % 99 + 1, 2), _padded(fresh % 9999 + 1, 4)
    )
    return F.when(valid, made)


def _ipv4(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda a, o: a * 256 + o)
    fresh = permuted_number(number, 65_536, 65_536, key)
    made = F.concat_ws(".", *[(F.floor(fresh / 256**i) % 256).cast("string") for i in (3, 2, 1, 0)])
    return F.when(~F.exists(octets, lambda o: o > 255), made)


def _date(value: Column, key: str) -> Column:
    """Days of the same century; year first, or day and month first (day first unless only month first is a date)."""
    mark = F.regexp_extract(value, "([-/.])", 1)
    parts = F.split(value, "[-/.]")
    first, second, third = (parts[i] for i in range(3))
    year_first = F.length(first) == 4
    as_date = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd")
    ymd, dmy, mdy = as_date(first, second, third), as_date(third, second, first), as_date(third, first, second)
    day = F.when(year_first, ymd).otherwise(F.coalesce(dmy, mdy))
    century = F.floor(F.year(day) / 100) * 100
    begin = F.make_date(century.cast("int"), F.lit(1), F.lit(1))
    span = F.datediff(F.make_date((century + 100).cast("int"), F.lit(1), F.lit(1)), begin)
    at = F.datediff(day, begin).cast("long")
    def move(place: Column) -> Column:
        # a century has 36,525 days = 75 * 487, or 36,524 = 92 * 397
        return F.when(span == 36_525, permuted_number(place, 75, 487, key)).otherwise(permuted_number(place, 92, 397, key))

    # a date that only reads month first walks on to the next such date, so that no two dates meet in one text
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        move(at),
        lambda acc, _: F.when(F.dayofmonth(F.date_add(begin, acc.cast("int"))) > 12, acc).otherwise(move(acc)),
    )
    moved = F.when(year_first | dmy.isNotNull(), move(at)).otherwise(walked)
    fresh = F.date_add(begin, moved.cast("int"))
    y, m, d = F.date_format(fresh, "yyyy"), F.date_format(fresh, "MM"), F.date_format(fresh, "dd")
    made = F.when(year_first, F.concat(y, mark, m, mark, d)).when(dmy.isNotNull(), F.concat(d, mark, m, mark, y)).otherwise(F.concat(m, mark, d, mark, y))
    return F.when(day.isNotNull() & (F.year(day) >= 100), made)


def _email(value: Column, key: str) -> Column:
    return F.concat(permuted_text(F.split_part(value, F.lit("@"), F.lit(1)), key), F.lit("@"), F.split_part(value, F.lit("@"), F.lit(2)))


def _secret(value: Column, key: str) -> Column:
    head = F.regexp_extract(value, r"^(AKIA|gh[opsu]_|sk[-_](?:live|test)[-_]|[A-Za-z]+\s?[=:]\s?)", 1)
    rest = F.substr(value, F.length(head) + 1, F.length(value))
    return F.concat(head, F.when(rest.rlike("^[0-9a-f]+$"), permuted_text(rest, key, True)).otherwise(permuted_text(rest, key)))


_MAKERS: dict[str, Callable[[Column, str], Column]] = {
    "email": _email, "secret": _secret, "iban": _iban, "phone": _phone, "abroad": _abroad, "ssn": _ssn, "ipv4": _ipv4, "date": _date, "card": _card,
}


def _kind(value: Column) -> Column:
    out = F.when(value.rlike(f"^(?:{_PATTERNS[0]})$"), KINDS[0])
    for kind, pattern in zip(KINDS[1:], _PATTERNS[1:]):
        out = out.when(value.rlike(f"^(?:{pattern})$"), kind)
    return out


def _pieces(value: Column) -> Column:
    """What was found, cut into pieces: a span with a check that also holds other words or digits gives the valid part of its own.

    The part starts and ends at a blank or hyphen; the first and then the longest one is taken.
    """
    at = F.sequence(F.lit(1), F.length(value))
    joint = lambda i: F.substr(value, i, F.lit(1)).rlike("^[ -]?$")
    part = lambda p: F.substr(value, p["start"], p["size"])
    ends = F.filter(at, lambda i: joint(i + 1))
    starts = F.filter(at, lambda i: (i == 1) | joint(i - 1))
    places = F.flatten(
        F.transform(
            starts, lambda i: F.transform(F.filter(F.reverse(ends), lambda e: e - i >= 12), lambda e: F.struct(i.alias("start"), (e - i + 1).alias("size")))
        )
    )
    valid = F.filter(
        places,
        lambda p: F.when(part(p).rlike(f"^(?:{IBAN})$"), _is_iban(part(p))).when(part(p).rlike(f"^(?:{CARD})$"), _is_card(part(p))).otherwise(F.lit(False)),
    )
    inner = lambda text: F.flatten(
        F.zip_with(F.split(text, INNER, -1), F.concat(F.regexp_extract_all(text, F.lit(INNER), F.lit(0)), F.array(F.lit(""))), lambda a, b: F.array(a, b))
    )

    def cut(p: Column) -> Column:
        before, after = F.substr(value, F.lit(1), p["start"] - 1), F.substr(value, p["start"] + p["size"], F.length(value))
        return F.concat(inner(before), F.array(part(p)), inner(after))

    chosen = F.flatten(F.transform(F.slice(valid, 1, 1), cut))
    split = F.when(F.size(chosen) > 0, chosen).otherwise(inner(value))
    checked = value.rlike(f"^(?:{IBAN})$") & ~_is_iban(value) | value.rlike(f"^(?:{CARD})$") & ~_is_card(value)
    return F.when(checked, split).otherwise(F.array(value))


def _pseudonym(kind: Column, value: Column, key: str) -> Column:
    """The value's pseudonym, or NULL when it fails the checks of its kind."""
    out = None
    for name in KINDS:
        made = _MAKERS[name](value, f"{key}|{name}")
        out = F.when(kind == name, made) if out is None else out.when(kind == name, made)
    return out


def pseudonymize(docs: DataFrame, key: str = "paperloom", text: str = "text") -> DataFrame:
    """(_row, found): every row with personal data in ``text`` replaced, and what was replaced.

    ``found`` lists (kind, old, new) in order of place; values that look like a kind but fail its
    checks stay, as do all characters around.  ``_row`` has the input's columns under their
    names.  NULL and empty texts stay; texts of any length are read whole; repeated rows give
    repeated rows.
    """
    # numbered names: no name of the input can meet one from here
    rows = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    body = f"_c{docs.columns.index(text)}"
    seen = F.regexp_extract_all(body, F.lit(ANY), F.lit(0))
    # the generators keep a list from being made anew at each of its uses
    listed = rows.select("*", F.explode(F.array(F.coalesce(seen, F.array().cast("array<string>")))).alias("_seen"))
    cut = listed.select(*rows.columns, F.explode(F.array(F.transform("_seen", _pieces))).alias("_seen"))
    kinds = F.transform("_seen", lambda span: F.transform(span, lambda value: F.struct(_kind(value).alias("kind"), value.alias("old"))))
    sorted_out = cut.select(*rows.columns, F.explode(F.array(kinds)).alias("_kinds"))
    renamed = lambda k: F.struct(k["kind"].alias("kind"), k["old"].alias("old"), _pseudonym(k["kind"], k["old"], key).alias("new"))
    made = F.transform("_kinds", lambda span: F.transform(span, renamed))
    done = sorted_out.select(*rows.columns, F.explode(F.array(made)).alias("_made"))
    new = F.transform("_made", lambda span: F.array_join(F.transform(span, lambda m: F.coalesce(m["new"], m["old"])), ""))
    new = F.concat(new, F.array(F.lit("")))
    joined = F.array_join(F.zip_with(F.split(body, ANY, -1), new, lambda a, b: F.concat(a, b)), "")
    out = F.when(F.size("_made") > 0, joined).otherwise(F.col(body))
    row = F.struct(*[(out if c == body else F.col(c)).alias(name) for c, name in zip(rows.columns, docs.columns)])
    return done.select(row.alias("_row"), F.filter(F.flatten("_made"), lambda m: m["new"].isNotNull()).alias("found"))
