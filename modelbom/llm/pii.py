"""Format-preserving pseudonyms for personal data: validated values are permuted within their format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelbom.llm.common import settled

ROUNDS = 8

#: Alphabets of the character classes that a pseudonym keeps, place by place.
ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
)


def _letters(first: int, last: int) -> tuple[str, ...]:
    """The lower-case, the upper-case and the other letters of a range, as alphabets of their own."""
    all_ = [chr(c) for c in range(first, last + 1) if chr(c).isalpha() and len(chr(c).upper()) == len(chr(c).lower()) == 1]
    kinds = ([c for c in all_ if c.islower()], [c for c in all_ if c.isupper()], [c for c in all_ if not c.islower() and not c.isupper()])
    return tuple("".join(k) for k in kinds if len(k) > 1)


#: Letters of other alphabets: Latin Extended-A, Greek, Cyrillic, Armenian, Hebrew, Arabic, Devanagari, Thai, Georgian, kana.
_RANGES = (
    (0x100, 0x17F), (0x370, 0x3FF), (0x400, 0x4FF), (0x531, 0x586), (0x5D0, 0x5EA), (0x620, 0x64A), (0x904, 0x939),
    (0xE01, 0xE30), (0x10D0, 0x10FA), (0x3041, 0x3096), (0x30A1, 0x30FA),
)
OTHER_LETTERS = tuple(a for r in _RANGES for a in _letters(*r))
HEX = "0123456789abcdef"

#: Days of the Gregorian cycle of 400 years from 1800-01-01, as 189 * 773.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)

#: Kinds in the order in which they are tried at a place. A match that fails its validation stays.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "iso_date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])",
    "day_date": r"(?<![\d./])\d{2}([./])\d{2}\1\d{4}(?![\d/]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    # A run of digit groups, up to a group that begins another kind; ``_cards`` finds the numbers in it.
    "card": r"(?<![\d-])(?=\d(?:[ -]?\d){12})\d{1,19}+(?!\d|-(?!\d))(?:[ -](?!\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)|\d{4}-\d{2}-\d{2}(?![\d-])"
    r"|\d{2}(?:\.\d{2}\.|/\d{2}/)\d{4}(?![\d/]|\.\d)|\d{3}-\d{2}-\d{4}(?![\d-]))\d{1,19}+(?!\d|-(?!\d)))*+",
    "phone": r"(?<![\d+])\+\d{1,3}(?:[ .-]?\(\d{2,4}\)|[ .-]\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?!\d)",
    "token": r"(?<![0-9A-Za-z])(?:[0-9a-f]{40}|[0-9A-F]{40}|[0-9a-f]{32}|[0-9A-F]{32}|[0-9a-f]{64})(?![0-9A-Za-z])",
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chars(text: Column) -> Column:
    return F.split(text, "")


def _byte(stream: Column, i: Column) -> Column:
    """Byte i (modulo 32) of a hex text of 32 bytes."""
    at = 2 * F.pmod(i, F.lit(32))
    return F.conv(F.substr(stream, (at + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _shift(part: Column, stream: Column, alphabets) -> Column:
    """Every character moved on within its alphabet by a byte of the stream; others stay."""

    def one(c, i):
        out = c
        for a in alphabets:
            place = F.position(c, F.lit(a))
            moved = F.substr(F.lit(a), F.pmod(place - 1 + _byte(stream, i), F.lit(len(a))) + 1, F.lit(1))
            out = F.when(place > 0, moved).otherwise(out)
        return out

    return F.transform(part, one)


def permute(value: Column, key: str, kind: str, alphabets=ALPHABETS) -> Column:
    """Keyed permutation of the texts of one format: a Feistel network over the two halves.

    Each round moves every character of one half on within its alphabet by bytes of SHA-256(key, kind,
    round, other half). The format (the class of each place) never changes, so it is one to one within it.
    """
    halves = let(chars(value), lambda c: F.struct(
        F.slice(c, 1, F.ceil(F.size(c) / 2).cast("int")).alias("l"),
        F.slice(c, F.ceil(F.size(c) / 2).cast("int") + 1, F.size(c)).alias("r"),
    ))

    def stream(n, other):
        return F.sha2(F.encode(F.concat(F.lit(f"{key}|{kind}|"), n.cast("string"), F.lit("|"), F.array_join(other, "")), "utf-8"), 256)

    def turn(s, n):
        left = let(stream(n, s["r"]), lambda h: F.struct(_shift(s["l"], h, alphabets).alias("l"), s["r"].alias("r")))
        right = let(stream(n, s["l"]), lambda h: F.struct(s["l"].alias("l"), _shift(s["r"], h, alphabets).alias("r")))
        return F.when(n % 2 == 0, left).otherwise(right)

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, turn, lambda s: F.concat(F.array_join(s["l"], ""), F.array_join(s["r"], ""))
    )


def permute_number(number: Column, sides: tuple[int, int], key: str, kind: str) -> Column:
    """Keyed permutation of 0 .. a * b - 1: a Feistel network on (number / b, number modulo b)."""
    a, b = sides
    start = F.struct(F.floor(number / b).cast("long").alias("l"), F.pmod(number, F.lit(b)).cast("long").alias("r"))

    def draw(n, other):
        text = F.concat(F.lit(f"{key}|{kind}|"), n.cast("string"), F.lit("|"), other.cast("string"))
        return F.conv(F.substring(F.sha2(F.encode(text, "utf-8"), 256), 1, 12), 16, 10).cast("long")

    def turn(s, n):
        return F.when(
            n % 2 == 0, F.struct(F.pmod(s["l"] + draw(n, s["r"]), F.lit(a)).alias("l"), s["r"].alias("r"))
        ).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + draw(n, s["l"]), F.lit(b)).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])


def luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a text of digits."""
    n = F.length(digits)

    def part(c, i):
        d = c.cast("int")
        return F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(chars(digits), part), F.lit(0), lambda s, x: s + x) % 10


def _fill(shape: Column, digits: Column) -> Column:
    """The text with its digits replaced by ``digits`` in order; separators stay."""
    step = lambda s, c: F.when(
        c.between("0", "9"), F.struct((s["n"] + 1).alias("n"), F.concat(s["t"], F.substr(digits, s["n"] + 1, F.lit(1))).alias("t"))
    ).otherwise(F.struct(s["n"].alias("n"), F.concat(s["t"], c).alias("t")))
    return F.aggregate(chars(shape), F.struct(F.lit(0).alias("n"), F.lit("").alias("t")), step, lambda s: s["t"])


#: The first digits of card issuers.
ISSUERS = r"^(?:4|5[0-8]|6|3[0-9]|2[2-7])"
#: Groups whose places are summed together.
_BLOCK = 256


def _card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = permute(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card", ALPHABETS[:1])
    whole = let(body, lambda b: F.concat(b, F.pmod(10 - luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
    return let(whole, lambda w: _fill(m, w))


def _cards(m: Column, key: str) -> Column:
    """(text, n): a run of digit groups with its n card numbers replaced.

    A card number begins with an issuer's digits, has a right Luhn sum and stands in a usual grouping: 13 to 19
    digits alone, groups of four (13 to 19 digits), or 4, 6 and 4 or 5. So tables of small numbers stay as they are. Of
    numbers that overlap the first counts. The work grows with the groups of the run.
    """

    def placed(groups):
        starts = F.sequence(F.lit(0), F.size(groups) - 1, F.lit(_BLOCK))
        ends = lambda b: F.least(b + _BLOCK, F.size(groups)) - 1
        blocks = F.transform(starts, lambda b: F.transform(F.sequence(b, ends(b)), lambda i: F.get(groups, i)))

        def within(parts, base):
            return F.transform(parts, lambda g, i: F.struct(
                (base + F.aggregate(F.transform(F.sequence(F.lit(0), i), lambda k: F.get(parts, k)), -F.length(g), lambda s, x: s + F.length(x)) + i).alias("s"),
                F.length(g).alias("n"), g.alias("t"),
            ))

        none = F.array().cast("array<int>")
        total = lambda parts: F.aggregate(parts, F.lit(0), lambda s, x: s + F.length(x) + 1)
        bases = F.aggregate(blocks, F.struct(F.lit(1).alias("at"), none.alias("all")), lambda o, parts: F.struct(
            (o["at"] + total(parts)).alias("at"), F.concat(o["all"], F.array(o["at"])).alias("all")
        ), lambda o: o["all"])
        return let(bases, lambda base: F.flatten(F.transform(blocks, lambda parts, b: within(parts, F.get(base, b)))))

    def candidate(at, i):
        g = [F.get(at, i + k) for k in range(5)]
        four = lambda n: (g[0]["n"] == 4) & (g[1]["n"] == 4) & (g[2]["n"] == 4) & (F.lit(True) if n == 3 else g[3]["n"] == 4)
        shapes = (
            (g[0]["n"].between(13, 19), g[0]), (four(3) & g[3]["n"].between(1, 4), g[3]), (four(4) & g[4]["n"].between(1, 3), g[4]),
            ((g[0]["n"] == 4) & (g[1]["n"] == 6) & g[2]["n"].between(4, 5), g[2]),
        )
        out = F.lit(None).cast("int")
        for shape, last in reversed(shapes):
            end = last["s"] + last["n"]
            right = luhn(F.regexp_replace(F.substr(m, g[0]["s"], end - g[0]["s"]), "[^0-9]", "")) == 0
            out = F.when(F.coalesce(shape, F.lit(False)) & right, end).otherwise(out)
        end = F.when(F.rlike(g[0]["t"], F.lit(ISSUERS)) & (g[0]["n"] >= 4), out)
        return F.when(end.isNotNull(), F.struct(g[0]["s"].alias("s"), end.alias("e")))

    def found(at):
        return F.array_compact(F.transform(F.sequence(F.lit(0), F.size(at) - 1), lambda i: candidate(at, i)))

    def taken(numbers):
        none = F.array().cast("array<struct<s:int,e:int>>")
        return F.aggregate(numbers, F.struct(F.lit(0).alias("free"), none.alias("all")), lambda o, w: F.when(
            w["s"] >= o["free"], F.struct(w["e"].alias("free"), F.concat(o["all"], F.array(w)).alias("all"))
        ).otherwise(o), lambda o: o["all"])

    def woven(cards):
        begins = lambda k: F.when(k == 0, F.lit(1)).otherwise(F.get(cards, k - 1)["e"])
        parts = F.transform(cards, lambda w, k: F.concat(
            F.substr(m, begins(k), w["s"] - begins(k)), _card(F.substr(m, w["s"], w["e"] - w["s"]), key)
        ))
        rest = F.substr(m, begins(F.size(cards)), F.length(m))
        return F.struct(F.concat(F.array_join(parts, ""), rest).alias("t"), F.size(cards).alias("n"))

    return let(let(let(let(F.split(m, "[ -]"), placed), found), taken), woven)


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, "\\."), lambda x: x.cast("int"))
    valid = F.forall(octets, lambda x: x < 256)
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    back = lambda n: F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])
    return F.when(valid, let(permute_number(number, (1 << 16, 1 << 16), key, "ip"), back)).otherwise(m)


def _date(m: Column, shape: str, key: str, otherwise: Column | None = None) -> Column:
    day = F.try_to_date(m, shape)
    number = F.datediff(day, F.to_date(F.lit(FIRST_DAY)))
    new = permute_number(number.cast("long"), DAYS, key, "date")
    moved = F.date_format(F.date_add(F.to_date(F.lit(FIRST_DAY)), new.cast("int")), shape)
    return F.when(day.isNotNull() & number.between(0, DAYS[0] * DAYS[1] - 1), moved).otherwise(m if otherwise is None else otherwise)


def _day_date(m: Column, mark: str, key: str) -> Column:
    """Day first; what is no such date but one with the month first is moved among the latter.

    These are the days after the 12th. The permutation is repeated until it meets one, which is one to
    one among them, and no pseudonym of a day-first date looks like theirs.
    """
    shape = f"MM{mark}dd{mark}yyyy"
    day = F.try_to_date(m, shape)
    first = F.to_date(F.lit(FIRST_DAY))
    number = F.datediff(day, first).cast("long")
    late = lambda n: F.dayofmonth(F.date_add(first, n.cast("int"))) > 12
    step = lambda n, i: F.when((i > 0) & late(n), n).otherwise(permute_number(n, DAYS, key, "date"))
    new = F.aggregate(F.sequence(F.lit(0), F.lit(127)), number, step)
    moved = F.date_format(F.date_add(first, new.cast("int")), shape)
    month_first = F.when(day.isNotNull() & late(number) & number.between(0, DAYS[0] * DAYS[1] - 1), moved).otherwise(m)
    return _date(m, f"dd{mark}MM{mark}yyyy", key, month_first)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = F.when(area > 666, area - 2).otherwise(area - 1)
    number = ((rank * 99 + group - 1).cast("long")) * 9999 + serial - 1

    def back(n):
        a = F.floor(n / (99 * 9999)).cast("int")
        a = F.when(a >= 665, a + 2).otherwise(a + 1)
        g, s = F.pmod(F.floor(n / 9999), F.lit(99)) + 1, F.pmod(n, F.lit(9999)) + 1
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad(g.cast("string"), 2, "0"), F.lpad(s.cast("string"), 4, "0"))

    return F.when(valid, let(permute_number(number, (898 * 99, 9999), key, "ssn"), back)).otherwise(m)


def _mod97(text: Column) -> Column:
    """The number of an upper-case alphanumeric text, letters as 10 to 35, modulo 97."""
    value = lambda c: F.position(c, F.lit(ALPHABETS[0] + ALPHABETS[2])) - 1
    return F.aggregate(chars(text), F.lit(0), lambda s, c: (F.when(value(c) < 10, s * 10).otherwise(s * 100) + value(c)) % 97)


def _iban(m: Column, key: str) -> Column:
    plain = F.regexp_replace(m, " ", "")
    head, body = F.substring(plain, 1, 4), F.substr(plain, F.lit(5), F.length(plain))
    valid = _mod97(F.concat(body, head)) == 1

    def whole(b):
        check = 98 - _mod97(F.concat(b, F.substring(plain, 1, 2), F.lit("00")))
        return F.concat(F.substring(plain, 1, 2), F.lpad(check.cast("string"), 2, "0"), b)

    def spaced(w):
        step = lambda s, c: F.when(c == " ", F.struct(s["n"].alias("n"), F.concat(s["t"], c).alias("t"))).otherwise(
            F.struct((s["n"] + 1).alias("n"), F.concat(s["t"], F.substr(w, s["n"] + 1, F.lit(1))).alias("t"))
        )
        return F.aggregate(chars(m), F.struct(F.lit(0).alias("n"), F.lit("").alias("t")), step, lambda s: s["t"])

    new = let(permute(body, key, "iban", (ALPHABETS[0], ALPHABETS[2])), whole)
    return F.when(valid, let(new, spaced)).otherwise(m)


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    # Most addresses have letters of the common alphabets only; the others are looked up in all.
    common = local.rlike("^[\\x00-\\xff]*$")
    new = F.when(common, permute(local, key, "email")).otherwise(permute(local, key, "email", ALPHABETS + OTHER_LETTERS))
    return F.concat(new, F.lit("@"), F.substring_index(m, "@", -1))


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, r"^\+\d{1,3}", 0)
    rest = F.substr(m, F.length(code) + 1, F.length(m))
    digits = F.regexp_replace(rest, "[^0-9]", "")
    return F.concat(code, let(permute(digits, key, "phone", ALPHABETS[:1]), lambda d: _fill(rest, d)))


def _token(m: Column, key: str) -> Column:
    low = permute(F.lower(m), key, "token", (HEX,))
    return F.when(m == F.upper(m), F.upper(low)).otherwise(low)


def pseudonym(match: Column, key: str) -> Column:
    """(text, n) of a match of the joined pattern: n values are valid and replaced; without one it stays."""
    made = {
        "email": _email(match, key), "iban": _iban(match, key), "ip": _ip(match, key),
        "iso_date": _date(match, "yyyy-MM-dd", key),
        "day_date": F.when(F.contains(match, F.lit("/")), _day_date(match, "/", key)).otherwise(_day_date(match, ".", key)),
        "ssn": _ssn(match, key), "phone": _phone(match, key), "token": _token(match, key),
    }
    one = lambda text: let(text, lambda t: F.struct(t.alias("t"), (t != match).cast("int").alias("n")))
    out = F.struct(match.alias("t"), F.lit(0).alias("n"))
    for kind in reversed(PATTERNS):
        whole = F.rlike(match, F.lit("^(?:" + PATTERNS[kind] + ")$"))
        out = F.when(whole, _cards(match, key) if kind == "card" else one(made[kind])).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replace personal data in every text by keyed pseudonyms of the same format.

    Card numbers (Luhn), IBANs (modulo 97), IP addresses, social security numbers and calendar dates
    are validated and permuted within the valid values of their format, so a pseudonym is valid too;
    numbers that fail stay. The local part of e-mail addresses, the digits of phone numbers after the
    country code, and hex tokens are permuted place by place. Equal values have equal pseudonyms in all
    documents under one key, and different ones different: the permutations are one to one.

    Card numbers are found among other numbers next to them (``_cards``); dates have the year first, the
    day first or, where that is no date, the month first, and lie in the years 1800 to 2199; others stay. Letters of an
    address are permuted within ``ALPHABETS`` and ``OTHER_LETTERS``; those of further scripts (such as Chinese) stay in their places.

    Returns doc_id, text, n_found (matches; of several cards in a run of digits each counts), n_replaced
    (those that passed validation). Only built-in
    expressions in one narrow projection; texts without a digit or @ are passed on after a short test.
    Null and empty texts stay as they are with counts 0; null ids, repeated rows and columns of any
    further name are no matter; an empty table gives an empty result.
    """
    pattern = "|".join(f"(?:{p})" for p in _numbered(PATTERNS.values()))
    t = F.col(f"`{text}`")
    some = F.rlike(t, F.lit("[0-9@]"))
    found = docs.select("doc_id", t.alias("text"), F.when(some, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).alias("found"))
    made = found.withColumn("made", F.when(F.size("found") > 0, F.transform("found", lambda m: pseudonym(m, key))))
    gaps = F.split(F.col("text"), pattern)
    woven = F.array_join(F.zip_with(gaps, "made", lambda g, m: F.concat(g, F.coalesce(m["t"], F.lit("")))), "")
    count = lambda n: F.coalesce(F.aggregate("made", F.lit(0), lambda s, m: s + n(m["n"])), F.lit(0)).cast("long")
    return settled(made.select(
        "doc_id", F.when(F.size("made") > 0, woven).otherwise(F.col("text")).alias("text"),
        count(lambda n: F.greatest(n, F.lit(1))).alias("n_found"), count(lambda n: n).alias("n_replaced"),
    ))


def _numbered(patterns):
    """The patterns with back references renumbered for their place in the joined pattern."""
    groups = 0
    for p in patterns:
        yield p.replace("\\1", f"\\{groups + 1}")
        groups += p.count("([")
