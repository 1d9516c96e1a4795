"""Stable fakes: canonical keys, and replacements made from a seeded hash, whatever the order of rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.functions.policy import strings
from cloakframe.functions.spans import built, let

SEED = 20251210
FIRST = ("Aarav", "Aditi", "Anaya", "Arjun", "Diya", "Farhan", "Gauri", "Hari", "Isha", "Jatin", "Kavya", "Lakshmi", "Manav", "Meera", "Nikhil", "Ojas", "Pooja", "Rahul", "Riya", "Sanjay", "Tara", "Uday", "Varun", "Yash")
TRADES = ("Foods", "Metals", "Textiles", "Power", "Logistics", "Ceramics", "Motors", "Paper", "Chemicals", "Retail", "Glass", "Marine")
ROADS = ("Lake", "Hill", "Station", "Temple", "Market", "River", "Garden", "College")
TOWNS = ("Rampur", "Devgarh", "Shantipur", "Nandgaon", "Lalpur", "Madhupur")
#: Surnames, firms and hosts are made of syllables of two letters: every consonant here with every vowel.
CONSONANTS, VOWELS = "bdghjklmnprstvyz", "aeio"

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Numbers, then a day before and after its month's name; the groups of each in the order day, month, year.
DATE_FORMS = (
    (r"^\s*(\d{1,2})[/\-. ](\d{1,2})[/\-. ](\d{2,4})\s*$", (1, 2, 3)),
    (r"(?i)^\s*(\d{1,2})\s+([a-z]{3})[a-z]*,?\s+(\d{4})\s*$", (1, 2, 3)),
    (r"(?i)^\s*([a-z]{3})[a-z]*\s+(\d{1,2}),?\s+(\d{4})\s*$", (2, 1, 3)),
)


def birth_date(value: Column) -> Column:
    """The date of a birth date's text: day first, or month first where only that is a date; two-digit years are of 1900."""

    def dated(day: Column, month: Column, year: Column) -> Column:
        number = F.coalesce(F.nullif(F.array_position(strings(MONTHS), F.lower(month)), F.lit(0)).cast("string"), month)
        full = F.when(F.length(year) == 2, F.concat(F.lit("19"), year)).otherwise(year)
        of = lambda d, m: F.try_to_timestamp(F.concat_ws(" ", full, m, d), F.lit("yyyy M d")).cast("date")
        return F.coalesce(of(day, number), of(number, day))

    def first_form(v: Column) -> Column:
        made = F.lit(None).cast("date")
        for pattern, order in reversed(DATE_FORMS):
            made = F.when(F.regexp_like(v, F.lit(pattern)), dated(*[F.regexp_extract(v, pattern, i) for i in order])).otherwise(made)
        return made

    return let(value, first_form)


def canonical(entity: Column, value: Column) -> Column:
    """The key under which variants of a value share a fake; a birth date's is the date, however it is written."""

    def of(s: Column) -> Column:
        e, v = s["e"], s["v"]
        number = F.regexp_replace(v, r"(?U)\D", "")
        words = F.trim(F.regexp_replace(F.lower(v), "[^a-z0-9]+", " "))
        other = F.lower(F.btrim(F.regexp_replace(v, "(?U)[\\s \\-–—]+", " ")))
        born = F.when(e == "DATE_OF_BIRTH", birth_date(v).cast("string"))
        return F.when(e == "PHONE", F.right(number, F.lit(10))).when(e.isin("PERSON", "ORG"), words).otherwise(F.coalesce(born, other))

    return let(F.struct(entity.alias("e"), value.alias("v")), of)


def canonical_of_span() -> Column:
    return built(("canonical",), lambda: canonical(F.col("entity_type"), F.col("text")))


def match_case(original: Column, fake: Column) -> Column:
    letters = F.regexp_replace(original, r"[^\p{L}]", "")
    return (
        F.when((letters != "") & F.regexp_like(letters, F.lit(r"^\p{Lu}+$")), F.upper(fake))
        .when((letters != "") & F.regexp_like(letters, F.lit(r"^\p{Ll}+$")), F.lower(fake))
        .otherwise(fake)
    )


def draw(h: Column, k: int, n: int) -> Column:
    """The k-th draw below n from a hex digest: 8 places of it."""
    return F.pmod(F.conv(F.substring(h, 1 + 7 * k, 8), 16, 10).cast("bigint"), F.lit(n).cast("bigint")).cast("int")


def pick(pool: tuple[str, ...], h: Column, k: int) -> Column:
    return F.get(strings(pool), draw(h, k, len(pool)))


def numerals(h: Column, width: Column | int) -> Column:
    """That many decimal digits of the digest."""
    digits = F.translate(F.concat(h, F.reverse(h)), "abcdef", "135792")
    return F.substring(digits, F.lit(9), F.lit(width) if isinstance(width, int) else width)


HEX = "0123456789abcdef"
ROUNDS = 4


def made_word(h: Column, n: Column) -> Column:
    """A capitalised word of five syllables; the second namesake's and later ones' have their number in eight more."""
    vowels = "".join(v * 4 for v in VOWELS)
    letters = [F.translate(F.substring(h, 20 + i, 1), HEX, (CONSONANTS, vowels)[i % 2]) for i in range(10)]
    number = F.translate(F.lower(F.lpad(F.hex(n.cast("bigint")), 8, "0")), HEX, CONSONANTS)
    return F.initcap(F.concat(*letters, F.when(n > 1, F.regexp_replace(number, "(.)", "$1a")).otherwise("")))


def quotient(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def elsewhere(x: Column, rows: Column, columns: Column, key: Column) -> Column:
    """Another number below rows * columns: a keyed permutation without fixed points, so no two numbers give the same.

    The number is enciphered in rounds over its quotient and remainder, the
    cipher steps on by one, and is deciphered: one long cycle in a keyed order.
    """

    def moved(s: Column) -> Column:
        rows, columns, key = s["rows"], s["columns"], s["key"]

        def step(acc: Column, i: Column) -> Column:
            a, b = acc["a"], acc["b"]
            turn, sign = F.abs(i), F.when(i < 0, long(-1)).otherwise(long(1))
            new_a = F.pmod(a + sign * F.pmod(F.xxhash64(key, turn, b), rows), rows)
            new_b = F.pmod(b + sign * F.pmod(F.xxhash64(key, turn, a), columns), columns)
            following = F.pmod(a * columns + b + 1, rows * columns)
            return F.struct(
                F.when(i == 0, quotient(following, columns)).when(turn % 2 == 1, new_a).otherwise(a).alias("a"),
                F.when(i == 0, F.pmod(following, columns)).when(turn % 2 == 0, new_b).otherwise(b).alias("b"),
            )

        order = [*range(1, ROUNDS + 1), 0, *range(-ROUNDS, 0)]
        start = F.struct(quotient(s["x"], columns).alias("a"), F.pmod(s["x"], columns).alias("b"))
        return F.aggregate(F.array(*[F.lit(i) for i in order]), start, step, lambda acc: acc["a"] * columns + acc["b"])

    return let(F.struct(x.alias("x"), rows.alias("rows"), columns.alias("columns"), key.alias("key")), moved)


def power_of_ten(width: Column) -> Column:
    return F.rpad(F.lit("1"), width + 1, F.lit("0")).cast("bigint")


def other_digits(digits: Column, key: Column) -> Column:
    """Other digits, as many: each number below 10 ** width has its own."""

    def made(d: Column) -> Column:
        half = F.shiftright(F.length(d), 1)
        return F.lpad(elsewhere(d.cast("bigint"), power_of_ten(F.length(d) - half), power_of_ten(half), key).cast("string"), F.length(d), F.lit("0"))

    return let(digits, made)


def bare(v: Column) -> Column:
    return F.regexp_replace(v, r"(?U)\D", "")


def person(v: Column, h: Column, key: Column, n: Column) -> Column:
    middle = F.when(F.size(F.split(F.trim(v), r"\s+")) >= 3, pick(FIRST, h, 1))
    return F.concat_ws(" ", pick(FIRST, h, 0), middle, made_word(h, n))


def email(v: Column, h: Column, key: Column, n: Column) -> Column:
    dotted = F.contains(F.split_part(v, F.lit("@"), F.lit(1)), F.lit("."))
    return F.concat(F.lower(F.concat(pick(FIRST, h, 0), F.when(dotted, ".").otherwise(""), made_word(h, n))), F.lit("@example.com"))


def phone(v: Column, h: Column, key: Column, n: Column) -> Column:
    spaced = lambda body: F.when(F.length(body) == 10, F.concat(F.left(body, F.lit(5)), F.lit(" "), F.right(body, F.lit(5)))).otherwise(body)
    written = lambda body: F.when(F.startswith(F.trim(v), F.lit("+")), F.concat(F.lit("+91 "), spaced(body))).otherwise(body)
    return let(other_digits(F.right(bare(v), F.lit(10)), key), written)


# The legal forms that an organisation's fake keeps.
LEGAL = (
    r"(?i)(\s+(?:private\s+limited|public\s+limited|limited|ltd\.?|llp|l\.l\.p\.?|llc|l\.l\.c\.?|inc\.?|incorporated|corporation|corp\.?|gmbh|plc"
    r"|n\.?v\.?|b\.?v\.?|a\.?g\.?|s\.?a\.?|pte\.?\s+ltd\.?|family\s+trust|trust|huf))$"
)
# End of the fixed values.


def organisation(v: Column, h: Column, key: Column, n: Column) -> Column:
    return F.concat(made_word(h, n), F.lit(" "), pick(TRADES, h, 1), F.regexp_extract(v, LEGAL, 1))


def address(v: Column, h: Column, key: Column, n: Column) -> Column:
    house = F.concat((draw(h, 0, 900) + 1).cast("string"), F.when(n > 1, F.concat(F.lit("/"), n.cast("string"))).otherwise(""))
    return F.concat_ws(", ", F.concat(house, F.lit(" "), pick(ROADS, h, 1), F.lit(" Road")), F.concat(pick(TOWNS, h, 2), F.lit(" - 9"), numerals(h, 5)))


def luhn_digit(body: Column) -> Column:
    """Counted from the check digit, every other digit from the next one on counts double."""
    doubled = lambda d, i: F.when(i % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    digits = F.transform(F.array_remove(F.split(F.reverse(body), ""), ""), lambda c: c.cast("int"))
    return F.pmod(-F.aggregate(F.transform(digits, doubled), F.lit(0), lambda a, d: a + d), F.lit(10)).cast("string")


def card(v: Column, h: Column, key: Column, n: Column) -> Column:
    """As many digits, in groups of four: the first of 3 to 6, the last the Luhn digit, the others free."""
    sep = F.when(F.contains(v, F.lit("-")), "-").when(F.contains(v, F.lit(" ")), " ").otherwise("")
    grouped = lambda number: F.concat(F.left(number, F.lit(4)), F.regexp_replace(F.substring(number, 5, 20), F.lit(r"(\d{1,4})"), F.concat(sep, F.lit("$1"))))

    def made(digits: Column) -> Column:
        free = F.length(digits) - 2
        half, ten = F.shiftright(free, 1), power_of_ten(free)
        start = F.pmod(F.left(digits, F.lit(1)).cast("bigint") - 3, long(4))
        x = elsewhere(start * ten + F.substring(digits, F.lit(2), free).cast("bigint"), 4 * power_of_ten(half), power_of_ten(free - half), key)
        body = let(x, lambda y: F.concat((quotient(y, ten) + 3).cast("string"), F.lpad(F.pmod(y, ten).cast("string"), free, F.lit("0"))))
        return let(let(body, lambda b: F.concat(b, luhn_digit(b))), grouped)

    return let(bare(v), made)


def site(v: Column, h: Column, key: Column, n: Column) -> Column:
    return F.concat(F.regexp_extract(F.lower(v), "^(https?://)", 1), F.lit("www."), F.lower(made_word(h, n)), F.lower(pick(TRADES, h, 1)), F.lit(".example.com"))


def ssn(v: Column, h: Column, key: Column, n: Column) -> Column:
    """Areas 1 to 899 but 666, groups from 1, serials from 1."""
    area, group, serial = (F.substring(bare(v), a, b).cast("bigint") for a, b in ((1, 3), (4, 2), (6, 4)))
    x = ((area - 1 - (area > 666).cast("bigint")) * 99 + group - 1) * 9999 + serial - 1
    y = elsewhere(F.pmod(x, long(898 * 99 * 9999)), long(898 * 99), long(9999), key)
    place = lambda y: quotient(y, long(99 * 9999)) + 1
    made = lambda y: F.format_string("%03d-%02d-%04d", F.when(place(y) >= 666, place(y) + 1).otherwise(place(y)), F.pmod(quotient(y, long(9999)), long(99)) + 1, F.pmod(y, long(9999)) + 1)
    return let(y, made)


def ip(v: Column, h: Column, key: Column, n: Column) -> Column:
    six = F.concat_ws(":", F.lit("2001"), F.lit("db8"), *[F.substring(h, 1 + 4 * i, 4) for i in range(6)])
    octets = F.transform(F.split(v, r"\."), lambda o: o.cast("bigint"))
    x = F.aggregate(octets, long(0), lambda a, o: a * 256 + o)
    four = let(elsewhere(x, long(1 << 16), long(1 << 16), key), lambda y: F.concat_ws(".", *[F.shiftright(y, 8 * i).bitwiseAND(255).cast("string") for i in (3, 2, 1, 0)]))
    return F.when(F.contains(v, F.lit(":")), six).otherwise(four)


#: Days since the year 1000: birth dates of the usual years move among themselves, those of other years too.
DAY = lambda year: (date(year, 1, 1) - date(1000, 1, 1)).days
USUAL, DAYS = (DAY(1900), DAY(2011)), DAY(3000)


def birthday(v: Column, h: Column, key: Column, n: Column) -> Column:
    """A date of the years 1900 to 2010 for one of them, else another of 1000 to 2999; what is no date gets one of later years."""
    first = F.lit("1000-01-01").cast("date")
    size = USUAL[1] - USUAL[0]  # 2 * 3 * 29 * 233 days

    def made(at: Column) -> Column:
        near = elsewhere(at - USUAL[0], long(174), long(size // 174), key) + USUAL[0]
        moved = elsewhere(F.when(at >= USUAL[1], at - size).otherwise(at), long(3), long((DAYS - size) // 3), key)
        far = let(moved, lambda m: F.when(m >= USUAL[0], m + size).otherwise(m))
        none = DAYS + F.pmod(F.xxhash64(key, v), long(2_500_000))
        return F.when((at >= USUAL[0]) & (at < USUAL[1]), near).when((at >= 0) & (at < DAYS), far).otherwise(none)

    days = let(F.datediff(birth_date(v), first).cast("bigint"), made)
    return F.date_format(F.date_add(first, days.cast("int")), "MMMM dd, yyyy")


#: A generator takes the source value, its digest, the key of the numbers' permutations, and which of those with its digest it is.
GENERATORS: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "PERSON": person,
    "EMAIL": email,
    "PHONE": phone,
    "ORG": organisation,
    "ADDRESS": address,
    "DIN": lambda v, h, key, n: other_digits(bare(v), key),
    "SSN": ssn,
    "CREDIT_CARD": card,
    "IP_ADDRESS": ip,
    "DATE_OF_BIRTH": birthday,
    "WEBSITE": site,
}
#: Types whose fakes are drawn by digest: those that draw the same one, which are few, are numbered.
DRAWN = ("PERSON", "EMAIL", "ORG", "ADDRESS", "WEBSITE")


def fake(entity: Column, value: Column, h: Column, key: Column, n: Column) -> Column:
    def of(s: Column) -> Column:
        named = F.concat(F.lit("["), s["entity"], F.lit("]"))
        made = named
        for name, make in GENERATORS.items():
            made = F.when(s["entity"] == name, make(s["value"], s["h"], s["key"], s["n"])).otherwise(made)
        return F.coalesce(made, named)

    return let(F.struct(entity.alias("entity"), value.alias("value"), h.alias("h"), key.alias("key"), n.alias("n")), of)


def mapping(spans: DataFrame, scope: list[str] | None = None, seed: int = SEED, salt: str = "") -> DataFrame:
    """(scope..., entity_type, canonical, first_original, source_sha256, replacement) of spans (scope, block_index, start, entity_type, text).

    One row for each canonical value; the first spelling is that of the smallest
    (block_index, start). Distinct values have distinct fakes, and none is its
    own source. Numbers (phones, cards, ids, addresses of hosts, birth dates) are
    permuted within their own form by a keyed cipher, so their fakes depend on
    seed, type and value alone, and are as well-formed as the values. Names and
    the like are drawn by digest; the few that draw the same one are numbered,
    in the order of their canonical values, by syllables or house numbers. A fake
    can be some other person's real value, as any plausible one can. Types
    without a generator get their name in brackets. ``salt`` makes the audit
    hashes of short values unguessable.
    """
    scope = scope or []
    groups = spans.withColumn("canonical", canonical_of_span()).groupBy(*scope, "entity_type", "canonical")
    first = groups.agg(F.min_by("text", F.struct("block_index", "start", "text")).alias("first_original"))
    key = F.concat_ws("|", F.lit(str(seed)), *[F.col(s).cast("string") for s in scope], "entity_type")
    digest = F.sha2(F.concat_ws("|", key, F.lit(""), "canonical"), 256)
    e, v = F.col("entity_type"), F.col("first_original")
    drawn = first.withColumn("_h", digest).withColumn("_k", key)
    made = lambda n: built(("fake", n, CONSONANTS, VOWELS), lambda: fake(e, v, F.col("_h"), F.col("_k"), F.lit(n) if isinstance(n, int) else F.col(n)))
    drawn = drawn.withColumn("_f", F.when(e.isin(*DRAWN), F.lower(made(1))).otherwise(F.col("canonical")))
    # A value that is its own draw comes last in its group, and is never its first.
    own = canonical(e, F.col("_f")) == F.col("canonical")
    # The draws have 30 random bits and more, so a group is a few rows; the other types' groups are one.
    rank = F.row_number().over(Window.partitionBy(*scope, "entity_type", "_f").orderBy(own.cast("int"), "canonical"))
    number = F.when(own & (rank == 1), F.lit(2)).otherwise(rank)
    numbered = drawn.withColumn("_n", number)
    return numbered.select(*scope, "entity_type", "canonical", "first_original", F.sha2(F.concat(F.lit(salt), "first_original"), 256).alias("source_sha256"), made("_n").alias("replacement"))
