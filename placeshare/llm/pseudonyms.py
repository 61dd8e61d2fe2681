"""Format-preserving Feistel pseudonyms for personal data, in DataFrame operations only.

A keyed Feistel network permutes the values of each format, so a value is replaced by another of
the same format, equal values stay equal in all documents, and the key's holder can go back:

- payment card numbers (an issuer's first digits and length, undivided or in usual groups between single
  spaces or hyphens, and valid by the Luhn sum): the issuer's digits stay, the others are permuted,
  and the last is set so that the sum is right again. In a run of numbers, the first card from the left counts
- social security numbers with a valid area: permuted among such numbers
- phone numbers in international form: the country code stays
- IPv4 addresses: permuted among those that begin with 1 to 254, but not 127; others stay
- dates (year-month-day, or day and month before the year with / or .; 1700 to 2099): permuted
  among the days of these 400 years. Slashed dates count day first; where only month first makes a
  date, it stays such a date (after the 28th only the year moves, on a February 29 among leap years)
- e-mail addresses: the local part is permuted, letters among letters, digits among digits
- access keys and secrets after an equals sign or colon: as local parts

Numbers that fail validation stay. Two readings of one run (five groups of four digits) are told
apart by the sum, so there another reading can win on the way back. Everything runs within one scan of
the text: matches are found by one pattern, and the text between them is put back as it was. There is no
shuffle and no state. Repeats in the pattern are of one class of signs, possessive or bounded by what
the format allows (64 signs of a local part, 253 of a domain), so no text recurses or takes quadratic time.

Null texts stay null with no matches, empty texts stay empty. Repeated rows are treated alike.
All columns are kept; only ``text`` changes, and ``n_chars``, if there, is set to its new length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: fixed values: the formats that are recognised
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-][A-Za-z0-9.-]{0,251}\.[A-Za-z]{2,63}"
ACCESS_KEY = r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
SECRET = r"(?:token|secret|password|passwd|api[_-]?key)\s*[=:]\s*[\"']?[0-9A-Za-z_\-]{12,}"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])|[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9])"
IP = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9])"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: a whole run of numbers, in which ``_cards`` finds the cards; other personal data ends it
CARD = rf"(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?:[ -](?!{EMAIL}|{DATE}|{IP}|{SSN})[0-9]++)*+"
#: groups of digits, and first digits by issuer with the lengths of whole numbers
GROUPS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (6, 4, 6), (4, 4, 5), (4, 3, 3, 3), (4, 4, 4, 4, 3))
ISSUERS = (
    ("4", "13|16|19"), ("5[1-5]|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720", "16"), ("3[47]", "15"),
    ("30[0-5]|36|38|39", "14|16|19"), ("352[89]|35[3-8][0-9]", "16|17|18|19"), ("6011|64[4-9]|65|62", "16|17|18|19"),
    ("5[0678]|63|67", "13|14|15|16|17|18|19"),
)
ISSUED = "^(?:" + "|".join(f"(?=(?:{'|'.join(f'.{{{n}}}' for n in lengths.split('|'))})$)(?:{first})" for first, lengths in ISSUERS) + ")"
BLOCK = 512
PHONE = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])"
KINDS = {
    "email": EMAIL, "access_key": ACCESS_KEY, "secret": SECRET, "date": DATE, "ip": IP, "ssn": SSN, "card": CARD,
    "phone": PHONE,
}
FOUND = "(?<![0-9A-Za-z])(?:" + "|".join(KINDS.values()) + ")"
FIRST_DAY, DAYS_A, DAYS_B = "1700-01-01", 189, 773  # 189 * 773 = 146,097 days, 400 years
AREAS, SERIALS = 898, 99 * 9999
LEAP_YEARS = [y for y in range(1700, 2100) if y % 4 == 0 and (y % 100 or y % 400 == 0)]
NETWORKS = 253  # first numbers 1 to 254 without 127


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _number(key: Column, turn: Column, half: Column, tag: str) -> Column:
    """A keyed pseudo-random number of 52 bits from a round and the other half."""
    digest = F.sha2(F.concat_ws("|", key, F.lit(tag), turn.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def _rounds(start: Column, step, backwards: bool) -> Column:
    turns = list(range(ROUNDS))[:: -1 if backwards else 1]
    return F.aggregate(F.array(*map(F.lit, turns)), start, step)


def permuted_pair(key: Column, tag: str, x: Column, y: Column, a: int, b: int, backwards: bool = False) -> Column:
    """A keyed permutation of the pairs (x, y) with 0 <= x < a and 0 <= y < b: a struct ``x``, ``y``."""
    sign = -1 if backwards else 1

    def step(s, turn):
        even = turn % 2 == 0
        moved_x = F.pmod(s["x"] + sign * F.pmod(_number(key, turn, s["y"], tag), F.lit(a)), F.lit(a))
        moved_y = F.pmod(s["y"] + sign * F.pmod(_number(key, turn, s["x"], tag), F.lit(b)), F.lit(b))
        return F.struct(
            F.when(even, moved_x).otherwise(s["x"]).cast("long").alias("x"),
            F.when(even, s["y"]).otherwise(moved_y).cast("long").alias("y"),
        )

    return _rounds(F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), step, backwards)


def permuted_text(key: Column, tag: str, text: Column, backwards: bool = False) -> Column:
    """A keyed permutation of the texts with the same pattern of digits, letters and other signs."""
    sign = -1 if backwards else 1

    def shifted(part, other, turn):
        digest = F.sha2(F.concat_ws("|", key, F.lit(tag), turn.cast("string"), F.length(part).cast("string"), other), 256)

        def with_(digest):
            def char(c, i):
                base = F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65)
                radix = F.when(base == 48, 10).otherwise(26)
                by = F.conv(F.substr(digest, F.pmod(i * 3, F.lit(60)) + 1, F.lit(4)), 16, 10).cast("int")
                by = by + F.floor(i / 20).cast("int") * 7
                return F.when(base.isNull(), c).otherwise(
                    F.chr((base + F.pmod(F.ascii(c) - base + sign * F.pmod(by, radix), radix)).cast("long"))
                )

            return F.concat_ws("", F.transform(F.split(part, ""), char))

        return _let(digest, with_)  # once, not for each sign

    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(
        F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1, F.length(text)).alias("r"),
    )

    def step(s, turn):
        even = turn % 2 == 0
        return F.struct(
            F.when(even, shifted(s["l"], s["r"], turn)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(shifted(s["r"], s["l"], turn)).alias("r"),
        )

    return _let(_rounds(start, step, backwards), lambda s: F.concat(s["l"], s["r"]))


def luhn_digit(digits: Column) -> Column:
    """The digit that makes the Luhn sum of ``digits`` and itself a multiple of ten."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: _let(
            c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v))),
        F.lit(0), lambda s, v: s + v,
    )
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def _spread(shape: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``shape``, its other signs as they are."""
    return F.aggregate(
        F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(c.rlike("[0-9]"), F.struct(
            F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"),
        )).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
        lambda s: s["out"],
    )


def _card(key: Column, m: Column, backwards: bool) -> Column:
    """A valid card number with its separators, permuted."""
    def changed(d):
        def of(issuer):
            body = permuted_text(key, "card", F.substr(d, F.length(issuer) + 1, F.length(d) - F.length(issuer) - 1), backwards)
            return _spread(m, _let(F.concat(issuer, body), lambda p: F.concat(p, luhn_digit(p))))

        return _let(F.regexp_extract(d, ISSUED, 0), of)

    return _let(F.regexp_replace(m, "[^0-9]", ""), changed)


def _is_card(m: Column) -> Column:
    valid = lambda d: d.rlike(ISSUED) & (luhn_digit(F.left(d, F.length(d) - 1)) == F.right(d, F.lit(1)))
    return F.coalesce(_let(F.regexp_replace(m, "[^0-9]", ""), valid), F.lit(False))


def _cards(key: Column, m: Column, backwards: bool) -> Column:
    """A run of numbers with its cards permuted: a struct of the ``text`` and ``n``, how many changed."""
    def within(cells):
        window = lambda i, k: F.concat_ws("", F.slice(cells, i, F.lit(k) if isinstance(k, int) else k))

        def sized(sizes):
            def parts(i):
                """Of how many numbers the card that begins with the i-th consists; 0 if none does."""
                fits = lambda g: F.forall(F.sequence(F.lit(0), F.lit(len(g) - 1)), lambda j: F.coalesce(
                    F.get(sizes, i - 1 + j) == F.array(*map(F.lit, g))[j], F.lit(False)))
                grouped = [F.when(fits(g), F.when(_is_card(window(i, len(g))), len(g))) for g in GROUPS]
                size = F.get(sizes, i - 1)
                return F.when(size >= 13, F.when(_is_card(cells[i - 1]), 1).otherwise(0)).when(
                    size.isin(*{g[0] for g in GROUPS}), F.coalesce(*grouped, F.lit(0))).otherwise(0)

            def resolved(known):
                def step(s, i):
                    put = lambda old, new, k: F.struct(
                        (i + k).cast("int").alias("next"), F.concat(s["text"], new).alias("text"),
                        (s["n"] + (old != new).cast("int")).alias("n"),
                    )
                    return F.when(i < s["next"], s).otherwise(_let(known[i - 1], lambda k: F.when(
                        k == 0, put(cells[i - 1], cells[i - 1], F.lit(1))).otherwise(
                        _let(window(i, k), lambda w: _let(_card(key, w, backwards), lambda new: put(w, new, k))))))

                def block(s, b):
                    """Texts grow within a block only, so that long runs are not copied again and again."""
                    start = F.struct(s["next"].alias("next"), F.lit("").alias("text"), s["n"].alias("n"))
                    end = F.least(b * BLOCK + BLOCK, F.size(cells))
                    return _let(F.aggregate(F.sequence(b * BLOCK + 1, end), start, step), lambda e: F.struct(
                        e["next"].alias("next"), F.concat(s["pieces"], F.array(e["text"])).alias("pieces"), e["n"].alias("n")))

                start = F.struct(F.lit(1).alias("next"), F.expr("cast(array() as array<string>)").alias("pieces"), F.lit(0).alias("n"))
                blocks = F.sequence(F.lit(0), F.floor((F.size(cells) - 1) / BLOCK).cast("int"))
                folded = F.aggregate(blocks, start, block, lambda s: F.struct(F.concat_ws("", s["pieces"]).alias("text"), s["n"].alias("n")))
                plain = F.struct(m.alias("text"), F.lit(0).alias("n"))
                return F.when(F.exists(known, lambda k: k > 0), folded).otherwise(plain)

            return _let(F.transform(F.sequence(F.lit(1), F.size(cells)), parts), resolved)

        return _let(F.transform(cells, lambda c: F.length(F.rtrim(F.rtrim(c), F.lit("-")))), sized)

    return _let(F.regexp_extract_all(m, F.lit("[0-9]+[ -]?"), F.lit(0)), within)


def _ip(key: Column, m: Column, backwards: bool) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("int"))

    def changed(o):
        valid = F.forall(o, lambda v: v < 256) & ~o[0].isin(0, 127, 255)
        first = o[0] - F.when(o[0] > 127, 2).otherwise(1)
        pair = permuted_pair(key, "ip", first * 256 + o[1], o[2] * 256 + o[3], NETWORKS * 256, 65536, backwards)
        return F.when(valid, _let(pair, lambda p: F.concat_ws(
            ".", (F.floor(p["x"] / 256) + F.when(p["x"] >= 126 * 256, 2).otherwise(1)).cast("string"),
            (p["x"] % 256).cast("string"), F.floor(p["y"] / 256).cast("string"), (p["y"] % 256).cast("string"),
        ))).otherwise(m)

    return _let(parts, changed)


def _ssn(key: Column, m: Column, backwards: bool) -> Column:
    area, group, serial = (F.split(m, "-")[i].cast("int") for i in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    pair = permuted_pair(key, "ssn", place, (group - 1) * 9999 + serial - 1, AREAS, SERIALS, backwards)
    digits = lambda v, n: F.lpad(v.cast("string"), n, "0")
    return F.when(valid, _let(pair, lambda p: F.concat_ws(
        "-", digits(p["x"] + 1 + F.when(p["x"] >= 665, 1).otherwise(0), 3),
        digits(F.floor(p["y"] / 9999) + 1, 2), digits(p["y"] % 9999 + 1, 4),
    ))).otherwise(m)


def _date(key: Column, m: Column, backwards: bool) -> Column:
    iso = F.substr(m, F.lit(5), F.lit(1)) == "-"
    mark = F.substr(m, F.lit(3), F.lit(1))
    ends = [F.when(iso, F.substr(m, F.lit(a), F.lit(n))).otherwise(F.substr(m, F.lit(b), F.lit(k)))
            for a, n, b, k in ((1, 4, 7, 4), (6, 2, 4, 2), (9, 2, 1, 2))]

    def day_first(d):
        n = F.datediff(d, F.lit(FIRST_DAY).cast("date"))
        pair = permuted_pair(key, "date", F.floor(n / DAYS_B), n % DAYS_B, DAYS_A, DAYS_B, backwards)

        def shown(new):
            return (
                F.when(iso, F.date_format(new, "yyyy-MM-dd"))
                .when(mark == "/", F.date_format(new, "dd/MM/yyyy")).otherwise(F.date_format(new, "dd.MM.yyyy"))
            )

        moved = _let(pair, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["x"] * DAYS_B + p["y"]).cast("int")))
        return F.when(n.between(0, DAYS_A * DAYS_B - 1), _let(moved, shown)).otherwise(m)

    def month_first(d):
        """Only dates after the 12th get here, and must stay such; after the 28th only the year moves."""
        year, month, day = F.year(d) - 1700, F.month(d) - 1, F.dayofmonth(d)
        usual = permuted_pair(key, "month first", year, month * 16 + day - 13, 400, 192, backwards)
        late = permuted_pair(key, "month first", F.floor(year / 20), year % 20, 20, 20, backwards)
        two = lambda v: F.lpad(v.cast("string"), 2, "0")
        years = F.array(*map(F.lit, LEAP_YEARS))
        dealt = F.transform(F.array_sort(F.transform(years, lambda y: F.struct(
            F.sha2(F.concat_ws("|", key, F.lit("leap year"), y.cast("string")), 256).alias("h"), y.alias("y")))), lambda s: s["y"])
        old, new = (dealt, years) if backwards else (years, dealt)
        leap = F.try_element_at(new, F.array_position(old, F.year(d)).cast("int"))
        return (
            F.when(~year.between(0, 399), m)
            .when((month == 1) & (day == 29), F.concat(F.left(m, F.lit(6)), leap.cast("string")))
            .when(day > 28, _let(late, lambda p: F.concat(F.left(m, F.lit(6)), (p["x"] * 20 + p["y"] + 1700).cast("string"))))
            .otherwise(_let(usual, lambda p: F.concat_ws(
                "/", two(F.floor(p["y"] / 16) + 1), two(p["y"] % 16 + 13), (p["x"] + 1700).cast("string"))))
        )

    read = lambda *parts: F.try_to_timestamp(F.concat_ws("-", *parts), F.lit("yyyy-MM-dd")).cast("date")
    return _let(read(*ends), lambda d: F.when(d.isNotNull(), day_first(d)).when(
        mark == "/", _let(read(ends[0], ends[2], ends[1]), lambda u: F.when(u.isNotNull(), month_first(u)).otherwise(m))
    ).otherwise(m))


def _tail(key: Column, tag: str, m: Column, head: str, backwards: bool) -> Column:
    """Permutes what follows the part of the match that ``head`` describes."""
    fixed = F.regexp_extract(m, f"^{head}", 0)
    return _let(fixed, lambda h: F.concat(h, permuted_text(key, tag, F.substr(m, F.length(h) + 1, F.length(m)), backwards)))


def pseudonym(key: Column, m: Column, backwards: bool = False) -> Column:
    """What a match of ``FOUND`` is replaced by: a struct of the ``text`` and ``n``, how many values changed."""
    is_a = lambda kind: m.rlike(f"^(?:{KINDS[kind]})$")
    local = F.substring_index(m, "@", 1)
    other = (
        F.when(is_a("email"), F.concat(permuted_text(key, "email", local, backwards), F.substr(m, F.length(local) + 1, F.length(m))))
        .when(is_a("access_key"), _tail(key, "key", m, "AKIA", backwards))
        .when(is_a("secret"), _tail(key, "secret", m, r"[A-Za-z_-]+\s*[=:]\s*[\"']?", backwards))
        .when(is_a("date"), _date(key, m, backwards))
        .when(is_a("ip"), _ip(key, m, backwards))
        .when(is_a("ssn"), _ssn(key, m, backwards))
        .when(is_a("phone"), _tail(key, "phone", m, r"\+[0-9]{1,3}(?![0-9])", backwards))
        .otherwise(m)
    )
    one = _let(other, lambda new: F.struct(new.alias("text"), (new != m).cast("int").alias("n")))
    numbers = m.rlike("^[0-9 -]+$") & (F.length(F.regexp_replace(m, "[^0-9]", "")) >= 13)  # more than a date or SSN has
    return F.when(numbers, _cards(key, m, backwards)).otherwise(one)


def pseudonymised(docs: DataFrame, key: str, backwards: bool = False, count: str | None = None) -> DataFrame:
    """``docs`` with its texts' personal data replaced; ``count`` names a column for the matches replaced."""
    pattern, k = F.lit(FOUND), F.lit(key)
    found = F.when(F.col("text").rlike("[0-9@=:]"), F.regexp_extract_all("text", pattern, F.lit(0)))
    between = F.split("text", FOUND, -1)
    hidden = ["pii_found", "pii_new"]
    while set(hidden) & set(docs.columns):
        hidden = [f"_{name}" for name in hidden]
    new = F.transform(hidden[0], lambda m: pseudonym(k, m, backwards))
    out = docs.withColumn(hidden[0], found).withColumn(hidden[1], F.when(F.size(hidden[0]) > 0, new))
    pieces = F.zip_with(between, F.array_append(F.col(f"{hidden[1]}.text"), F.lit("")), lambda a, b: F.concat(a, b))
    changed = F.aggregate(f"{hidden[1]}.n", F.lit(0), lambda s, n: s + n)
    text = F.when(changed > 0, F.concat_ws("", pieces)).otherwise(F.col("text"))  # texts that stay are not split
    named = []
    for name in docs.columns:
        named.append(
            text.alias("text") if name == "text"
            else F.coalesce(F.length(text), F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias(name)
            if name == "n_chars" else F.col(name)
        )
    if count:
        named.append(F.when(F.size(hidden[0]) > 0, changed).otherwise(F.lit(0)).cast("long").alias(count))
    return out.select(*named)
