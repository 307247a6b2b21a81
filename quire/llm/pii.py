"""Format-preserving pseudonyms for personal numbers and dates, written with DataFrame expressions only."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The session setting that holds the secret key of the pseudonyms.
KEY_SETTING = "spark.quire.pseudonym.key"
ROUNDS = 8
# The shapes looked for, most specific first; a match counts only if it also passes its own check below.
SHAPES = {
    # begins where its characters begin or the match before ended, and never gives characters back: linear in any text
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}",
    "ip": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])",
    "date": r"(?:(?<![\w.-])|(?<=[0-9]{4}-[0-9]{2}-[0-9]{2}-))[0-9]{4}-[0-9]{2}-[0-9]{2}(?:(?!\w)|(?=[Tt][0-9]{2}))|(?<![\w./])[0-9]{2}[./][0-9]{2}[./][0-9]{4}(?:(?![\w/])|(?=[Tt][0-9]{2}))",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<![\w+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![\w-])|(?<!\w)\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![\w-])"
    # in pairs behind a country code; plain, with or without the long-distance 1
    r"|(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\(0\) ?)?[0-9]{1,4}(?:[ .-][0-9]{2}){3,4}(?![\w-])|(?<![\w.+-])(?:1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-]|\.[0-9])",
}
# A run of digit groups of 13 digits or more, which may hold card numbers; it ends before a value of another shape.
GROUP = r"[0-9]++(?!\w|-(?![0-9]))"
SHAPES["card"] = rf"(?<![\w-])(?=[0-9](?:[ -]?[0-9]){{12}}){GROUP}(?:[ -](?!{'|'.join(SHAPES[k] for k in ('date', 'ssn', 'phone'))}){GROUP})*+"
ANY = "|".join(SHAPES.values())
#: 28-year cycles of the Julian rule that the Gregorian calendar follows from 1901-01-01 to 2096-12-31: 147 x 487 days.
FIRST_DAY, DAYS = "1901-01-01", (147, 487)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(number: Column) -> Column:
    """Sum of the digits where every second one from the right, beginning with the last but one, is doubled."""
    step = lambda acc, i: acc + _weight(F.substring(number, F.length(number) - i, F.lit(1)).cast("int"), i % 2 == 1)
    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), step)


def _weight(digit: Column, doubled: Column) -> Column:
    return F.when(doubled & (digit > 4), digit * 2 - 9).when(doubled, digit * 2).otherwise(digit)


def permuted(left: Column, right: Column, sizes: tuple[Column, Column], tweak: str, key: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of (left, right) in sizes[0] x sizes[1]: a Feistel network that adds a keyed hash of one half to
    the other, modulo its size, in turn. Every round can be undone, so different values stay different."""

    def noise(half: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(f"{key}|{tweak}"), i.cast("string"), half.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        a = F.when(even, F.pmod(acc["a"] + noise(acc["b"], i), sizes[0])).otherwise(acc["a"])
        b = F.when(even, acc["b"]).otherwise(F.pmod(acc["b"] + noise(acc["a"], i), sizes[1]))
        return F.struct(a.alias("a"), b.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), F.struct(left.cast("long").alias("a"), right.cast("long").alias("b")), turn)


def permuted_digits(number: Column, tweak: str, key: str) -> Column:
    """A digit string of the same length; strings of one length map to each other one to one."""
    half = F.floor(F.length(number) / 2).cast("int")
    rest = F.length(number) - half
    sizes = F.pow(F.lit(10), half).cast("long"), F.pow(F.lit(10), rest).cast("long")
    got = permuted(F.substring(number, F.lit(1), half).cast("long"), F.substring(number, half + 1, rest).cast("long"), sizes, tweak, key)
    join = lambda s: F.concat(F.lpad(s["a"].cast("string"), half, F.lit("0")), F.lpad(s["b"].cast("string"), rest, F.lit("0")))
    return F.element_at(F.transform(F.array(got), join), 1)


def refilled(shape: Column, number: Column) -> Column:
    """``shape`` with its digits replaced in order by those of ``number``."""

    def put(acc: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(acc["out"], F.when(digit, F.substring(number, acc["k"], F.lit(1))).otherwise(c)).alias("out"), (acc["k"] + digit.cast("int")).alias("k"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), put, lambda acc: acc["out"])


def _card(m: Column, key: str) -> Column:
    number = digits(m)
    body = permuted_digits(F.substring(number, F.lit(1), F.length(number) - 1), "card", key)
    check = lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))
    return refilled(m, F.element_at(F.transform(F.array(body), check), 1))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999, numbered without gaps and permuted."""
    area, low = m.substr(1, 3).cast("long"), (m.substr(5, 2).cast("long") - 1) * 9999 + m.substr(8, 4).cast("long") - 1
    got = permuted(area - 1 - (area > 666).cast("int"), low, (F.lit(898), F.lit(99 * 9999)), "ssn", key)
    full = lambda s: F.format_string("%03d-%02d-%04d", s["a"] + 1 + (s["a"] >= 665).cast("int"), F.floor(s["b"] / 9999) + 1, s["b"] % 9999 + 1)
    return F.element_at(F.transform(F.array(got), full), 1)


def _day(m: Column) -> Column:
    iso = F.try_to_timestamp(m, F.lit("yyyy-MM-dd")).cast("date")
    other = F.try_to_timestamp(F.regexp_replace(m, "[./]", "."), F.lit("dd.MM.yyyy")).cast("date")
    return F.when(m.substr(5, 1) == "-", iso).otherwise(other)


def _date(m: Column, key: str) -> Column:
    n = F.datediff(_day(m), F.lit(FIRST_DAY).cast("date"))
    got = permuted(F.floor(n / DAYS[1]), n % DAYS[1], (F.lit(DAYS[0]), F.lit(DAYS[1])), "date", key)
    day = lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["a"] * DAYS[1] + s["b"]).cast("int"))
    new = F.element_at(F.transform(F.array(got), day), 1)
    return F.when(m.substr(5, 1) == "-", F.date_format(new, "yyyy-MM-dd")).otherwise(refilled(m, F.date_format(new, "ddMMyyyy")))


def _ip(m: Column, key: str) -> Column:
    part = lambda k: F.split(m, r"\.").getItem(k).cast("long")
    got = permuted(part(0) * 256 + part(1), part(2) * 256 + part(3), (F.lit(65536), F.lit(65536)), "ip", key)
    dotted = lambda s: F.concat_ws(".", *((F.floor(s[h] / 256) if top else s[h] % 256).cast("string") for h in "ab" for top in (True, False)))
    return F.element_at(F.transform(F.array(got), dotted), 1)


def _phone(m: Column, key: str) -> Column:
    """The last nine or ten digits are permuted; a country code in front stays."""
    number = digits(m)
    keep = F.greatest(F.length(number) - 10, F.when(m.startswith("+"), F.least(F.lit(1), F.length(number) - 7)).otherwise(0))
    return refilled(m, F.concat(F.substring(number, F.lit(1), keep), permuted_digits(F.substring(number, keep + 1, F.length(number) - keep), "phone", key)))


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(m)), 256), 1, 32), F.lit("@mail.invalid"))


def _is(kind: str, m: Column) -> Column:
    return m.rlike(f"^(?:{SHAPES[kind]})$")


def valid(m: Column) -> Column:
    """Kind of a match that is one value, or null if its number or date cannot be real, or if it is a run of digit groups."""
    octets = F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255)
    good_ssn = ~m.substr(1, 3).isin("000", "666") & (m.substr(1, 1) != "9") & (m.substr(5, 2) != "00") & (m.substr(8, 4) != "0000")
    good_day = _day(m).between(F.lit(FIRST_DAY).cast("date"), F.lit("2096-12-31").cast("date"))
    return (
        F.when(m.contains("@"), F.lit("email"))
        .when(_is("ip", m), F.when(octets, F.lit("ip")))
        .when(_is("date", m), F.when(good_day, F.lit("date")))
        .when(_is("ssn", m), F.when(good_ssn, F.lit("ssn")))
        .when(_is("phone", m), F.lit("phone"))
    )


def _good_card(number: Column) -> Column:
    return F.when(F.length(number).between(13, 19), luhn_sum(number) % 10 == 0).otherwise(False)


def _cards(groups: Column) -> Column:
    """(first, size) of the card numbers among digit groups: whole groups of together 13 to 19 digits that pass Luhn.

    All groups together come first; then, from left to right, the fewest groups that are a number. One that meets a later
    one of fewer groups gives way to it, unless that gives way itself.
    """

    def fewest(i: Column) -> Column:
        near = F.transform(F.sequence(i, F.least(i + 18, F.size(groups))), lambda j: digits(F.get(groups, j - 1)))
        numbers = lambda w: F.transform(F.sequence(F.lit(1), F.size(w)), lambda k: F.array_join(F.slice(w, 1, k), ""))
        size = lambda w: F.array_position(F.transform(numbers(w), _good_card), True).cast("int")
        return F.struct(i.alias("first"), F.element_at(F.transform(F.array(near), size), 1).alias("size"))

    def inside(windows: Column, w: Column) -> Column:
        later = F.transform(F.sequence(w["first"], w["first"] + w["size"] - 1), lambda j: F.get(windows, j - 1))
        return F.filter(later, lambda v: (v["size"] > 0) & (v["size"] < w["size"]))

    free = lambda acc, w: F.size(acc).eqNullSafe(0) | (F.element_at(acc, -1)["first"] + F.element_at(acc, -1)["size"] <= w["first"])

    def picked(windows: Column) -> Column:
        stays = lambda w: (w["size"] > 0) & ~F.exists(inside(windows, w), lambda v: F.size(inside(windows, v)) == 0)
        return F.aggregate(F.filter(windows, stays), F.array().cast("array<struct<first:int,size:int>>"), lambda acc, w: F.when(free(acc, w), F.concat(acc, F.array(w))).otherwise(acc))

    windows = F.transform(F.sequence(F.lit(1), F.size(groups)), fewest)
    whole = F.element_at(F.transform(F.array(digits(F.array_join(groups, ""))), _good_card), 1)
    all_ = F.array(F.struct(F.lit(1).alias("first"), F.size(groups).alias("size")))
    return F.when(whole, all_).otherwise(F.element_at(F.transform(F.array(windows), picked), 1))


def _run(m: Column, key: str) -> Column:
    """(text, kinds) of a run of digit groups with its card numbers replaced."""

    def rebuilt(r: Column) -> Column:
        groups, cards = r["groups"], r["cards"]
        # groups are read by place, as a slice would go through all of them each time
        part = lambda i, n: F.when(n > 0, F.array_join(F.transform(F.sequence(i, i + n - 1), lambda j: F.get(groups, j - 1)), "")).otherwise("")
        end = lambda c: c["first"] + c["size"]
        before = lambda i: F.when(i == 0, F.lit(1)).otherwise(end(F.get(cards, i - 1)))
        pieces = F.transform(cards, lambda c, i: F.concat(part(before(i), c["first"] - before(i)), _card(part(c["first"], c["size"]), key)))
        last = before(F.size(cards))
        text = F.concat(F.array_join(pieces, ""), part(last, F.size(groups) - last + 1))
        return F.struct(text.alias("text"), F.transform(cards, lambda c: F.lit("card")).alias("kinds"))

    with_cards = lambda g: F.struct(g.alias("groups"), _cards(g).alias("cards"))
    groups = F.array(F.regexp_extract_all(m, F.lit("[ -]?[0-9]+"), F.lit(0)))
    return F.element_at(F.transform(F.transform(groups, with_cards), rebuilt), 1)


def replaced(m: Column, key: str) -> Column:
    """(text, kinds): what stands for a match, and the kinds of the values in it; one that is not valid stays as it is."""

    def made(k: Column) -> Column:
        out = F.when(k.isNull(), m)
        for name, make in {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone}.items():
            out = out.when(k == name, make(m, key))
        one = F.struct(out.alias("text"), F.filter(F.array(k), lambda x: x.isNotNull()).alias("kinds"))
        return F.when(k.isNull() & _is("card", m), _run(m, key)).otherwise(one)

    return F.element_at(F.transform(F.array(valid(m)), made), 1)


def pseudonym(m: Column, key: str) -> Column:
    return replaced(m, key)["text"]


def session_key(spark: SparkSession) -> str:
    """The session's secret key: ``spark.quire.pseudonym.key``, or one drawn at first use and kept for the session.

    Whoever holds the key can undo numbers and dates, so it is never part of the source. Set it to keep values linked
    between sessions; a drawn key links them within one and is gone with it.
    """
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymised(docs: DataFrame, key: str | None = None, column: str = "text") -> DataFrame:
    """``docs`` with personal values in ``column`` replaced and two columns added: n_found, kinds (kind to count).

    Card numbers (Luhn; also beside other digit groups), phone numbers (behind a country code, also in pairs, with an area
    code in parentheses, or plain as 3-3-4 digits), social security numbers, IPv4 addresses and dates (also of date-times) become other valid values of the
    same form by keyed permutation; a mail address becomes a keyed pseudonym. Equal values are equal afterwards in every
    document, whatever separates their digits. Without ``key`` it is the session's (``session_key``). Null texts stay null with nothing found. If ``docs`` already has columns of
    the added names, they are replaced. Rows are handled one by one: no exchange, no order, repeated rows stay repeated.
    """
    return _rewritten(docs, key or session_key(docs.sparkSession), column)


def _rewritten(docs: DataFrame, key: str, column: str) -> DataFrame:
    taken = {c.lower() for c in docs.columns}
    found, new, kinds = (next(n for n in (f"_{name}{'_' * i}" for i in range(len(taken) + 1)) if n not in taken) for name in ("found", "new", "kinds"))
    text = F.col(column)
    rows = docs.drop("n_found", "kinds").withColumn(found, F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    has = F.size(found) > 0
    between = F.split(text, ANY, -1)
    rows = rows.withColumn(new, F.transform(found, lambda m: replaced(m, key)))
    whole = F.array_join(F.zip_with(between, F.concat(F.col(new)["text"], F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    rows = rows.withColumn(kinds, F.when(has, F.flatten(F.col(new)["kinds"]))).withColumn(column, F.when(has, whole).otherwise(text))
    count = F.map_from_entries(F.transform(F.array_distinct(kinds), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)))))
    return rows.withColumn("n_found", F.when(has, F.size(kinds)).otherwise(0).cast("long")).withColumn("kinds", F.when(has, count)).drop(found, new, kinds)
