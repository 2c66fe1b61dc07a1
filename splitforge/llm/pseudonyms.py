"""Pseudonyms for personal numbers and dates by format-preserving Feistel networks, in Spark SQL functions alone.

Candidates are found by one pattern, validated (check digits, ranges, calendar), and permuted under a key within the
set of values of their format: a card number becomes another with a right check digit, a date another date. The
permutation depends on the key and the format only, and numbers are permuted without their separators, which are put
back; so equal values stay equal in all documents, however they are spelt, and whoever has the key can reverse it.

Two digits, two digits and a year are day, month and year where that is a date, else month, day and year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitforge.llm.shared import new_path

ROUNDS = 8
#: Dates are permuted among the days of a span of 250 * 292 days; spans are counted from the first day.
FIRST_DAY, DAYS_HIGH, DAYS_LOW = "1900-01-01", 250, 292
#: The spans that the years 1 and 9999 cut short, by number: (day they begin with, high, low).
EDGES = {-10: (-693_595, 65, 563), 40: (2_920_000, 64, 601)}
#: Ranges of the first four digits of payment cards, and how many digits these have at least and at most.
ISSUERS = (
    (2221, 2720, 16, 16), (3000, 3059, 14, 19), (3400, 3499, 15, 15), (3528, 3589, 16, 19), (3600, 3699, 14, 19), (3700, 3799, 15, 15),
    (3800, 3999, 14, 19), (4000, 4999, 13, 19), (5000, 5099, 13, 19), (5100, 5599, 16, 16), (5600, 5899, 13, 19), (6000, 6999, 13, 19),
)
#: The forms of candidates, in order of preference.
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,63}",
    "secret": r"(?i:password|passwd|token|secret|api_key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,}+",
    "access_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
    "iso_date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "day_date": r"(?<![0-9./])[0-9]{2}[./][0-9]{2}[./][0-9]{4}(?![0-9/])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
}
#: A run of digit groups of 13 digits and more, up to a group that begins another form; cards are looked for within it.
FORMS["card"] = r"(?<![0-9A-Za-z])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?![A-Za-z])(?:(?:-| (?!" + "|".join(FORMS[f] for f in ("email", "iso_date", "day_date", "ssn", "ip")) + r"))[0-9]++(?![A-Za-z]))*+"
#: Characters that one network permutes; longer values are permuted in pieces.
PIECE = 32
PATTERN = "|".join(f"(?:{p})" for p in FORMS.values())
DATES = ("iso_date", "day_date", "month_date")


def _digit(text: Column, at) -> Column:
    return F.substring(text, at, 1).cast("int")


def put_key(spark: SparkSession, key: str) -> str:
    """A new file in the shared folder that holds the key, for a job that has it from elsewhere. It is written as bytes, so no plan
    shows it."""
    path = new_path(spark, "key")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(place)
    out.write(key.encode())
    out.close()
    return path


def key_table(spark: SparkSession, path: str) -> DataFrame:
    """The key that a file holds, as a table of one row."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("key"))


def _hash(key: str | Column, tweak: str | Column, turn: Column, half: Column) -> Column:
    """A keyed hash of one half in a round, as 128 hex digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), tweak if isinstance(tweak, Column) else F.lit(tweak), turn.cast("string"), half), 512)


def _shifted(char: Column, by: Column, sign: int) -> Column:
    """The character moved within its class: digits, lower case, capitals; others stay."""

    def within(first: str, size: int) -> Column:
        return F.chr(F.pmod(F.ascii(char) - ord(first) + sign * by, F.lit(size)) + ord(first))

    return F.when(char.between("0", "9"), within("0", 10)).when(char.between("a", "z"), within("a", 26)).when(char.between("A", "Z"), within("A", 26)).otherwise(char)


def permuted_text(text: Column, key: str | Column, tweak: str | Column, sign: int = 1) -> Column:
    """A Feistel network over the characters of a text of at most PIECE: each round adds a keyed hash of one half to
    the other, 32 bits for each character, within its class. sign -1 reverses it."""
    chars = F.split(text, "")
    half = (F.size(chars) / 2).cast("int")
    left, right = F.slice(chars, F.lit(1), half), F.slice(chars, half + 1, F.size(chars) - half)

    def add(part: Column, turn: Column, other: Column) -> Column:
        digest = _hash(key, tweak, turn, F.array_join(other, ""))
        return F.transform(part, lambda c, i: _shifted(c, F.conv(F.substring(digest, i * 8 + 1, 8), 16, 10).cast("long"), sign))

    if sign > 0:
        turns, step = F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda s, t: F.struct(s["r"].alias("l"), add(s["l"], t, s["r"]).alias("r"))
    else:
        turns, step = F.sequence(F.lit(ROUNDS - 1), F.lit(0)), lambda s, t: F.struct(add(s["r"], t, s["l"]).alias("l"), s["l"].alias("r"))
    return F.aggregate(turns, F.struct(left.alias("l"), right.alias("r")), step, lambda s: F.concat(F.array_join(s["l"], ""), F.array_join(s["r"], "")))


def permuted_pieces(text: Column, key: str | Column, tweak: str | Column, sign: int = 1) -> Column:
    """permuted_text of each PIECE characters of a text, the number of a later piece in its tweak."""
    tweak = tweak if isinstance(tweak, Column) else F.lit(tweak)
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / PIECE).cast("int") - 1, F.lit(0)))

    def piece(i: Column) -> Column:
        return permuted_text(F.substr(text, i * PIECE + 1, F.lit(PIECE)), key, F.when(i == 0, tweak).otherwise(F.concat(tweak, i.cast("string"))), sign)

    return F.array_join(F.transform(pieces, piece), "")


def permuted_pair(high: Column, low: Column, many_high, many_low, key: str | Column, tweak: str | Column, sign: int = 1) -> Column:
    """A Feistel network over high * many_low + low, with high below many_high and low below many_low; as one long."""
    many_high, many_low = F.lit(many_high) if isinstance(many_high, int) else many_high, F.lit(many_low) if isinstance(many_low, int) else many_low

    def noise(turn: Column, half: Column, many: Column) -> Column:
        return F.pmod(F.conv(F.substring(_hash(key, tweak, turn, half.cast("string")), 1, 14), 16, 10).cast("long"), many.cast("long"))

    def step(s: Column, t: Column) -> Column:
        even = t % 2 == 0
        moved_high = F.pmod(s["h"] + sign * noise(t, s["l"], many_high), many_high.cast("long"))
        moved_low = F.pmod(s["l"] + sign * noise(t, s["h"], many_low), many_low.cast("long"))
        return F.struct(F.when(even, moved_high).otherwise(s["h"]).alias("h"), F.when(even, s["l"]).otherwise(moved_low).alias("l"))

    turns = F.sequence(F.lit(0), F.lit(ROUNDS - 1)) if sign > 0 else F.sequence(F.lit(ROUNDS - 1), F.lit(0))
    start = F.struct(high.cast("long").alias("h"), low.cast("long").alias("l"))
    return F.aggregate(turns, start, step, lambda s: s["h"] * many_low.cast("long") + s["l"])


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a text of digits, doubling every second one from the last but one."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, at: Column) -> Column:
        value = _digit(digits, at)
        twice = F.when(value > 4, value * 2 - 9).otherwise(value * 2)
        return total + F.when((F.length(digits) - at) % 2 == 1, twice).otherwise(value)

    return F.aggregate(places, F.lit(0), add)


def _bound(value: Column, use) -> Column:
    """use(value), the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _issued(digits: Column) -> Column:
    """Whether the first digits and the number of digits are those of a card issuer."""
    first, size = F.substring(digits, 1, 4).cast("int"), F.length(digits)
    out = F.lit(False)
    for low, high, least, most in ISSUERS:
        out = out | (first.between(low, high) & size.between(least, most))
    return out


def _begins(head: Column) -> Column:
    """Whether four digits begin the cards of an issuer."""
    out = F.lit(False)
    for low, high, _, _ in ISSUERS:
        out = out | head.cast("int").between(low, high)
    return out


def cards(run: Column) -> Column:
    """(s, e): first and last character of the card numbers in a run of digit groups, from the left, of those that begin
    with one group the longest. A card is whole groups, of as many digits as its issuer has, with a right check digit."""
    kind = "array<struct<s:int,e:int>>"

    def within(groups: Column) -> Column:
        def size(i: Column) -> Column:
            """How many groups from the i-th on (from 0) are a card; null if none are. A card has at most 19 groups, and
            only counts of groups with as many digits as cards have are looked at, after an issuer's first digits."""

            def among(few: Column) -> Column:
                def add(state: Column, group: Column) -> Column:
                    total, k = state["total"] + F.length(group), state["k"] + 1
                    ends = F.when(total.between(13, 19), F.concat(state["ends"], F.array(F.struct(k.alias("k"), total.alias("total"))))).otherwise(state["ends"])
                    return F.struct(total.alias("total"), k.alias("k"), ends.alias("ends"))

                start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("k"), F.array().cast("array<struct<k:int,total:int>>").alias("ends"))
                ends = F.reverse(F.aggregate(few, start, add, lambda state: state["ends"]))

                def valid(digits: Column) -> Column:
                    def right(end: Column) -> Column:
                        plain = F.substr(digits, F.lit(1), end["total"])
                        return F.when(_issued(plain), luhn_sum(plain) % 10 == 0).otherwise(F.lit(False))

                    return F.get(F.filter(ends, right), 0)["k"]

                return _bound(F.array_join(few, ""), valid)

            head = F.substring(F.array_join(F.slice(groups, i + 1, F.lit(4)), ""), 1, 4)
            return F.when(_begins(head), _bound(F.slice(groups, i + 1, F.lit(19)), among))

        def step(state: Column, i: Column) -> Column:
            def put(k: Column) -> Column:
                last = state["at"] + F.length(F.array_join(F.slice(groups, i + 1, k), " ")) - 1
                return F.when(k.isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(F.struct(state["at"].alias("s"), last.alias("e")))))

            out = F.when(F.coalesce(F.get(state["out"], F.size(state["out"]) - 1)["e"], F.lit(0)) >= state["at"], state["out"]).otherwise(_bound(size(i), put))
            return F.struct((state["at"] + F.length(F.get(groups, i)) + 1).alias("at"), out.alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), F.struct(F.lit(1).alias("at"), F.array().cast(kind).alias("out")), step, lambda state: state["out"])

    return _bound(F.split(run, "[ -]"), within)


def iban_rest(text: Column) -> Column:
    """The number of an IBAN (no blanks) modulo 97, its first four characters read last."""
    turned = F.concat(F.substr(text, F.lit(5)), F.substring(text, 1, 4))

    def add(total: Column, char: Column) -> Column:
        number = F.ascii(char)
        return F.when(char.between("0", "9"), (total * 10 + number - 48) % 97).otherwise((total * 100 + number - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), add)


def _day_number(value: Column, kind: str) -> Column:
    """The number of the day of a date, counted from FIRST_DAY; null if there is none such."""
    day, month = (1, 4) if kind == "day_date" else (4, 1)
    iso = value if kind == "iso_date" else F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, month, 2), F.substring(value, day, 2))
    return F.datediff(F.to_date(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd"))), F.lit(FIRST_DAY).cast("date"))


def _date(number: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), number.cast("int"))


def permuted_day(number: Column, key: str | Column, sign: int = 1) -> Column:
    """Another day of the same span, as a number."""

    def within(n: Column) -> Column:
        span = F.floor(n / (DAYS_HIGH * DAYS_LOW))
        begin, high, low = span * DAYS_HIGH * DAYS_LOW, F.lit(DAYS_HIGH), F.lit(DAYS_LOW)
        for edge, (b, h, w) in EDGES.items():
            begin, high, low = (F.when(span == edge, x).otherwise(y) for x, y in ((b, begin), (h, high), (w, low)))
        return begin + permuted_pair(F.floor((n - begin) / low), (n - begin) % low, high, low, key, F.concat(F.lit("date"), span.cast("string")), sign)

    return _bound(number, within)


def permuted_late_day(number: Column, key: str | Column, sign: int = 1) -> Column:
    """Another day of the same span among those after the twelfth of a month: permuted until it is one.

    Three days in five are; that 64 turns don't reach one has a probability below 1e-25.
    """

    def turn(n: Column, i: Column) -> Column:
        return F.when((i == 0) | (F.dayofmonth(_date(n)) <= 12), permuted_day(n, key, sign)).otherwise(n)

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), number.cast("long"), turn)


def _octet(value: Column, i: int) -> Column:
    return F.split_part(value, F.lit("."), F.lit(i)).cast("int")


def kind_of(value: Column) -> Column:
    """The name of the form that a candidate has and is valid in, or null."""
    plain = F.regexp_replace(value, "[ -]", "")
    area, group, serial = (F.substring(value, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    valid = {
        "email": F.lit(True),
        "secret": F.lit(True),
        "access_key": F.lit(True),
        "iban": F.length(plain).between(15, 34) & (iban_rest(plain) == 1),
        "phone": digits.between(7, 15),
        "iso_date": _day_number(value, "iso_date").isNotNull(),
        "day_date": _day_number(value, "day_date").isNotNull(),
        "ssn": (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0),
        "ip": F.greatest(*(_octet(value, i) for i in range(1, 5))) < 256,
        "card": F.size(cards(value)) > 0,
    }
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in FORMS.items():
        whole = "^(?:" + pattern + ")$"
        kind = F.when(F.coalesce(valid[name], F.lit(False)), F.lit(name))
        if name == "day_date":
            kind = kind.when(_day_number(value, "month_date").isNotNull(), F.lit("month_date"))
        out = out.when(value.rlike(whole), kind)
    return out


def _kept_head(value: Column, head: str, key: str | Column, tweak: str, sign: int) -> Column:
    """The value with all but what the pattern `head` matches at its start permuted."""
    first = F.regexp_extract(value, head, 0)
    return F.concat(first, permuted_pieces(F.substr(value, F.length(first) + 1), key, tweak, sign))


def _laid(form: Column, plain: Column) -> Column:
    """The characters of plain in place of the letters and digits of form, in order."""

    def put(both: Column) -> Column:
        def char(c: Column, i: Column) -> Column:
            place = F.length(F.regexp_replace(F.substr(both["form"], F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
            return F.when(c.rlike("[0-9A-Za-z]"), F.substr(both["plain"], place, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.split(both["form"], ""), char), "")

    return _bound(F.struct(form.alias("form"), plain.alias("plain")), put)


def _card(value: Column, key: str | Column, sign: int) -> Column:
    """Another card number in the form of one. What tells the issuer stays: the first digit if it is 4, else four."""

    def other(digits: Column) -> Column:
        stay = F.when(F.substring(digits, 1, 1) == "4", 1).otherwise(4)
        return F.concat(F.substr(digits, F.lit(1), stay), permuted_text(F.substr(digits, stay + 1, F.length(digits) - stay - 1), key, "card", sign))

    def checked(body: Column) -> Column:
        return F.concat(body, F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string"))

    return _laid(value, _bound(_bound(F.regexp_replace(value, "[^0-9]", ""), other), checked))


def _phone(value: Column, key: str | Column, sign: int) -> Column:
    """Another phone number in the form of one; with a plus its first two digits stay, else the first."""
    stay = F.when(F.substring(value, 1, 1) == "+", 2).otherwise(1)

    def other(digits: Column) -> Column:
        return F.concat(F.substr(digits, F.lit(1), stay), permuted_text(F.substr(digits, stay + 1), key, "phone", sign))

    return _laid(value, _bound(F.regexp_replace(value, "[^0-9]", ""), other))


def _iban(value: Column, key: str | Column, sign: int) -> Column:
    """Another IBAN of the country, in the form of one."""

    def other(plain: Column) -> Column:
        def checked(account: Column) -> Column:
            country = F.substring(plain, 1, 2)
            return F.concat(country, F.lpad((98 - iban_rest(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0"), account)

        return _bound(permuted_text(F.substr(plain, F.lit(5)), key, "iban", sign), checked)

    return _laid(value, _bound(F.regexp_replace(value, " ", ""), other))


def _with_cards(run: Column, key: str | Column, sign: int) -> Column:
    """A run of digit groups with other card numbers in place of its own."""

    def put(s: Column, x: Column) -> Column:
        return F.struct((x["e"] + 1).alias("at"), F.concat(s["text"], F.substr(run, s["at"], x["s"] - s["at"]), _card(F.substr(run, x["s"], x["e"] - x["s"] + 1), key, sign)).alias("text"))

    return F.aggregate(cards(run), F.struct(F.lit(1).alias("at"), F.lit("").alias("text")), put, lambda s: F.concat(s["text"], F.substr(run, s["at"])))


def pseudonym(value: Column, kind: Column, key: str | Column, sign: int = 1) -> Column:
    """The permuted value of a candidate of that kind; the value itself where kind is null."""
    iso, day = (_date(permuted_day(_day_number(value, k), key, sign)) for k in ("iso_date", "day_date"))
    late = _date(permuted_late_day(_day_number(value, "month_date"), key, sign))
    first_mark, second_mark = F.substring(value, 3, 1), F.substring(value, 6, 1)

    def written(date: Column, first: str, second: str) -> Column:
        return _bound(date, lambda d: F.concat(F.date_format(d, first), first_mark, F.date_format(d, second), second_mark, F.date_format(d, "yyyy")))

    octets = permuted_pair(_octet(value, 1) * 256 + _octet(value, 2), _octet(value, 3) * 256 + _octet(value, 4), 65536, 65536, key, "ip", sign)
    area, group, serial = (F.substring(value, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    low_area = area < 666
    # Areas 1-665 and 667-899 are permuted among themselves.
    areas, base = F.when(low_area, 665).otherwise(233), F.when(low_area, 1).otherwise(667)
    ssn = permuted_pair(area - base, (group - 1) * 9999 + serial - 1, areas, 99 * 9999, key, "ssn", sign)
    rest = ssn % 989901
    name = F.substring_index(value, "@", 1)
    # The domain takes part, so a name of one character isn't moved alike everywhere.
    domain = F.concat(F.lit("email|"), F.lower(F.substring_index(value, "@", -1)))
    return (
        F.when(kind == "email", F.concat(permuted_pieces(name, key, domain, sign), F.substr(value, F.length(name) + 1)))
        .when(kind == "secret", _kept_head(value, "^[A-Za-z_]+\\s{0,3}[=:]\\s{0,3}[\"']?", key, "secret", sign))
        .when(kind == "access_key", _kept_head(value, "^AKIA", key, "access_key", sign))
        .when(kind == "iban", _iban(value, key, sign))
        .when(kind == "phone", _phone(value, key, sign))
        .when(kind == "iso_date", F.date_format(iso, "yyyy-MM-dd"))
        .when(kind == "day_date", written(day, "dd", "MM"))
        .when(kind == "month_date", written(late, "MM", "dd"))
        .when(kind == "ssn", F.format_string("%03d-%02d-%04d", ((ssn / 989901).cast("long") + base), (rest / 9999).cast("long") + 1, rest % 9999 + 1))
        .when(kind == "ip", F.concat_ws(".", *(F.pmod(F.shiftright(octets, 24 - 8 * i), F.lit(256)).cast("string") for i in range(4))))
        .when(kind == "card", _with_cards(value, key, sign))
        .otherwise(value)
    )


def pseudonymised(df: DataFrame, key: str | DataFrame, text_col: str = "text", sign: int = 1) -> DataFrame:
    """df with `text_col` pseudonymised and a column `pii_kinds`, the kinds replaced in order of appearance.

    key: a table of one row and column, such as key_table() gives, which joins as one broadcast row and stands in no plan;
    one without a key is an error. A key given as text stands in the plan, and so in logs: for trials only.

    Whole texts, no shuffle. Null stays null with no kinds; texts without valid values stay as they are; equal values
    become equal pseudonyms; sign -1 restores them, but for a card among other digit groups where by chance these and the
    pseudonym make up another number with a right check digit. Other columns stay, whatever their names; a column pii_kinds is
    replaced.
    """
    shown = [c for c in df.columns if c != "pii_kinds"]
    has = F.col(text_col).rlike("(?i)[0-9]|@|password|passwd|token|secret|api_key")
    found = F.when(has, F.regexp_extract_all(F.col(text_col), F.lit(PATTERN), F.lit(0)))
    rows = df.select(F.struct(*shown).alias("row"), found.alias("found")).select("row", F.filter("found", lambda v: v != "").alias("found"))
    rows = rows.select("row", F.when(F.size("found") > 0, F.col("found")).alias("found"))
    rows = rows.select("row", "found", F.transform("found", kind_of).alias("kinds"))
    if isinstance(key, DataFrame):
        # One row, whatever the table has.
        rows = rows.crossJoin(F.broadcast(key.agg(F.max(key.columns[0]).alias("secret"))))
        key = F.coalesce("secret", F.raise_error(F.lit("there is no key")).cast("string"))
    each = F.zip_with("found", "kinds", lambda v, k: F.when(k.isNull(), F.array().cast("array<string>")).when(k == "card", F.array_repeat(k, F.size(cards(v)))).otherwise(F.array(k)))
    rows = rows.select("row", each.alias("kinds"), F.zip_with("found", "kinds", lambda v, k: pseudonym(v, k, key, sign)).alias("put"))
    between = F.split(F.col("row")[text_col], PATTERN, -1)
    text = F.when(F.col("put").isNull(), F.col("row")[text_col]).otherwise(F.array_join(F.zip_with(between, F.concat("put", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), ""))
    kinds = F.coalesce(F.flatten("kinds"), F.array().cast("array<string>"))
    return rows.select(*(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in shown), kinds.alias("pii_kinds"))


def report(docs: DataFrame, key: str | DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_numbers, n_dates, kinds, text) of the documents in which something was replaced."""
    rows = pseudonymised(docs.select(id_col, text_col), key, text_col).where(F.size("pii_kinds") > 0)
    dates = F.size(F.filter("pii_kinds", lambda k: k.isin(*DATES)))
    return rows.select(id_col, (F.size("pii_kinds") - dates).cast("long").alias("n_numbers"), dates.cast("long").alias("n_dates"), F.array_sort(F.array_distinct("pii_kinds")).alias("kinds"), F.col(text_col).alias("text"))
