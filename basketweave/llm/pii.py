"""Format-preserving pseudonyms for personal numbers, dates and addresses, by keyed Feistel permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

ROUNDS = 8
#: Dates from 1900-01-01 on for this many days (250 x 292: to 2099-11-13) are personal dates and map to each other.
DATE_PARTS = (250, 292)

# What may be personal data, by shape (Java syntax); ``_kind`` then validates each match.
# A host has at most 127 labels; the bound also keeps the matcher's stack small on any text.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]++\.){1,127}[A-Za-z]{2,}"
IPV4 = r"(?:\d{1,3}\.){3}\d{1,3}(?![\w-]|\.\d)"
DATE = r"(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([/.])\d{2}\2\d{4})(?![\w-]|[/.]\d)"
SSN = r"\d{3}-\d{2}-\d{4}(?![\w-])"
CARD = r"\d(?:[ -]?\d){12,18}(?![\w-])"
PHONE = r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])|\+\d{11,15}(?!\w)"
# Groups of digits in a row, 13 digits or more unless something else begins inside. What they hold is decided by ``_parts``.
ELSE = rf"{EMAIL}|{IPV4}|\d{{4}}([/.])\d{{2}}\3\d{{2}}(?!\w)|\d{{2}}([/.])\d{{2}}\4\d{{4}}(?!\w)|\d{{3}}[ .-]\d{{3}}\.\d{{4}}(?!\w)|\d{{3}}\.\d{{3}}[ -]\d{{4}}(?!\w)"
GROUP = r"\d++(?!\w|-(?!\d))"
RUN = rf"(?=\d(?:[ -]?\d){{12}}){GROUP}(?:[ -](?!{ELSE}){GROUP})*+(?!-\d*+\w)"
SHAPES = rf"(?<![A-Za-z0-9._%+-])(?:{EMAIL}|{IPV4}|{DATE}|{SSN}|{RUN}|{PHONE})"
#: How cards are mostly grouped; four by four and more, which may be a card and its check number; groups of three digits or more.
USUAL = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5}|\d{4}([ -])\d{4}\3\d{4}\3\d|\d{4}([ -])\d{3}\4\d{3}\4\d{3})$"
LONGER = r"^\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}[ -]"
WIDE = r"^\d{3,}+(?:[ -]\d{3,}+)*+$"
#: Most digits of a value inside a run.
MOST_DIGITS = 19
# Beginnings and lengths of issued card numbers.
ISSUED = r"^(?:4\d{12}(?:\d{3}){0,2}|5[1-5]\d{14}|2[2-7]\d{14}|3[47]\d{13}|3[0689]\d{12,17}|35\d{14,17}|6\d{15,18})$"
#: Other groups that may stand in one row with a value that only its digits tell (a check number, a date); more make a table.
BESIDE = 2

KINDS = ("email", "ip", "date", "ssn", "card", "phone")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _chars(s: Column, f) -> Column:
    """``f(character, 1-based position)`` of each character, joined; '' stays ''."""
    at = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(at, lambda i: f(s.substr(i, F.lit(1)), i)), "")


def _shift(s: Column, stream: Column) -> Column:
    """Move each digit or ASCII letter on within its class, by two hexadecimal digits of ``stream``."""

    def one(c: Column, i: Column) -> Column:
        k = F.conv(stream.substr((i * 2 - 2) % 128 + 1, F.lit(2)), 16, 10).cast("int")
        moved = lambda first, n: F.char(F.lit(first) + (F.ascii(c) - first + k) % n)
        return (
            F.when(c.between("0", "9"), moved(48, 10)).when(c.between("a", "z"), moved(97, 26)).when(c.between("A", "Z"), moved(65, 26)).otherwise(c)
        )

    return _chars(s, one)


def permute_text(s: Column, key: str) -> Column:
    """A keyed permutation of the strings that have the classes of ``s`` (digit, small, capital) at each place.

    A Feistel network: the half that moves is shifted by a keyed hash of the other half, ``ROUNDS`` times.
    """
    half = (F.length(s) / 2).cast("int")
    start = F.struct(s.substr(F.lit(1), half).alias("a"), s.substr(half + 1, F.length(s)).alias("b"))

    def step(x: Column, r: Column) -> Column:
        stream = F.sha2(F.concat(F.lit(f"{key}|text|"), r.cast("string"), F.lit("|"), x["b"]), 512)
        return F.struct(x["b"].alias("a"), _shift(x["a"], stream).alias("b"))

    rounds = F.array(*[F.lit(r) for r in range(ROUNDS)])
    return F.aggregate(rounds, start, step, lambda x: F.concat(x["a"], x["b"]))


def permute_pair(a: Column, b: Column, size_a: int, size_b: int, key: str) -> Column:
    """A keyed permutation of the pairs below (size_a, size_b), as a struct a, b: Feistel by modular addition."""

    def step(x: Column, r: Column) -> Column:
        def keyed(v: Column) -> Column:
            return F.conv(F.substring(F.md5(F.concat(F.lit(f"{key}|{size_a}|"), r.cast("string"), F.lit("|"), v.cast("string"))), 1, 12), 16, 10).cast("long")

        even = r % 2 == 0
        return F.struct(
            F.when(even, (x["a"] + keyed(x["b"])) % size_a).otherwise(x["a"]).alias("a"),
            F.when(even, x["b"]).otherwise((x["b"] + keyed(x["a"])) % size_b).alias("b"),
        )

    rounds = F.array(*[F.lit(r) for r in range(ROUNDS)])
    return F.aggregate(rounds, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def luhn_sum(digits: Column, first_doubled: bool) -> Column:
    """Sum of the digits from the right, every second one doubled; doubling starts at the last if ``first_doubled``."""
    n = F.length(digits)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(n + 1 - i, F.lit(1)).cast("int")
        return total + F.when((i % 2 == 1) == F.lit(first_doubled), d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(at, F.lit(0), add)


def _part(s: Column, sep: str, i: int) -> Column:
    return F.split(s, sep)[i].cast("int")


def _date(raw: Column) -> Column:
    """The date of a match: yyyy-mm-dd with any of - / ., else dd.mm.yyyy, mm/dd/yyyy, or dd/mm/yyyy where that month is above 12."""
    plain = F.regexp_replace(raw, "[/.]", "-")
    first_year = raw.rlike(r"^\d{4}\D")
    month_first = raw.contains("/") & (F.substring(raw, 1, 2) <= "12")
    turned = F.when(month_first, F.concat(F.substring(raw, 7, 4), F.lit("-"), F.substring(plain, 1, 5)))
    turned = turned.otherwise(F.concat(F.substring(raw, 7, 4), F.lit("-"), F.substring(raw, 4, 2), F.lit("-"), F.substring(raw, 1, 2)))
    return F.try_to_date(F.when(first_year, plain).otherwise(turned), "yyyy-MM-dd")


def _day(raw: Column) -> Column:
    return F.datediff(_date(raw), F.lit("1900-01-01").cast("date"))


def _kind(raw: Column, digits: Column) -> Column:
    """The first kind for which the match is valid; null where it is none."""
    full = lambda p: raw.rlike(f"^(?:{p})$")
    octets = F.forall(F.split(raw, r"\."), lambda o: o.cast("int") <= 255)
    ssn = (digits.substr(1, 3) != "000") & (digits.substr(1, 3) != "666") & (digits.substr(1, 3) < "900")
    ssn = ssn & (digits.substr(4, 2) != "00") & (digits.substr(6, 4) != "0000")
    return (
        F.when(full(EMAIL), "email")
        .when(full(IPV4), F.when(octets, "ip"))
        .when(full(DATE), F.when(_day(raw).between(0, DATE_PARTS[0] * DATE_PARTS[1] - 1), "date"))
        .when(full(SSN), F.when(ssn, "ssn"))
        .when(full(CARD) & (luhn_sum(digits, False) % 10 == 0) & digits.rlike("[1-9]"), "card")
        .when(full(PHONE), "phone")
    )


def _parts(run: Column) -> Column:
    """The run of digit groups in parts (raw, digits, kind), in order; those without kind stay as they are.

    Every stretch of whole groups is tried, so a valid value is found whatever numbers stand beside it. Where valid
    stretches overlap, these go first: cards in their usual groups (first those of 16 digits or fewer groups that begin with 3 to 6), the run as
    a whole, other kinds, cards in groups of three digits or more, cards in any groups at an end of the run. Beside more than
    ``BESIDE`` other groups the row is taken for a table of numbers: cards there need their usual groups and an issuer's
    beginning and length, and blanks alone make no telephone number.
    """
    groups = F.regexp_extract_all(run, F.lit(r"[ -]?\d+"), F.lit(0))
    none = "array<struct<rank:int,start:int,size:int,raw:string,digits:string,kind:string>>"

    def stretches(g: Column) -> Column:
        n = F.size(g)

        def tried(i: Column) -> Column:
            most = F.least(n - i + 1, F.lit(MOST_DIGITS))
            return F.transform(F.sequence(F.lit(1), most), lambda k: F.struct(i.alias("start"), k.alias("size"), F.array_join(F.slice(g, i, k), "").alias("text")))

        bare = lambda x: F.regexp_replace(x["text"], "^[ -]", "")
        each = F.flatten(F.transform(F.sequence(F.lit(1), n), tried))
        each = F.transform(each, lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size"), bare(x).alias("raw"), _digits(x["text"]).alias("digits")))
        each = F.filter(each, lambda x: F.length(x["digits"]).between(8, MOST_DIGITS))
        each = F.transform(each, lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size"), x["raw"].alias("raw"), x["digits"].alias("digits"), _kind(x["raw"], x["digits"]).alias("kind")))
        each = F.filter(each, lambda x: x["kind"].isNotNull())

        def rank(x: Column) -> Column:
            usual, whole = x["raw"].rlike(USUAL), x["size"] == n
            at_end = (x["start"] == 1) | (x["start"] + x["size"] - 1 == n)
            few, issued = n - x["size"] <= BESIDE, x["digits"].rlike(ISSUED)
            card = F.when(usual & x["digits"].rlike("^[3-6]") & ~x["raw"].rlike(LONGER) & (few | issued), 0).when(usual & (few | issued), 1).when(whole, 2)
            card = card.when(few & issued & x["raw"].rlike(WIDE), 4).when(few & issued & at_end, 5)
            table = ~few & x["raw"].rlike("^[0-9 ]+$")
            return F.when(x["kind"] == "card", card).when(whole, 2).when(~table, 3)

        # Longest first among those of one rank and start.
        ranked = F.transform(each, lambda x: F.struct(rank(x).alias("rank"), x["start"].alias("start"), (-x["size"]).alias("size"), x["raw"].alias("raw"), x["digits"].alias("digits"), x["kind"].alias("kind")))
        return F.array_sort(F.filter(ranked, lambda x: x["rank"].isNotNull())).cast(none)

    def chosen(g: Column) -> Column:
        apart = lambda a, b: (a["start"] >= b["start"] - b["size"]) | (b["start"] >= a["start"] - a["size"])
        best = F.aggregate(stretches(g), F.array().cast(none), lambda got, x: F.when(F.forall(got, lambda y: apart(x, y)), F.concat(got, F.array(x))).otherwise(got))
        return F.transform(F.array(best), lambda b: pieces(g, b))[0]

    def pieces(g: Column, best: Column) -> Column:
        """Each group that no value covers, and each value where it begins, with the separator before it on its own."""

        def at(i: Column) -> Column:
            text = g[i - 1]
            lead = F.struct(F.regexp_extract(text, "^[ -]?", 0).alias("raw"), F.lit("").alias("digits"), F.lit(None).cast("string").alias("kind"))
            plain = F.struct(text.alias("raw"), F.lit("").alias("digits"), F.lit(None).cast("string").alias("kind"))
            here = F.filter(best, lambda y: (y["start"] <= i) & (i < y["start"] - y["size"]))
            value = F.struct(here[0]["raw"].alias("raw"), here[0]["digits"].alias("digits"), here[0]["kind"].alias("kind"))
            return F.when(F.size(here) == 0, F.array(plain)).when(here[0]["start"] == i, F.array(lead, value)).otherwise(F.array().cast("array<struct<raw:string,digits:string,kind:string>>"))

        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(g)), at))

    return F.transform(F.array(groups), chosen)[0]


def _refill(raw: Column, digits: Column) -> Column:
    """``raw`` with its digits replaced, in order, by ``digits``."""
    place = lambda i: F.length(_digits(raw.substr(F.lit(1), i)))
    return _chars(raw, lambda c, i: F.when(c.between("0", "9"), digits.substr(place(i), F.lit(1))).otherwise(c))


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def _pseudonym(x: Column, key: str) -> Column:
    raw, digits = x["raw"], x["digits"]
    local = F.substring_index(raw, "@", 1)
    email = F.concat(permute_text(local, key), raw.substr(F.length(local) + 1, F.length(raw)))

    high, low = _part(raw, r"\.", 0) * 256 + _part(raw, r"\.", 1), _part(raw, r"\.", 2) * 256 + _part(raw, r"\.", 3)
    ip = F.transform(
        F.array(permute_pair(high, low, 65536, 65536, key)),
        lambda p: F.concat_ws(".", *[F.shiftright(p[h], s).bitwiseAND(255).cast("string") for h in "ab" for s in (8, 0)]),
    )[0]

    parts = permute_pair((_day(raw) / DATE_PARTS[1]).cast("long"), _day(raw) % DATE_PARTS[1], *DATE_PARTS, key)
    new_day = F.transform(F.array(parts), lambda p: F.date_add(F.lit("1900-01-01").cast("date"), (p["a"] * DATE_PARTS[1] + p["b"]).cast("int")))
    sep = F.regexp_extract(raw, r"\D", 0)
    y, m, d = (lambda v: F.year(v).cast("string")), (lambda v: _two(F.month(v))), (lambda v: _two(F.dayofmonth(v)))
    month_first = raw.contains("/") & (F.substring(raw, 1, 2) <= "12")
    date = F.transform(
        new_day,
        lambda v: F.when(raw.rlike(r"^\d{4}\D"), F.concat(y(v), sep, m(v), sep, d(v)))
        .when(month_first, F.concat(m(v), sep, d(v), sep, y(v)))
        .otherwise(F.concat(d(v), sep, m(v), sep, y(v))),
    )[0]

    # 898 areas (1 to 899 without 666), 99 groups, 9999 serial numbers.
    area = digits.substr(1, 3).cast("int")
    rest = (digits.substr(4, 2).cast("int") - 1) * 9999 + digits.substr(6, 4).cast("int") - 1
    ssn = F.transform(
        F.array(permute_pair(area - F.when(area > 666, 2).otherwise(1), rest, 898, 99 * 9999, key)),
        lambda p: F.concat(
            F.lpad((p["a"] + F.when(p["a"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
            F.lit("-"),
            _two((p["b"] / 9999).cast("int") + 1),
            F.lit("-"),
            F.lpad((p["b"] % 9999 + 1).cast("string"), 4, "0"),
        ),
    )[0]

    payload = F.transform(F.array(permute_text(digits.substr(F.lit(1), F.length(digits) - 1), key)), lambda p: F.concat(p, ((10 - luhn_sum(p, True) % 10) % 10).cast("string")))[0]
    card = F.transform(F.array(payload), lambda n: _refill(raw, n))[0]

    code = F.length(digits) - 10  # digits of the country code stay
    number = F.concat(digits.substr(F.lit(1), code), permute_text(digits.substr(code + 1, F.lit(10)), key))
    phone = F.transform(F.array(number), lambda n: _refill(raw, n))[0]

    out = {"email": email, "ip": ip, "date": date, "ssn": ssn, "card": card, "phone": phone}
    chain = F.when(x["kind"].isNull(), raw)
    for kind, value in out.items():
        chain = chain.when(x["kind"] == kind, value)
    return chain


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text with pseudonyms, and the number replaced of each kind (n_email, ...).

    E-mail addresses (their local part), IPv4 addresses, dates, social security numbers, Luhn-valid card numbers
    and telephone numbers are replaced by values of the same format, the same everywhere for one key, so equal
    values stay linked. Numbers that fail their check (Luhn, octets, calendar) stay as they are; digit
    groups beside each other are tried in all stretches, so a valid value is found next to other numbers. Each row is
    handled alone: nothing is shuffled, and a frequent value costs no more than others. A null text counts as
    empty; an empty table gives no rows. The key is a secret that the caller passes.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    # The array of matches is cut off from the text in steps, so that each expression is evaluated once per match.
    found = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(SHAPES), F.lit(0))).otherwise(F.array().cast("array<string>"))
    split = F.transform(found, lambda m: F.struct(m.alias("raw"), _digits(m).alias("digits")))
    # Runs that aren't valid as they stand are cut in parts; all else is one part.
    whole = lambda x: F.array(F.struct(x["raw"].alias("raw"), x["digits"].alias("digits"), _kind(x["raw"], x["digits"]).alias("kind")))
    mixed = lambda x: x["raw"].rlike(r"^[\d -]++$") & x["raw"].rlike("[ -]") & (F.length(x["digits"]) > 10) & ~(x["raw"].rlike(USUAL) & (luhn_sum(x["digits"], False) % 10 == 0))
    kinds = F.transform(split, lambda x: F.when(mixed(x), _parts(x["raw"])).otherwise(whole(x)))
    done = F.transform(kinds, lambda parts: F.transform(parts, lambda x: F.struct(x["kind"].alias("kind"), _pseudonym(x, key).alias("new"))))
    rows = rows.withColumn("places", done).withColumn("found", F.flatten("places"))
    gaps = F.split("text", SHAPES, -1)
    filled = lambda g, parts: F.concat(g, F.coalesce(F.array_join(F.transform(parts, lambda x: x["new"]), ""), F.lit("")))
    joined = F.array_join(F.zip_with(gaps, F.col("places"), filled), "")
    return rows.select(
        "doc_id",
        F.when(F.size("found") == 0, F.col("text")).otherwise(joined).alias("text"),
        *[_count(k).alias(f"n_{k}") for k in KINDS],
    )
