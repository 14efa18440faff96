"""Format-preserving pseudonyms: found values are permuted under a key within their own format.

Numbers are validated before they are touched: payment cards by their check digit, IBANs by theirs, IP
addresses by their octets, dates by the calendar, social security numbers by the blocks never issued.
Telephone numbers, mail addresses and secrets behind a naming word are found by form. A secret is replaced
whole, whatever its length; what is neither letter nor digit in it (the points of a JWT) stays in place.

Digits, small and capital letters of a value are permuted each among themselves by a Feistel network:
two halves, in turn, are shifted letter by letter by a keyed hash of the other half. It can be
undone with the key, and equal values get equal pseudonyms in all documents. Cards and IBANs get new
check digits and stay valid, addresses stay dotted quads, and dates are permuted among the days of
``FIRST_DAY`` and the ``DAYS`` that follow. Country codes of telephones and IBANs, and what follows the
``@`` of a mail address, are kept.

The key is part of the query plan: sessions that publish plans should set
``spark.sql.redaction.string.regex``.

Results on edge cases: a null text stays null with no findings; an empty text stays empty; numbers that
fail their check stay as they are; equal rows get equal results; an empty table gives an empty result;
other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrail.llm.text_native import let, once

DEFAULT_KEY = "change-me"
ROUNDS = 8
FIRST_DAY = "1900-01-01"
#: Days that dates are permuted among, as a product of two numbers of like size.
DAY_BLOCKS, DAYS_A_BLOCK = 250, 292
DAYS = DAY_BLOCKS * DAYS_A_BLOCK

_DATE = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}"
_CARD = r"\d{13,19}|\d{4}( \d{4}){3}|\d{4}(-\d{4}){3}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5}"
_PHONE = r"\+\d{1,3}[ .-]?(\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}"
_MAIL = r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,24})"
_IBAN = r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}|[A-Z]{2}\d{2}( [A-Z0-9]{4}){2,7}( [A-Z0-9]{1,3})?"
_IP = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
_SSN = r"\d{3}-\d{2}-\d{4}"
#: Names of secrets: the words alone or at the end of a longer name; ``key`` needs a break or a change of case before it.
_NAMING = r"(?:(?i:token|secret|password|api_?key)|(?<![A-Za-z])(?i:key)|(?<=[a-z])K(?:ey|EY))"
#: Its value is the pattern's first group and runs on as far as keys and tokens do.
_SECRET = rf"(?<={_NAMING}[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?)([A-Za-z0-9_.+/=-]{{16,}}+)"

#: Kinds in the order they are tried, each with its form.
KINDS = {
    "email": _MAIL, "date": _DATE, "ip": _IP, "phone": _PHONE, "ssn": _SSN, "iban": _IBAN, "card": _CARD,
}
PATTERN = "|".join(
    [
        _SECRET,
        rf"(?<![A-Za-z0-9._%+-]){_MAIL}",
        rf"(?<![\d/.-])({_DATE})(?![\d/-])",
        rf"(?<![\d.])({_IP})(?!\d|\.\d)",
        rf"(?<![\w+-])({_PHONE})(?!\d)",
        rf"(?<![\w-])({_SSN})(?![\d-])",
        rf"(?<!\w)({_IBAN})(?!\w)",
        rf"(?<![\w.-])({_CARD})(?![\w-])",
    ]
)


def _keyed(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 512)


def _number(hexes: Column) -> Column:
    return F.conv(hexes, 16, 10).cast("int")


def feistel(text: Column, alphabet_from: int, radix: int, key: str, kind: Column | str) -> Column:
    """Permute the strings of one length over ``radix`` letters from ``alphabet_from`` on."""
    kind = F.lit(kind) if isinstance(kind, str) else kind

    def shifted(half: Column, other: Column, n_round: Column) -> Column:
        stream = _keyed(key, kind, n_round.cast("string"), F.length(half).cast("string"), other)

        def letter(s: Column, c: Column, i: Column) -> Column:
            step = _number(F.substr(s, (i % 64) * 2 + 1, F.lit(2)))
            return F.char((F.ascii(c) - alphabet_from + step) % radix + alphabet_from)

        def block(s: Column, b: Column) -> Column:
            """64 letters; later blocks have streams of their own, so that none shares its shifts with another."""
            own = F.when(b == 0, s).otherwise(F.sha2(F.concat_ws("\x1f", s, b.cast("string")), 512))
            cut = F.split(F.substr(half, b * 64 + 1, F.lit(64)), "(?<=.)(?=.)")
            return let(own, lambda o: F.array_join(F.transform(cut, lambda c, i: letter(o, c, i)), ""))

        blocks = F.sequence(F.lit(0), F.floor((F.length(half) - 1) / 64).cast("int"))
        letters = let(stream, lambda s: F.array_join(F.transform(blocks, lambda b: block(s, b)), ""))
        return F.when(F.length(half) > 0, letters).otherwise(F.lit(""))

    def a_round(a: Column, r: Column) -> Column:
        left, right = a["left"], a["right"]
        return F.when(
            r % 2 == 0, F.struct(shifted(left, right, r).alias("left"), right.alias("right"))
        ).otherwise(F.struct(left.alias("left"), shifted(right, left, r).alias("right")))

    cut = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(
        F.substr(text, F.lit(1), cut).alias("left"), F.substr(text, cut + 1, F.length(text)).alias("right")
    )
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, a_round, lambda a: F.concat(a["left"], a["right"])
    )


def _only(text: Column, letters: str) -> Column:
    return F.regexp_replace(text, f"[^{letters}]", "")


def _refill(form: Column, digits: Column, small: Column, capital: Column) -> Column:
    """``form`` with its digits, small and capital letters replaced in order."""
    letters = F.split(form, "(?<=.)(?=.)")

    def placed(pattern: str, new: Column | None) -> Column:
        at = F.filter(F.transform(letters, lambda c, i: F.struct(i.alias("at"), c.alias("c"))), lambda x: x["c"].rlike(pattern))
        if new is None:
            return at
        own = F.split(new, "(?<=.)(?=.)")
        return let(own, lambda o: F.transform(
            at, lambda x, k: F.struct(x["at"].alias("at"), F.coalesce(F.get(o, k), F.lit("")).alias("c"))))

    whole = F.concat(
        placed("[0-9]", digits), placed("[a-z]", small), placed("[A-Z]", capital), placed("[^0-9a-zA-Z]", None)
    )
    out = F.array_join(F.transform(F.sort_array(whole), lambda x: x["c"]), "")
    return F.when(F.length(form) > 0, out).otherwise(form)


def _classes(form: Column, key: str, kind: str, radix: int = 26) -> Column:
    """Digits, small and capital letters, each permuted among themselves."""
    return _refill(
        form,
        feistel(_only(form, "0-9"), 48, 10, key, kind),
        feistel(_only(form, "a-z"), 97, radix, key, kind),
        feistel(_only(form, "A-Z"), 65, radix, key, kind),
    )


def _card(value: Column, key: str) -> Column:
    """All digits but the last are permuted; the last makes the check come out."""
    payload = F.regexp_replace(_only(value, "0-9"), ".$", "")

    def with_check(p: Column) -> Column:
        def add(a: Column, i: Column) -> Column:
            d = F.substr(F.reverse(p), i, F.lit(1)).cast("int")
            twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
            return a + F.when(i % 2 == 1, twice).otherwise(d)

        total = F.aggregate(F.sequence(F.lit(1), F.length(p)), F.lit(0), add)
        return F.concat(p, ((F.lit(10) - total % 10) % 10).cast("string"))

    digits = let(feistel(payload, 48, 10, key, "card"), with_check)
    return _refill(value, digits, F.lit(""), F.lit(""))


def _mod97(text: Column) -> Column:
    """Of the number that digits and capital letters (as 10 to 35) spell."""

    def add(a: Column, i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise(
            (a * 100 + F.ascii(c) - 55) % 97
        )

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def _compact(value: Column) -> Column:
    return F.regexp_replace(value, " ", "")


def _iban_valid(value: Column) -> Column:
    c = _compact(value)
    return _mod97(F.concat(F.substr(c, F.lit(5), F.length(c)), F.substr(c, F.lit(1), F.lit(4)))) == 1


def _iban(value: Column, key: str) -> Column:
    c = _compact(value)
    country = F.substr(c, F.lit(1), F.lit(2))

    def with_check(account: Column) -> Column:
        check = F.lpad((F.lit(98) - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
        whole = F.concat(country, check, account)
        return _refill(value, _only(whole, "0-9"), F.lit(""), _only(whole, "A-Z"))

    return let(_classes(F.substr(c, F.lit(5), F.length(c)), key, "iban"), with_check)


def _mixed(value: Column, low: int, key: str, kind: str) -> Column:
    """Permute numbers below ``high * low``, split into two digits of these radices."""
    high = {256 * 256: 256 * 256, DAYS_A_BLOCK: DAY_BLOCKS}[low]

    def a_round(a: Column, r: Column) -> Column:
        left, right = a["left"], a["right"]

        def step(other: Column) -> Column:
            return _number(F.substr(_keyed(key, F.lit(kind), r.cast("string"), other.cast("string")), F.lit(1), F.lit(7)))

        return F.when(
            r % 2 == 0, F.struct(((left + step(right)) % high).alias("left"), right.alias("right"))
        ).otherwise(F.struct(left.alias("left"), ((right + step(left)) % low).alias("right")))

    start = F.struct(
        F.floor(value / low).cast("int").alias("left"), (value % low).cast("int").alias("right")
    )
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, a_round,
        lambda a: a["left"].cast("long") * low + a["right"],
    )


def _octets(value: Column) -> Column:
    return F.transform(F.split(value, "\\."), lambda o: o.cast("int"))


def _ip(value: Column, key: str) -> Column:
    number = F.aggregate(_octets(value), F.lit(0).cast("long"), lambda a, o: a * 256 + o)

    def quad(n: Column) -> Column:
        return F.concat_ws(".", *[F.shiftright(n, 8 * k).bitwiseAND(255).cast("string") for k in (3, 2, 1, 0)])

    return let(_mixed(number, 256 * 256, key, "ip"), quad)


def _day(value: Column) -> Column:
    """Days from the first day; null for what no calendar has."""
    year = F.regexp_extract(value, r"\d{4}", 0)
    iso = F.when(value.contains("-"), value).otherwise(
        F.concat_ws("-", year, F.substr(value, F.lit(4), F.lit(2)), F.substr(value, F.lit(1), F.lit(2)))
    )
    return F.datediff(iso.try_cast("date"), F.lit(FIRST_DAY).cast("date"))


def _date(value: Column, key: str) -> Column:
    day = _mixed(_day(value), DAYS_A_BLOCK, key, "date").cast("int")
    return let(
        F.date_add(F.lit(FIRST_DAY).cast("date"), day),
        lambda d: F.when(value.contains("-"), F.date_format(d, "yyyy-MM-dd"))
        .when(value.contains("/"), F.date_format(d, "dd/MM/yyyy"))
        .otherwise(F.date_format(d, "dd.MM.yyyy")),
    )


def _ssn_valid(value: Column) -> Column:
    return value.rlike(r"^(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$")


def kind_of(value: Column, named: Column) -> Column:
    """The kind of a found value, null if it fails its check; ``named``: a naming word stood before it."""
    is_a = {k: value.rlike(f"^({p})$") for k, p in KINDS.items()}
    day = _day(value)
    return (
        F.when(named, F.lit("secret"))
        .when(is_a["email"], F.lit("email"))
        .when(is_a["date"], F.when((day >= 0) & (day < DAYS), F.lit("date")))
        .when(is_a["ip"], F.when(F.forall(_octets(value), lambda o: o <= 255), F.lit("ip")))
        .when(is_a["ssn"], F.when(_ssn_valid(value), F.lit("ssn")))
        .when(is_a["iban"] & _iban_valid(value), F.lit("iban"))
        .when(is_a["card"], F.when(F.call_function("luhn_check", _only(value, "0-9")), F.lit("card")))
        .when(is_a["phone"], F.lit("phone"))
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    at = F.instr(value, "@")
    country = F.regexp_extract(value, r"^\+\d{1,3}", 0)
    hexes = value.rlike("^([0-9a-f]+|[0-9A-F]+)$")
    return (
        F.when(kind == "email", F.concat(
            _classes(F.substr(value, F.lit(1), at - 1), key, "email"), F.substr(value, at, F.length(value))))
        .when(kind == "date", _date(value, key))
        .when(kind == "ip", _ip(value, key))
        .when(kind == "phone", F.concat(
            country, _classes(F.substr(value, F.length(country) + 1, F.length(value)), key, "phone")))
        .when(kind == "ssn", _classes(value, key, "ssn"))
        .when(kind == "iban", _iban(value, key))
        .when(kind == "card", _card(value, key))
        .when((kind == "secret") & hexes, _classes(value, key, "secret", 6))
        .when(kind == "secret", _classes(value, key, "secret"))
        .otherwise(value)
    )


def pseudonymize(docs: DataFrame, key: str = DEFAULT_KEY, text: str = "text") -> DataFrame:
    """The rows with ``text`` pseudonymized and ``findings``: an array of kind and pseudonym per value found."""
    if not key:
        raise ValueError("a key is needed")
    own = [c for c in docs.columns if c != "findings"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(f"`{text}`").alias("body"))
    body = F.col("body")
    hit = F.coalesce(body.rlike("[0-9@]|(?i:token|secret|password|key)"), F.lit(False))
    no_texts = F.array().cast("array<string>")
    df = once(rows, _p_found=F.when(hit, F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0))).otherwise(no_texts))
    some = F.size("_p_found") > 0
    secrets = F.when(some, F.regexp_extract_all(body, F.lit(PATTERN), F.lit(1))).otherwise(no_texts)
    df = once(df, _p_secret=secrets)
    new = F.transform(
        "_p_found",
        lambda v, i: let(
            kind_of(v, F.get("_p_secret", i) != ""),
            lambda k: F.struct(k.alias("kind"), pseudonym(v, k, key).alias("value")),
        ),
    )
    none = F.array().cast("array<struct<kind:string,value:string>>")
    df = once(df, _p_new=F.when(some, new).otherwise(none))
    between = F.split(body, PATTERN, -1)
    rebuilt = F.array_join(
        F.zip_with(between, "_p_new", lambda p, n: F.concat(p, F.coalesce(n["value"], F.lit("")))), ""
    )
    return df.select(
        *[
            F.when(F.size("_p_new") > 0, rebuilt).otherwise(body).alias(c) if c == text else F.col("row").getField(c).alias(c)
            for c in own
        ],
        F.filter("_p_new", lambda n: n["kind"].isNotNull()).alias("findings"),
    )
