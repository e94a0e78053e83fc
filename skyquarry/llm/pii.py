"""Personal data replaced by format-preserving Feistel pseudonyms, in DataFrame operations alone.

One pattern finds candidates; each is validated for its kind and then permuted by a keyed Feistel network within its format, so
equal values get equal pseudonyms in all documents, and a holder of the key can undo each (`pseudonym` with inverse):

- email: letters and digits of the local part, each within its class (digit, lower case, upper case; others: the letters and numbers of its 64 code points of
  Unicode); the domain stays;
- phone: the ten digits after the country code of a North American number, all digits after the country code of one that begins with a plus sign and
  has 8 to 15 digits (without a separator behind it, the code is taken as two digits); separators stay;
- ip: an IPv4 address whose four numbers are at most 255, on its 32 bits;
- date: a valid yyyy-mm-dd or yyyy/mm/dd of 1900-01-01 to 2100-01-02, on the number of its day (73,051 = 319 * 229 of them); also with the day first
  (dd/mm/yyyy, dd.mm.yyyy, dd-mm-yyyy), or, where that is no date, the month. Those with the month first stay recognisable as such: days 13 to 28 on month
  and day of 1900 to 2099, later days on the year alone;
- iban: an account number of a country in `IBAN_LENGTHS` with right check digits, in one piece or with single blanks; letters and digits after the check digits are
  permuted within their class, and these are computed anew;
- ssn: ddd-dd-dddd with a valid area, group and serial number, on its digits;
- card: 13 to 19 digits with a right Luhn check digit; the digits before it are permuted and it is computed anew. In a run of numbers
  parted by single blanks or hyphens, any whole numbers in a row can be one: those in an issuer's form come first, then from left to right, the longest first;
- secret: 32 or more hexadecimal digits in one case, within that alphabet; those of 192 or more in pieces of 128, each with its place in the key.

Candidates that fail validation stay as they are. Round values come from SHA-256 of key, kind, round and the other half.

Defined results: a null text stays null, an empty one empty; each input row gives one row; all other columns pass through
unchanged, except that columns with the names of the added ones are replaced.
"""

from __future__ import annotations

import warnings
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh

KINDS = ("email", "phone", "ip", "date", "ssn", "iban", "card", "secret")
ROUNDS = 8
#: Fixed patterns, one for each kind.
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,9}\.[A-Za-z]{2,24}"
_PHONE = r"(?<![\d+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])"
_IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
_DATE = r"(?<![\d/-])(?:19|20|21)\d\d([-/])\d\d\1\d\d(?![\d/-])"
_TURNED = r"(?<![\d/.-])\d\d([/.-])\d\d\1(?:19|20)\d\d(?![\d/-]|\.\d)"
_ABROAD = r"(?<![\w+])\+[1-9]\d{0,2}(?:[ .-]?\(?\d{2,5}\)?){2,5}(?!\d)"
# The lengths of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24,
    "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _iban() -> str:
    by_length = defaultdict(list)
    for country, n in IBAN_LENGTHS.items():
        by_length[n].append(country)
    forms = "|".join(f"(?:{'|'.join(c)})\\d\\d(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by_length.items()))
    return f"(?<![0-9A-Za-z])(?:{forms})(?![0-9A-Za-z])"


_IBAN = _iban()
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])"
_OTHERS = "|".join(f"(?:{p})" for p in (_EMAIL, _IBAN, _PHONE, _ABROAD, _IP, _DATE.replace(r"([-/])\d\d\1", r"(?:-\d\d-|/\d\d/)"), _TURNED.replace(r"([/.-])\d\d\1", r"(?:/\d\d/|\.\d\d\.|-\d\d-)"), _SSN, _SECRET))
#: Numbers in a row with 13 digits or more, as far as no value of another kind begins. Possessive, so that a long run takes no stack.
_RUN = rf"(?<!\d)(?=\d(?:[ -]?\d){{12}})\d++(?:[ -](?!{_OTHERS})\d++)*+"
PATTERN = f"{_OTHERS}|(?:{_RUN})"
#: Forms of issuers: first digits and lengths.
_ISSUED = r"^(?:4\d{12}(?:\d{3}){0,2}|(?:5[1-5]|2[2-7]|35)\d{14}|3[47]\d{13}|3(?:0[0-5]|[689]\d)\d{11}|6\d{15,18})$"
#: Without one of these no kind can occur.
_HINT = r"[0-9@]|[a-fA-F]{32}"


def session_key(spark: SparkSession) -> str:
    """The key in the session's setting spark.skyquarry.pii.key. Without it a known one, which protects nothing: for trials and tests."""
    found = spark.conf.get("spark.skyquarry.pii.key", None)
    if not found:
        warnings.warn("spark.skyquarry.pii.key is not set: the pseudonyms are made with a public key", stacklevel=2)
    return found or "public trial key"


def _noise(key: str, kind: str | Column, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind if isinstance(kind, Column) else F.lit(kind), turn.cast("string"), half), 256)


def _number(noise: Column) -> Column:
    return F.conv(F.substring(noise, 1, 12), 16, 10).cast("long")


def _other(c: Column, by: Column) -> Column:
    """A letter or number outside ASCII moved among those of its 64 code points; any other character as it is."""
    code = F.ascii(c)
    at = lambda p: F.decode(F.unhex(F.lpad(F.hex(p), 8, "0")), "UTF-32")
    block = F.filter(F.transform(F.sequence(code - code % 64, code - code % 64 + 63), at), lambda x: x.rlike(r"^[\p{L}\p{N}]$"))
    moved = F.transform(F.array(block), lambda b: F.element_at(b, (F.pmod(F.array_position(b, c) - 1 + by, F.size(b)) + 1).cast("int")))[0]
    return F.when(c.rlike(r"^[\p{L}\p{N}&&[^\x00-\x7F]]$"), moved).otherwise(c)


def _shift(c: Column, by: Column, letters: int) -> Column:
    """A character moved within its class."""
    code = F.ascii(c)

    def moved(low: str, size: int) -> Column:
        return F.char(F.lit(ord(low)) + F.pmod(code - ord(low) + by, F.lit(size)))

    last = chr(ord("a") + letters - 1)
    return F.when(c.between("0", "9"), moved("0", 10)).when(c.between("a", last), moved("a", letters)).when(c.between("A", last.upper()), moved("A", letters)).otherwise(_other(c, by) if letters == 26 else c)


def feistel_text(value: Column, key: str, kind: str | Column, letters: int = 26, inverse: bool = False) -> Column:
    """A permutation of the texts with the same classes of characters at the same places; or its inverse."""
    n = F.char_length(value)
    half = F.floor(n / 2).cast("int")  # the rounds are even, so the halves end as long as they began

    def turned(text: Column, other: Column, turn: Column) -> Column:
        noise = _noise(key, kind, turn, other)
        places = F.when(F.char_length(text) > 0, F.sequence(F.lit(1), F.char_length(text))).otherwise(F.expr("cast(array() as array<int>)"))
        by = lambda i: F.conv(noise.substr(((i - 1) % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int") * (-1 if inverse else 1)
        return F.array_join(F.transform(places, lambda i: _shift(text.substr(i, F.lit(1)), by(i), letters)), "")

    def one(state: Column, turn: Column) -> Column:
        if inverse:
            return F.struct(turned(state["r"], state["l"], turn).alias("l"), state["l"].alias("r"))
        return F.struct(state["r"].alias("l"), turned(state["l"], state["r"], turn).alias("r"))

    first = F.struct(value.substr(F.lit(1), half).alias("l"), value.substr(half + 1, n - half).alias("r"))
    return F.aggregate(_turns(inverse), first, one, lambda s: F.concat(s["l"], s["r"]))


def _turns(inverse: bool) -> Column:
    return F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))


def feistel_pair(left: Column, right: Column, sizes: tuple[int, int], key: str, kind: str, inverse: bool = False) -> Column:
    """A permutation of the pairs (l, r) with 0 <= l < sizes[0] and 0 <= r < sizes[1], as a struct; or its inverse."""
    sign = -1 if inverse else 1

    def one(s: Column, turn: Column) -> Column:
        odd = turn % 2 == 1
        noise = sign * _number(_noise(key, kind, turn, F.when(odd, s["r"]).otherwise(s["l"]).cast("string")))
        return F.struct(F.when(odd, F.pmod(s["l"] + noise, F.lit(sizes[0]))).otherwise(s["l"]).alias("l"), F.when(odd, s["r"]).otherwise(F.pmod(s["r"] + noise, F.lit(sizes[1]))).alias("r"))

    return F.aggregate(_turns(inverse), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), one)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column, doubled: int) -> Column:
    """The Luhn sum; from the right, places 1, 2, ...: those with the remainder `doubled` modulo 2 count twice."""
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == doubled, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _refill(m: Column, digits: Column, skip: Column) -> Column:
    """m with its digits after the first `skip` ones replaced, in order, by those of `digits`."""
    nth = lambda i: F.char_length(_digits(m.substr(F.lit(1), i))) - skip
    one = lambda i: F.when(m.substr(i, F.lit(1)).between("0", "9") & (nth(i) > 0), digits.substr(nth(i), F.lit(1))).otherwise(m.substr(i, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(m)), one), "")


def _account_rest(account: Column) -> Column:
    """The remainder modulo 97 of an account number without blanks, its country and check digits moved to the end and letters counting 10 to 35."""
    moved = F.concat(account.substr(F.lit(5), F.char_length(account)), account.substr(F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(moved.substr(i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(moved)), F.lit(0), add)


def _day_first(m: Column) -> Column:
    """The date that a text with the year last means: with the day first if there is one, else with the month first."""
    part = lambda at: m.substr(F.lit(at), F.lit(2))
    date = lambda day, month: F.try_to_date(F.concat_ws("-", m.substr(F.lit(7), F.lit(4)), part(month), part(day)))
    return F.struct(date(1, 4).alias("day"), date(4, 1).alias("month"))


def kind_of(m: Column) -> Column:
    """The kind of a candidate, null if it fails validation."""
    octets = F.split(m, r"\.")
    whole = lambda p: m.rlike(f"^(?:{p})$")
    day = F.try_to_date(F.regexp_replace(m, "/", "-"))
    ssn_ok = ~m.substr(1, 3).isin("000", "666") & (m.substr(1, 1) != "9") & (m.substr(5, 2) != "00") & (m.substr(8, 4) != "0000")
    return (
        F.when(m.contains("@"), F.lit("email"))
        .when(m.rlike("^[A-Z]"), F.when(whole(_IBAN), F.when(_account_rest(F.regexp_replace(m, " ", "")) == 1, F.lit("iban"))).when(whole(_SECRET), F.lit("secret")))
        .when(whole(_IP), F.when(F.forall(octets, lambda o: o.cast("int") <= 255), F.lit("ip")))
        .when(whole(_DATE), F.when(day.between("1900-01-01", "2100-01-02"), F.lit("date")))
        .when(whole(_TURNED), F.when(F.coalesce(_day_first(m)["day"], _day_first(m)["month"]).between("1900-01-01", "2099-12-31"), F.lit("date")))
        .when(whole(_SSN), F.when(ssn_ok, F.lit("ssn")))
        .when(whole(_PHONE), F.lit("phone"))
        .when(m.startswith("+"), F.when(F.char_length(_digits(m)).between(8, 15), F.lit("phone")))
        .when(whole(_SECRET), F.lit("secret"))
        .when(m.rlike(r"^[0-9][0-9 -]*$"), F.lit("run"))
    )


def _cards(numbers: Column) -> Column:
    """The cards in a run of numbers, as an array of (s, e): the first and last number of each. No two overlap."""

    def pick(taken: Column, issued: bool) -> Column:
        def card(i: Column, j: Column) -> Column:
            digits = _digits(F.array_join(F.slice(numbers, i, j - i + 1), ""))
            fits = lambda d: F.char_length(d).between(13, 19) & (d.rlike(_ISSUED) if issued else F.lit(True)) & (_luhn(d, 0) % 10 == 0)
            return ~F.exists(taken, lambda t: (t["s"] <= j) & (t["e"] >= i)) & F.exists(F.array(digits), fits)

        def one(state: Column, i: Column) -> Column:
            ends = F.filter(F.sequence(i, F.least(i + 18, F.size(numbers))), lambda j: card(i, j))
            add = lambda e: F.when(e.isNull(), state).otherwise(F.struct(e.alias("done"), F.concat(state["got"], F.array(F.struct(i.alias("s"), e.alias("e")))).alias("got")))
            return F.when(i <= state["done"], state).otherwise(F.transform(F.array(F.array_max(ends)), add)[0])

        first = F.struct(F.lit(0).alias("done"), F.expr("cast(array() as array<struct<s: int, e: int>>)").alias("got"))
        return F.aggregate(F.sequence(F.lit(1), F.size(numbers)), first, one, lambda s: s["got"])

    none = F.expr("cast(array() as array<struct<s: int, e: int>>)")
    return F.transform(F.array(pick(none, True)), lambda a: F.concat(a, pick(a, False)))[0]


def _card_pseudonym(m: Column, key: str, inverse: bool = False) -> Column:
    digits = _digits(m)
    # an array of one, so that the permuted digits are computed once
    return F.transform(F.array(feistel_text(digits.substr(F.lit(1), F.char_length(digits) - 1), key, "card", inverse=inverse)), lambda d: _refill(m, F.concat(d, ((10 - _luhn(d, 1) % 10) % 10).cast("string")), F.lit(0)))[0]


def _run(m: Column, key: str) -> Column:
    """struct<n, new>: the cards of a run of numbers and the run with them replaced."""

    def filled(numbers: Column, cards: Column) -> Column:
        def one(number: Column, k: Column) -> Column:
            i = k + 1
            at = F.get(F.filter(cards, lambda t: (t["s"] <= i) & (t["e"] >= i)), F.lit(0))
            return F.transform(F.array(at), lambda t: F.when(t.isNull(), number).when(t["s"] == i, _card_pseudonym(F.array_join(F.slice(numbers, i, t["e"] - i + 1), ""), key)).otherwise(F.lit("")))[0]

        return F.struct(F.size(cards).alias("n"), F.when(F.size(cards) > 0, F.array_join(F.transform(numbers, one), "")).otherwise(m).alias("new"))

    numbers = F.regexp_extract_all(m, F.lit("[0-9]+[ -]?"), F.lit(0))
    return F.transform(F.array(numbers), lambda a: F.transform(F.array(_cards(a)), lambda c: filled(a, c))[0])[0]


def _date_pseudonym(m: Column, key: str, inverse: bool) -> Column:
    first = F.lit("1900-01-01").cast("date")

    def moved(date: Column) -> Column:
        day = F.datediff(date, first)
        return F.transform(F.array(feistel_pair(F.floor(day / 229), day % 229, (319, 229), key, "date", inverse)), lambda s: F.date_add(first, (s["l"] * 229 + s["r"]).cast("int")))[0]

    def american(date: Column) -> Column:
        early = F.transform(F.array(feistel_pair((F.year(date) - 1900) * 12 + F.month(date) - 1, F.day(date) - 13, (2400, 16), key, "date.month", inverse)), lambda s: F.make_date((1900 + F.floor(s["l"] / 12)).cast("int"), (s["l"] % 12 + 1).cast("int"), (s["r"] + 13).cast("int")))[0]
        leap = (F.month(date) == 2) & (F.day(date) == 29)
        later = F.transform(F.array(feistel_pair(F.floor((F.year(date) - 1900) / 20), F.year(date) % 20, (10, 20), key, "date.year", inverse)), lambda s: F.make_date((1900 + s["l"] * 20 + s["r"]).cast("int"), F.month(date), F.day(date)))[0]
        quad = F.transform(F.array(feistel_pair(F.floor((F.year(date) - 1904) / 4 / 7), F.floor((F.year(date) - 1904) / 4) % 7, (7, 7), key, "date.leap", inverse)), lambda s: F.make_date((1904 + (s["l"] * 7 + s["r"]) * 4).cast("int"), F.month(date), F.day(date)))[0]
        return F.when(F.day(date) <= 28, early).when(leap, quad).otherwise(later)

    plain = F.regexp_replace(F.date_format(moved(F.try_to_date(F.regexp_replace(m, "/", "-"))), "yyyy-MM-dd"), "-", m.substr(F.lit(5), F.lit(1)))
    both = _day_first(m)
    # a date with the day first must not leave the range of those that are recognised: its last two days, beyond 2099, stay where they are
    kept = lambda d: F.when(moved(d) <= F.lit("2099-12-31").cast("date"), moved(d)).otherwise(_once_more(moved, d))
    mark = m.substr(F.lit(3), F.lit(1))
    turned = F.when(both["day"].isNotNull(), F.date_format(kept(both["day"]), "dd-MM-yyyy")).otherwise(F.date_format(american(both["month"]), "MM-dd-yyyy"))
    return F.when(m.rlike(r"^\d{4}"), plain).otherwise(F.replace(turned, F.lit("-"), mark))


def _once_more(moved, date: Column) -> Column:
    """The permutation again, twice if need be: there are but two days outside the range, so the walk is back inside after three steps."""
    inside = lambda d: d <= F.lit("2099-12-31").cast("date")
    return F.transform(F.array(moved(moved(date))), lambda d: F.when(inside(d), d).otherwise(moved(d)))[0]


def pseudonym(m: Column, kind: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of a validated value; inverse: the value of a pseudonym of this kind."""
    digits = _digits(m)
    n = F.char_length(digits)
    local = F.substring_index(m, "@", 1)
    email = F.concat(feistel_text(local, key, "email", inverse=inverse), F.lit("@"), F.substring_index(m, "@", -1))
    code = F.when(m.rlike(f"^(?:{_PHONE})$"), n - 10).when(m.rlike(r"^\+\d{1,3}[^\d]"), F.char_length(F.regexp_extract(m, r"^\+(\d+)", 1))).otherwise(2)
    phone = _refill(m, feistel_text(digits.substr(code + 1, n - code), key, "phone", inverse=inverse), code)
    octet = lambda i: F.element_at(F.split(m, r"\."), i).cast("int")
    ip = F.transform(F.array(feistel_pair(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), (65536, 65536), key, "ip", inverse)), lambda s: F.concat_ws(".", F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256))[0]
    ssn = _refill(m, feistel_text(digits, key, "ssn", inverse=inverse), F.lit(0))
    account = F.regexp_replace(m, " ", "")
    fresh_account = F.transform(F.array(feistel_text(account.substr(F.lit(5), F.char_length(account)), key, "iban", inverse=inverse)), lambda d: F.concat(account.substr(F.lit(1), F.lit(2)), F.lpad((98 - _account_rest(F.concat(account.substr(F.lit(1), F.lit(2)), F.lit("00"), d))).cast("string"), 2, "0"), d))[0]
    # single blanks where they were
    blanks = lambda a: F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(m)), lambda i: F.when(m.substr(i, F.lit(1)) == " ", F.lit(" ")).otherwise(a.substr(F.char_length(F.replace(m.substr(F.lit(1), i), F.lit(" "), F.lit(""))), F.lit(1)))), "")
    iban = F.transform(F.array(fresh_account), blanks)[0]
    # in pieces, as the work for one text grows with the square of its length
    pieces = F.when(F.char_length(m) < 192, F.array(m)).otherwise(F.regexp_extract_all(m, F.lit(".{128}(?=.{64})|.+"), F.lit(0)))
    tweak = lambda i: F.when(i == 0, "secret").otherwise(F.concat(F.lit("secret."), i.cast("string")))
    secret = F.array_join(F.transform(pieces, lambda p, i: feistel_text(p, key, tweak(i), letters=6, inverse=inverse)), "")
    out = F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "date", _date_pseudonym(m, key, inverse)).when(kind == "ssn", ssn).when(kind == "iban", iban).when(kind == "secret", secret)
    return (out.when(kind == "card", _card_pseudonym(m, key, True)) if inverse else out).otherwise(m)


def _is(kind: str):
    return lambda s: s["kind"] == kind


def pseudonymise(documents: DataFrame, key: str, counts: bool = True) -> DataFrame:
    """documents with the values in `text` replaced; counts: also n_<kind> for each kind, as long (0 for a null text)."""
    text = F.col("text")
    none = F.expr("cast(array() as array<string>)")
    found = F.when(text.rlike(_HINT), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).otherwise(none)
    plain = lambda m, k: F.struct(k.alias("kind"), F.lit(1).alias("n"), pseudonym(m, k, key).alias("new"))
    cards = lambda m: F.transform(F.array(_run(m, key)), lambda r: F.struct(F.lit("card").alias("kind"), r["n"].alias("n"), r["new"].alias("new")))[0]
    known = lambda m: F.transform(F.array(kind_of(m)), lambda k: F.when(k == "run", cards(m)).otherwise(plain(m, k)))[0]
    (hits,) = fresh(documents, "_m")
    df = documents.withColumn(hits, F.transform(F.coalesce(found, none), known))
    parts = F.split("text", PATTERN, -1)
    rebuilt = F.array_join(F.zip_with(parts, F.col(f"{hits}.new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    df = df.withColumn("text", F.when(F.size(hits) > 0, rebuilt).otherwise(text))
    if counts:
        df = df.withColumns({f"n_{k}": F.aggregate(F.filter(hits, _is(k)), F.lit(0), lambda n, s: n + s["n"]).cast("long") for k in KINDS})
    return df.drop(hits)
