"""Personal data beside other numbers, long secrets and letters of other alphabets."""

import datetime
import re

from pyspark.sql import functions as F

from skyquarry.llm import pii

CARD = "4111111111111111"


def luhn(digits):
    d = [int(x) for x in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def run(spark, docs):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return [r for _, r in sorted((r.doc_id, r) for r in pii.pseudonymise(df, "k1").collect())]


def test_cards_beside_numbers(spark):
    alone = run(spark, [CARD])[0].text
    assert alone != CARD and luhn(alone)
    around = [("", " 123"), ("12 ", ""), ("1234 ", " 123"), ("", " 12 34 5"), ("x 7 ", "-99 y"), ("", " 97.51.17.173"), ("1 2 3 4 5 6 7 8 9 ", " 1" * 3000)]
    for (before, after), r in zip(around, run(spark, [b + CARD + a for b, a in around]), strict=True):
        assert r.n_ip or r.text == before + alone + after
        assert CARD not in r.text and alone in r.text and r.n_card == 1 and r.text.startswith(before)
    grouped, two, mixed, bare, secret = run(spark, ["123 4567 89 4111 1111 1111 1111", f"{CARD} 5500000000000004", f"{CARD} 123-45-6789 a", "1234567890123 12 99", "1234567890123" + "abcdef0" * 4])
    assert re.fullmatch(r"123 4567 89 (\d{4} ){3}\d{4}", grouped.text) and grouped.text[12:].replace(" ", "") == alone
    assert two.n_card == 2 and two.text.split()[0] == alone and luhn(two.text.split()[1]) and two.text.split()[1] != "5500000000000004"
    assert (mixed.n_card, mixed.n_ssn) == (1, 1) and mixed.text.startswith(alone) and "123-45-6789" not in mixed.text
    assert bare.n_card == 0 and bare.text == "1234567890123 12 99"
    assert secret.n_secret == 1 and secret.text[:13] != "1234567890123"


def test_long_secrets(spark):
    docs = ["0123456789abcdef" * 3, *(("0123456789abcdef" * 20)[:n] for n in (129, 191, 192, 256)), "AB12" * 25000, "ab" * 70 + "g"]
    got = run(spark, [f"key {d} end" for d in docs])
    for d, r in zip(docs[:-1], got, strict=False):
        new = r.text[4:-4]
        assert r.n_secret == 1 and len(new) == len(d) and new[:64] != d[:64] and new[-64:] != d[-64:]
        assert all(a.isdigit() == b.isdigit() and a.isupper() == b.isupper() and b in "0123456789abcdefABCDEF" for a, b in zip(d, new, strict=True))
    assert got[-1].n_secret == 0 and got[-1].text == f"key {docs[-1]} end"


def test_letters_outside_ascii(spark):
    names = ["éèàùç", "иванов", "山田太郎", "jose.é1", "𝒜𝒷𝒸", "٣٤٥"]
    got = run(spark, [f"to {n}@example.com and {n}@example.com" for n in names])
    for n, r in zip(names, got, strict=True):
        a, b = re.fullmatch(r"to (.+)@example\.com and (.+)@example\.com", r.text).groups()
        assert r.n_email == 2 and a == b != n and len(a) == len(n)
        assert all(x.isalnum() == y.isalnum() and (x.isascii() == y.isascii()) for x, y in zip(n, a, strict=True))


def test_letters_are_permuted(spark):
    from pyspark.sql import functions as F

    letters = [chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha()]
    pairs = spark.createDataFrame([(a + b,) for a in letters for b in letters], "v string")
    assert pairs.select(pii.feistel_text(F.col("v"), "k", "t").alias("w")).distinct().count() == len(letters) ** 2


def test_more_kinds_and_inverse(spark):
    """Account numbers, other orders of dates, numbers abroad: found, valid again, linked, and undone with the key."""
    def rest(a):
        return int("".join(str(int(c, 36)) for c in a[4:] + a[:4])) % 97

    accounts = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947", "FR14 2004 1010 0505 0001 3M02 606"]
    assert all(rest(a.replace(" ", "")) == 1 for a in accounts)
    dates = ["31/12/2024", "12/31/2024", "31.12.2024", "05-03-1999", "02/29/2024", "12/13/1900", "01/01/2100", "31/12/2099"]
    phones = ["+49 30 901820", "+44 20 7946 0958", "+8613800138000", "(974) 555-3436", "+1 974-555-3436"]
    others = ["jane.doe42@mail7.example.com", "97.51.17.173", "2024-02-29", "1999/12/31", "123-45-6789", "4111111111111111", "ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e", "AB8CA1B325BC4F85AA6A79E73FC4CBFC2098878E"]
    values = [*accounts, *dates, *phones, *others]
    left = ["DE88370400440532013000", "ZZ89370400440532013000", "31/13/2024", "13/32/2024", "99.99.2024", "+12 34", "01/01/2100", "v1.2.3.4.5"]
    df = spark.createDataFrame([(i, f"<{v}> ({v})") for i, v in enumerate(values)] + [(100 + i, f"<{v}>") for i, v in enumerate(left)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k1").collect()}
    assert all(got[100 + i].text == f"<{v}>" for i, v in enumerate(left))
    names = ["iban"] * 4 + ["date"] * 8 + ["phone"] * 5 + ["email", "ip", "date", "date", "ssn", "card", "secret", "secret"]
    new = {}
    for i, (v, kind) in enumerate(zip(values, names)):
        m = re.fullmatch(r"<(.*)> \((.*)\)", got[i].text)
        assert m[1] == m[2]
        if v != "01/01/2100":
            assert m[1] != v and got[i][f"n_{kind}"] == 2, v
            new[i] = (v, kind, m[1])
        if kind == "iban":
            assert rest(m[1].replace(" ", "")) == 1 and m[1][:2] == v[:2] and [k for k, c in enumerate(m[1]) if c == " "] == [k for k, c in enumerate(v) if c == " "]
    for v, form in (("31/12/2024", "%d/%m/%Y"), ("12/31/2024", "%m/%d/%Y"), ("31.12.2024", "%d.%m.%Y"), ("02/29/2024", "%m/%d/%Y")):
        datetime.datetime.strptime(next(n for w, _, n in new.values() if w == v), form)
    back = spark.createDataFrame([(v, k, n) for v, k, n in new.values()], "v string, k string, n string").select("v", pii.pseudonym(F.col("n"), F.col("k"), "k1", inverse=True).alias("back")).collect()
    assert [(r.v, r.back) for r in back] == [(r.v, r.v) for r in back]


def test_dates_with_the_day_first_are_permuted(spark):
    days = spark.sql("select explode(sequence(date'1900-01-01', date'2099-12-31', interval 1 day)) as d")
    made = days.select(pii.pseudonym(F.date_format("d", "dd.MM.yyyy"), F.lit("date"), "k").alias("n"), F.when(F.day("d") > 12, pii.pseudonym(F.date_format("d", "MM/dd/yyyy"), F.lit("date"), "k")).alias("m"))
    n, distinct, late, months, distinct_months = made.agg(F.count("n"), F.count_distinct("n"), F.max(F.substring("n", 7, 4)), F.count("m"), F.count_distinct("m")).first()
    assert n == distinct and late <= "2099" and months == distinct_months


def test_session_key(spark):
    assert pii.session_key(spark)
    spark.conf.set("spark.skyquarry.pii.key", "mine")
    assert pii.session_key(spark) == "mine"
    spark.conf.unset("spark.skyquarry.pii.key")
