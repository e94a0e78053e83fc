"""The divergence audit against a plain version with Python's whole numbers, and its parts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from skyquarry.llm import divergence

COLUMNS = "doc_id long, text string, lang string, source string, n long, term string, block int, kept string, _blocks int"


def brute(rows, least, best=50):
    """rows: (text, lang, source)."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = [t.translate(lower) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        groups.add((lang, source))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        v, sources = len(kept), sorted(s for x, s in groups if x == lang)
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * v)  # noqa: E731, B023
        p = {s: {t: share(count[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(count[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (-x[0], x[1].encode()))
            over = sorted(((p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:best]
            out += [(lang, s, part, item, value, i + 1) for part, found in (("pair", pairs), ("term", over)) for i, (value, item) in enumerate(found)]
    return sorted(out)


def texts(rnd, n):
    words = ["the", "of", "Und", "Élan", "été", "naïve", "x", "Zoë", "ß", "a1b", "co-op", "日本", "🙂"] + [a + b for a in "kmnpr" for b in ("a", "O", "ue", "ï")]
    out = []
    for _ in range(n):
        lang = rnd.choice(["en", "en", "en", "de", None, ""])
        source = rnd.choice(["hot", "hot", "s1", "s2", None, "été", "z"])
        out.append((" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))), lang, source))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, *r, 1, "t", 1, "k", 1) for i, r in enumerate(rows)], COLUMNS)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("least,cells,held", [(1, 1 << 19, 10**6), (3, 8, 5), (12, 40, 50), (10**6, 1 << 19, 10**6)])
def test_audit(spark, monkeypatch, least, cells, held):
    rnd = random.Random(least)
    rows = texts(rnd, 120)
    rows += [(None, "en", "only null"), ("", "xx", "empty"), ("1 2 3", "xx", "digits"), (rows[0][0], *rows[0][1:]), ("solo", "yy", "one source"), ("the " * 300_000 + "end", "en", "long")]
    monkeypatch.setattr(divergence, "HELD", held)
    assert found(divergence.audit(table(spark, rows), least_docs=least, cells=cells)) == brute(rows, least)


def test_best_terms_and_ties(spark):
    """Seventy terms with equal shares: the first fifty by their bytes, from whichever block."""
    rows = [(" ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}é" for i in range(70)), "en", "a")] * 2 + [("other", "en", "b")] * 2
    got = found(divergence.audit(table(spark, rows), least_docs=2, cells=16))
    assert got == brute(rows, 2) and sum(r[1] == "a" and r[2] == "term" for r in got) == 50


def test_without_rows(spark):
    assert divergence.audit(table(spark, [("x", "en", "a")]).where("false")).count() == 0


def test_equal_hashes_of_unlike_bytes(monkeypatch):
    """Hashes that collide: the groups are those of the bytes."""
    monkeypatch.setattr(divergence.xxhash, "xxh3_64_intdigest", lambda b: len(b) % 2)
    counts = {}
    for _, terms, both in divergence.slice_counts(pa.array(["ab cd ab x", "cd x yyy ab", None]), np.zeros(3, np.int64)):
        counts |= {t: (c >> 32, c & 0xFFFFFFFF) for t, c in zip(terms, both)}
    assert counts == {b"ab": (3, 2), b"cd": (2, 2), b"x": (2, 2), b"yyy": (1, 1)}


def test_shares_are_exact():
    rnd = random.Random(3)
    for _ in range(300):
        v = rnd.randint(1, 10**6)
        n = rnd.randint(0, 10 ** rnd.randint(0, 15))
        c = rnd.randint(0, n)
        assert divergence.shares(np.array([c]), np.array([n + 5 * v]))[0] == 1 + 10**9 * (c + 5) // (n + 5 * v)


def test_row_sums_of_empty_rows():
    assert divergence.row_sums(np.array([1, 2, 3]), np.array([0, 0, 2, 2, 3, 3])).tolist() == [0, 3, 0, 3, 0]
