"""The corpus operators against brute force, on small fixtures with nulls, empty, long and repeated texts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from skyquarry.llm import components, decontam, jaccard, lm, pieces, pii, quality, repeats, simhash, tokencount, toxicity
from skyquarry.llm.shared import fit_on_sample, public_model

MODEL = public_model("piece_bpe_32k.model")
WORDS = [a + b for a in ("th", "er", "on", "an", "re", "he", "in", "ed") for b in ("a", "ent", "ing", "st", "or", "é")]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    base = [prose(rnd, n) for n in (1, 2, 3, 4, 5, 8, 12, 30, 60, 100, 200, 400)]
    out = [None, "", " ", "a", *base, *base[3:]]
    for t in base[4:]:  # near copies: some words replaced
        for share in (0.01, 0.03, 0.06):
            out.append(" ".join(w if rnd.random() > share else "changed" for w in t.split(" ")))
    out += [base[9] + " " + prose(rnd, 50), prose(rnd, 40) + base[9], "x" * 700, "ab" * 400, prose(rnd, 3000)]
    return out


@pytest.fixture(scope="module")
def documents(spark, texts):
    rows = [(i, t, "en", "src", len(t or ""), i, "c") for i, t in enumerate(texts)]
    # columns with the names of results and internals
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, c string")


@pytest.fixture(scope="module")
def empty(documents):
    return documents.where("false")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def sets(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute_components(ss, num, den):
    root = list(range(len(ss)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ss)):
        for j in range(i):
            if ss[i] and ss[j] and len(ss[i] & ss[j]) * den >= len(ss[i] | ss[j]) * num:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(ss))]


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_jaccard(documents, texts, empty, k, num):
    ss = sets(texts, k)
    got = rows(jaccard.join(documents, k, num, 100))
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == list(zip(map(len, ss), brute_components(ss, num, 100)))
    assert jaccard.join(empty, k, num, 100).count() == 0


def test_jaccard_large_components(spark, monkeypatch):
    """Components of several blocks, divided along shared keys (a chain) or into blocks (a dense group), give the links of brute force."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    rnd = random.Random(11)
    words = [rnd.choice(WORDS) + str(rnd.randrange(1000)) for _ in range(1400)]
    chain = [" ".join(words[8 * i : 8 * i + 120]) for i in range(150)]  # each is linked to its neighbours only
    dense = []
    base = [rnd.choice(WORDS) + str(rnd.randrange(1000)) for _ in range(200)]
    for i in range(40):
        w = list(base)
        w[5 * i] = f"changed{i}"
        dense.append(" ".join(w))
    texts = chain + dense + dense[:5]
    seen = []
    plain = jaccard._groups
    monkeypatch.setattr(jaccard, "_groups", lambda *a: seen.append(plain(*a)) or seen[-1])
    made = []
    verify = jaccard._verify
    monkeypatch.setattr(jaccard, "_verify", lambda texts, *a: made.append(seen[-1].groupBy("root").agg(F.count("*").alias("n"), F.max("_blocks").alias("b")).collect()) or verify(texts, *a))
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(jaccard.join(documents, 4, 85, 100))
    assert [got[i].component_id for i in range(len(texts))] == brute_components(sets(texts, 4), 85, 100)
    assert len(made[0]) > 5 and any(g.n == 40 and g.b == 10 for g in made[0])


def test_jaccard_keys_find_all_links():
    """Any pair within the threshold shares a key, for sets of all sizes, with and without common elements."""
    rnd = np.random.default_rng(3)
    for num in (80, 85):
        for n in [*range(2, 40), 60, 100, 300]:
            for _ in range(12):
                a = np.unique(rnd.integers(0, 1 << 64, n, dtype=np.uint64))
                d = int(rnd.integers(0, max(1, len(a) * (100 - num) // 50) + 1))
                b = np.unique(np.concatenate([a[rnd.permutation(len(a))[int(rnd.integers(0, d + 1)) :]], rnd.integers(0, 1 << 64, int(rnd.integers(0, d + 1)), dtype=np.uint64)]))
                common = np.sort(a[rnd.random(len(a)) < 0.3])
                if len(b) and not np.array_equal(a, b) and jaccard.linked(a, b, num, 100):
                    for c in (jaccard._NO_COMMON, common):
                        assert np.intersect1d(jaccard.keys(a, num, 100, c), jaccard.keys(b, num, 100, c)).size, (num, len(a), len(b))


def test_keep_one(documents, texts):
    kept = jaccard.keep_one(documents, 5, 80, 100)
    assert kept.columns == documents.columns
    ss = sets(texts, 5)
    roots = brute_components(ss, 80, 100)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if roots[i] == i]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (5, 5), (7, None)] + [(100 + i, 101 + i) for i in range(30)]
    got = rows(components.components(spark.createDataFrame(edges, "a long, b long")), "node")
    assert {n: r.root for n, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10} | {100 + i: 100 for i in range(31)}


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        spans = int((mask & ~np.append(False, mask[:-1])).sum())
        out.append((len(t), int(mask.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~mask])).hexdigest()))
    return out


@pytest.mark.parametrize("hot,block", [(512, 8 << 20), (2, 4000)])
def test_repeats(documents, texts, empty, hot, block):
    got = rows(repeats.remove(documents, hot=hot, block_bytes=block))
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == brute_repeats(texts, 200)
    assert repeats.remove(empty).count() == 0


def test_maximal_repeats():
    """Left- and right-maximal, with all occurrences, as by definition."""
    rnd = random.Random(9)
    for _ in range(60):
        ts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 14))) for _ in range(3)]
        where = {}
        for t, s in enumerate(ts):
            for i in range(len(s)):
                for j in range(i + 3, len(s) + 1):
                    where.setdefault(s[i:j], []).append((t, i))

        def sides(o, n, ts=ts):
            left = {(ts[t][i - 1] if i else (t, i)) for t, i in o}
            right = {(ts[t][i + n] if i + n < len(ts[t]) else (t, i)) for t, i in o}
            return len(left) > 1 and len(right) > 1

        want = {(len(s), tuple(sorted(o))) for s, o in where.items() if len(o) > 1 and sides(o, len(s))}
        assert {(n, tuple(sorted(o))) for n, o in repeats.maximal_repeats(ts, length=3)} == want


def brute_language_model(texts, train, dense):
    """base and score of every text by walking dictionaries of n-grams."""
    tokens = [["<s>", *re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for t in texts]
    c, c2, c3 = Counter(), Counter(), Counter()
    for ws, use in zip(tokens, train):
        if use:
            c.update(ws)
            c2.update(zip(ws, ws[1:]))
            c3.update(zip(ws, ws[1:], ws[2:]))
    starts = c.pop("<s>", 0)
    n, v = sum(c.values()), len(c)
    of = lambda u: starts if u == "<s>" else c[u]
    size = lambda x: int(x).bit_length()
    single, every, follows, stays, mass = Counter(), Counter(), Counter(), Counter(), Counter()
    for (u, w), m in c2.items():
        every[size(of(u))] += m
        single[size(of(u))] += m == 1
        follows[size(m)] += m * (w is not None)
    for (u, x, w), m in c3.items():
        thick = c2[u, x] >= dense
        if c2[u, x] >= 2:
            mass[u, x] += m if thick or m >= 2 else 0
            stays[size(c2[u, x])] += m if m >= (2 if thick else 3) else 0
    clip = lambda x: min(max(x, 1e-4), 0.9999)
    unigram = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))

    def bigram(u, w):
        if not of(u):
            return unigram(w)
        g = clip(single[size(of(u))] / max(every[size(of(u))], 1))
        return (1 - g) * c2[u, w] / of(u) + g * unigram(w)

    def trigram(u, x, w):
        if not mass[u, x]:
            return bigram(x, w)
        g = clip(1 - stays[size(c2[u, x])] / max(follows[size(c2[u, x])], 1))
        m = c3[u, x, w]
        return (1 - g) * (m if m >= 2 or c2[u, x] >= dense else 0) / mass[u, x] + g * bigram(x, w)

    out = []
    for ws in tokens:
        base = sum(np.log10(unigram(w)) for w in ws[1:])
        out.append((len(ws) - 1, sum(c[w] > 0 for w in ws[1:]), n, base, np.log10(bigram(ws[0], ws[1])) + sum(np.log10(trigram(*x)) for x in zip(ws, ws[1:], ws[2:]))))
    vocabulary = [*c, "unseen word"]
    return out, [sum(trigram(u, x, w) for w in vocabulary) for u, x in list(mass)[:50]]


@pytest.mark.parametrize("block,dense,piece", [(8 << 20, 1 << 16, 256), (3000, 4, 3), (3000, 1 << 16, 1)])
def test_language_model(documents, texts, empty, block, dense, piece):
    train = [i % 4 != 0 for i in range(len(texts))]
    got = rows(lm.score(documents, F.col("doc_id") % 4 != 0, block_bytes=block, dense=dense, piece=piece))
    want, sums = brute_language_model(texts, train, dense)
    assert np.allclose(sums, 1)  # the probabilities after a state, over all words and an unknown one
    for i, w in enumerate(want):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert np.isclose(r.base_score, w[3]) and np.isclose(r.score, w[4])
    assert lm.score(empty, F.lit(True)).count() == 0


def test_pieces_equal_the_library(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    m = pieces.Merger.of(pieces.Vocabulary.read(MODEL))
    rnd = random.Random(1)
    odd = ["▁", "  ", "▁▁ ▁", "<s></s><unk><0x0A>", "a" * 500, " " * 100, "﻿ x", "é" * 70 + "①" * 80, "😀 梦\n\t\0"]
    odd += ["".join(rnd.choice("ab ▁ \n\tthe ing é ① 梦 <s> 😀 \0 ll nn 00 1") for _ in range(rnd.randint(1, 120))) for _ in range(500)]
    every = [t or "" for t in texts] + odd
    for t, words in zip(every, m.encode_texts(every)):
        ids = [i for w in words for i in w]
        assert ids == sp.encode(t) and m.decode(ids) == sp.decode(ids)
    for _ in range(300):
        ids = [rnd.randrange(3, 32000) for _ in range(20)]
        assert m.decode(ids) == sp.decode(ids)


def test_pieces_frames(documents, texts, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got, ids = rows(pieces.digest(documents, MODEL)), pieces.encode(documents, MODEL)
    back = rows(pieces.decode(ids, MODEL))
    for i, t in enumerate(texts):
        want = [*sp.encode(t or ""), 2]
        assert got[i].n_tokens == len(want) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert back[i].text == sp.decode(want) == (t or "") and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert pieces.digest(empty, MODEL).count() == 0


def test_token_counts(documents, texts, empty):
    v = pieces.Vocabulary.read(MODEL)
    u = tokencount.Unigram.of(v)
    scores = u.vocabulary_scores(v)

    def brute(word):
        best = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            n = len(word[e - 1].encode())
            options = [(best[e - 1][0] + u.floor * n, best[e - 1][1] - n)]
            options += [(best[e - k][0] + scores[word[e - k : e]], best[e - k][1] - 1) for k in range(1, min(16, e) + 1) if word[e - k : e] in scores]
            best.append(max(options))
        return -best[-1][1]

    got = rows(tokencount.count(documents, MODEL))
    for i, t in enumerate(texts):
        words = pieces._split(t or "")
        assert (got[i].n_pretokens, got[i].n_tokens) == (len(words), sum(brute(w) for w in words))
    assert u.counts(["①②", "▁" * 70, "x" * 100]).tolist() == [brute(w) for w in ("①②", "▁" * 70, "x" * 100)]
    assert tokencount.count(empty, MODEL).count() == 0


def brute_contamination(docs, items):
    """For each document {item: overlap}, by laying every item at every place."""
    split = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for d in map(split, docs):
        found = {}
        for k, item in enumerate(map(split, items)):
            n, best = len(item), 0
            width = min(n, 13)
            for diagonal in range(-n + 1, len(d)) if n else ():
                same = {i: d[diagonal + i] == item[i] for i in range(n) if 0 <= diagonal + i < len(d)}
                cover = set()
                for a in range(n - width + 1):
                    places = range(a, a + width)
                    if all(i in same for i in places) and sum(same[i] for i in places) >= width - 2 * width // 13:
                        cover.update(i for i in places if same[i])
                best = max(best, len(cover))
            if best:
                found[k] = best / n
        out.append(found)
    return out


@pytest.mark.parametrize("bits", [28, 6])
def test_decontamination(spark, empty, bits):
    rnd = random.Random(4)
    unique = lambda n, k: " ".join(f"q{k}w{i}" for i in range(n))
    items = [unique(n, n) for n in (*range(1, 16), 20, 40)] + [prose(rnd, 30), "word word " * 9]
    around = lambda t: f"{prose(rnd, 25)} {t} {prose(rnd, 25)}"
    swap = lambda t, places: " ".join("zzz" if i in places else w for i, w in enumerate(t.split(" ")))
    docs = []
    for t in items:
        n = len(t.split())
        docs += [around(t), t.upper(), *(around(swap(t, set(rnd.sample(range(n), min(n, e))))) for e in (1, 1, 1, 2, 2, 3)), around(t[: len(t) // 2])]
    docs += [None, "", "...", prose(rnd, 60), around(items[15] + " and " + items[12])]
    want = brute_contamination(docs, items)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(77, items[3]), (78, None), (79, ""), (None, "?!")], "item_id short, text string")
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(docs)], "doc_id long, text string, _mark string, item_id int")
    got = rows(decontam.overlaps(df, bench, most_bits=bits))
    for i, w in enumerate(want):
        assert {h.item_id: h.overlap for h in got[i].hits} == pytest.approx(w), docs[i]
    kept = decontam.clean(df, bench, most_bits=bits)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, w in enumerate(want) if not w]
    flags = rows(decontam.flags(df, bench, most_bits=bits))
    assert all((flags[i].contaminated, flags[i].n_items) == (bool(w), len(w)) and flags[i].overlap == pytest.approx(max(w.values(), default=0)) for i, w in enumerate(want))
    assert flags[0].word == 25


def test_decontamination_rows(spark, empty):
    bench = spark.createDataFrame([("a", "one two three four")], "item_id string, text string")
    df = spark.createDataFrame([(None, "x one two three four"), (None, "x one two three four"), (1, "one two"), (1, "one two three four"), (2, None)], "doc_id int, text string")
    got = sorted(((r.doc_id or 0, r.contaminated, r.item_id, r.word) for r in decontam.flags(df, bench).collect()), key=str)
    assert got == sorted([(0, True, "a", 1), (0, True, "a", 1), (1, False, None, None), (1, True, "a", 0), (2, False, None, None)], key=str)
    assert decontam.clean(df, bench).count() == 2
    assert decontam.flags(empty, bench).count() == 0
    assert decontam.flags(df, bench.where("false")).where("contaminated").count() == 0
    assert decontam.clean(df, bench.where("false")).count() == 5


def test_masks_are_sensitive():
    from itertools import combinations

    for n in range(1, 16):
        width = min(n, decontam.WINDOW)
        for bad in combinations(range(width), decontam.tolerance(n)):
            assert any(not set(bad) & {o + i for i in mask} for mask, only in decontam.shapes(n) for o in (range(width - mask[-1]) if only is None else [only])), (n, bad)


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_pseudonyms(spark, empty):
    card = next(s for s in (f"453201511283036{i}" for i in range(10)) if luhn(s))
    bad = card[:-1] + str((int(card[-1]) + 1) % 10)
    values = {"email": "jane.doe42@mail7.example.com", "phone": "+1 (974) 555-3436", "ip": "97.51.17.173", "date": "2024-02-29", "ssn": "123-45-6789", "card": card, "secret": "ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e"}
    docs = [f"a {v}, b%%% {v}### c" for v in values.values()]
    docs += [f"{' '.join(values.values())}", f"n {bad} 2023-02-29 300.1.1.1 666-12-1234 v4.0.1 12345 tel 5553436", None, "", "plain text\nonly"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, n_email string")
    got = rows(pii.pseudonymise(df, "k1"))
    assert [got[i].text for i in range(8, 12)] == docs[8:]
    shape = lambda s: re.sub(r"[a-z]", "a", re.sub(r"\d", "0", s))
    for i, (kind, v) in enumerate(values.items()):
        m = re.fullmatch(r"a (.+), b%%% (.+)### c", got[i].text)
        assert m[1] == m[2] != v and m[1] in got[7].text and getattr(got[i], f"n_{kind}") == 2
        if kind == "ip":
            assert all(0 <= int(x) < 256 for x in m[1].split("."))
        else:
            assert shape(m[1]) == shape(v)
    new = re.fullmatch(r"a (.+), b.*", got[5].text)[1]
    assert luhn(new)
    assert rows(pii.pseudonymise(df, "k2"))[5].text != got[5].text
    assert pii.pseudonymise(empty, "k").count() == 0


def test_feistel_is_a_permutation(spark):
    df = spark.range(1000).select(pii.feistel_text(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("v"), pii.feistel_pair(F.floor(F.col("id") / 25), F.col("id") % 25, (40, 25), "k", "t").alias("p"))
    got = df.collect()
    assert len({r.v for r in got}) == len({(r.p.l, r.p.r) for r in got}) == 1000
    assert all(0 <= r.p.l < 40 and 0 <= r.p.r < 25 and re.fullmatch(r"\d{3}", r.v) for r in got)


def test_simhash(spark, documents, texts, empty):
    got = rows(simhash.compare_edits(documents))
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()
        near = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
        assert got[i].near_edited == near(got[i].fingerprint, got[i].edited_fingerprint) and got[i].near_next == near(got[i].fingerprint, got[(i + 1) % len(texts)].fingerprint)
    same = {}
    for i, t in enumerate(texts):
        assert same.setdefault(t or "", got[i].fingerprint) == got[i].fingerprint
    assert got[15].near_edited > got[15].near_next  # 400 words
    assert simhash.compare_edits(empty).count() == 0
    odd = spark.createDataFrame([(None, "alone here"), (None, "alone here"), (None, "zz"), (1, "one two three four"), (1, "one two three four"), (1, "other text"), (2, None)] + [(3, "again and again and again")] * 5000, "doc_id long, text string")
    out = simhash.compare_edits(odd).collect()
    assert Counter(r.doc_id for r in out) == {None: 3, 1: 3, 2: 1, 3: 5000}
    # the next document of a repeated id is one of its texts, for the edit and for the likeness
    repeated = spark.createDataFrame([(0, "p q r s t u v w"), (1, "aa bb"), (1, "zz yy")], "doc_id long, text string")
    r = rows(simhash.compare_edits(repeated.where("doc_id = 0").union(repeated.where("doc_id = 1"))).where("doc_id = 0"))[0]
    chosen = next(t for t in ("aa bb", "zz yy") if hashlib.sha256(("p q r s t u " + t[:3]).encode()).hexdigest() == r.edited_sha256)
    assert r.near_next == 1 - (int(r.fingerprint, 16) ^ int(brute_simhash(chosen), 16)).bit_count() / 128


def brute_simhash(text):
    """The fingerprint from its definition, with a library's hash."""
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    runs = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [[" ".join(words)]] if words else []

    def hashed(parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64(p, seed=seed).intdigest()
        return seed

    weights = Counter(hashed([w.encode() for w in run]) for run in runs)
    weights = {t: n.bit_length() for t, n in weights.items()}
    out = ""
    for bits in (lambda t: t, lambda t: hashed([t.to_bytes(8, "little"), (0x5DEECE66D).to_bytes(8, "little")])):
        out += f"{sum(1 << i for i in range(64) if 2 * sum(w for t, w in weights.items() if bits(t) >> i & 1) > sum(weights.values())):016x}"
    return out


def test_simhash_by_definition(documents, texts):
    got = rows(simhash.compare_edits(documents, asks=F.col("doc_id") % 5 == 0, radius=3))
    prints = [brute_simhash(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == prints
    near = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count() <= 3
    assert [got[i].n_within for i in range(len(texts))] == [sum(near(p, q) for q in prints) if i % 5 == 0 else None for i, p in enumerate(prints)]


def test_simhash_search(spark):
    rnd = random.Random(2)
    base = [(rnd.getrandbits(64), rnd.getrandbits(64)) for _ in range(8)]
    near = [(a ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 3))), b ^ sum({1 << rnd.randrange(64) for _ in range(rnd.randint(0, 3))})) for a, b in base for _ in range(12)]
    signed = lambda x: (x & ((1 << 64) - 1)) - (1 << 64 if x >> 63 & 1 else 0)
    table = [(i, signed(a), signed(b)) for i, (a, b) in enumerate(base + near + base[:2])]
    df = spark.createDataFrame(table, "doc_id long, f0 long, f1 long")
    q = df.where("doc_id < 8")
    mask = (1 << 64) - 1
    for radius, blocks in ((3, 4), (3, 8), (1, 2)):
        want = {(a[0], b[0], d) for a in table[:8] for b in table if (d := ((a[1] ^ b[1]) & mask).bit_count() + ((a[2] ^ b[2]) & mask).bit_count()) <= radius}
        assert {tuple(r) for r in simhash.within(q, df, radius, blocks).select("query_id", "doc_id", "distance").collect()} == want


def learnable(rnd, n):
    bad = ["moron", "scum", "trash"]
    out = []
    for i in range(n):
        words = prose(rnd, rnd.randint(5, 80)).split(" ")
        if toxic := rnd.random() < 0.3:
            words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        good = rnd.random() < 0.7
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        out.append((i, text, int(toxic), int(good)))
    return out


def test_learnt_scores(spark, empty):
    data = learnable(random.Random(8), 500)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _, _ in data] + [(1000, None, 0.1), (1001, "", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, x, q) for i, _, x, q in data] + [(0, None, None), (9999, 1, 1)], "doc_id long, toxic int, quality int")
    for module, column, value in ((toxicity, "toxic", 2), (quality, "quality", 3)):
        model = fit_on_sample(docs, labels, column, F.col("doc_id") % 5 != 0, module.fit, max_docs=400)
        got = rows(module.score(docs, model))
        assert len(got) == 502 and all(0 <= r.score <= 1 for r in got.values())
        held = [d for d in data if d[0] % 5 == 0]
        assert np.mean([(got[d[0]].score >= 0.5) == d[value] for d in held]) > 0.95
        assert module.score(empty, model).count() == 0
        assert module.fit([], []) is not None
    tox = fit_on_sample(docs, labels, "toxic", F.lit(True), toxicity.fit, max_docs=400)
    found = toxicity.locate(docs, tox).collect()
    assert found and all(re.search("moron|scum|trash", r.sentence, re.I) for r in found)
    kept = toxicity.clean(docs, tox)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {d[0] for d in data if not d[2]} | {1000, 1001}


def test_sentences_cover_texts():
    s = toxicity.sentences(pa.array(["One. Two!\nThree", None, "", "No end", "a.b c"]))
    assert list(zip(s.doc, s.start, s.stop)) == [(0, 0, 4), (0, 4, 9), (0, 9, 10), (0, 10, 15), (1, 0, 0), (2, 0, 0), (3, 0, 6), (4, 0, 5)]


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [k for k, _ in corpus_pipeline.STAGES] and 0 < out.count() < 200
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns and stage(spark, docs.where("false"), "/root/testdata/sf0.001").count() == 0


def test_pieces_of_many_words(spark):
    """Words, ids and decoded texts stay in arrays: odd texts beside slices without words, and nothing in Python for each distinct word."""
    import sys

    import sentencepiece

    sp, m = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Merger.of(pieces.Vocabulary.read(MODEL))
    rnd = random.Random(2)
    odd = [None, "", " ", "▁", " ▁ x", "\n", "x" * 64 + " " + "x" * 65, "ab  ▁c ", "é①\n" * 30, "\0", "", "😀 " * 40, "end\n", " <0x0A></s>", None]
    rows_ = [(i, t) for i, t in enumerate(odd)] + [(100 + i, None) for i in range(3)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string").coalesce(1)
    got, ids = rows(pieces.digest(docs, MODEL)), rows(pieces.encode(docs, MODEL))
    for i, t in rows_:
        want = [*sp.encode(t or ""), 2]
        assert ids[i].ids == want and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(sp.decode(want).encode()).hexdigest()
    none = m.encode_texts(["", ""])
    assert none == [[], []]
    words = sorted({"▁" + "".join(rnd.choice("eaoin") + rnd.choice(["th", "n", "r", "st", "ch"]) for _ in range(rnd.randint(2, 6))) for _ in range(30_000)})
    assert m.encode_words(words[:3000]) == [m._agenda(w) for w in words[:3000]]
    text = " ".join(w[1:] for w in words)
    before = sys.getallocatedblocks()
    assert len(m.encode_texts([text])[0]) == len(words)
    assert sys.getallocatedblocks() - before < len(words) / 4  # what is kept for the next slice has no object for each word


def test_keys_of_a_slice(monkeypatch):
    """The sets of a slice are cut into segments together: the same keys as set by set, in as many steps for many sets as for one."""
    rng = np.random.default_rng(3)
    make = lambda n: np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    sets = [make(n) for n in [0, 1, 2, 3, 0, 5, 9, 17, 40, 41, 90, 200, 700, 0] + [60] * 40]
    sets.append(sets[8][:-1])
    for num, den in ((80, 100), (85, 100), (34, 100)):
        for common in (np.zeros(0, np.uint64), np.sort(np.concatenate([s[::4] for s in sets]))):
            listed = jaccard.key_lists(sets, num, den, common)
            assert [x.as_py() for x in listed] == [jaccard.keys(s, num, den, common).tolist() for s in sets] and not len(listed[0])
            assert not common.size or set(listed[8].as_py()) & set(listed[len(sets) - 1].as_py())
    steps, mix = [], jaccard.B.mix
    monkeypatch.setattr(jaccard.B, "mix", lambda h: steps.append(len(h)) or mix(h))
    jaccard.key_lists([make(60)], 80, 100)
    alone = len(steps)
    jaccard.key_lists([make(60) for _ in range(200)], 80, 100)
    assert len(steps) <= 3 * alone
