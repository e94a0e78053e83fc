"""Quality rules: counts against a plain version, the classifier on held-out rows, and what a score may depend on."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_llm import prose

from skyquarry.llm import queries, rules

COLUMNS = "doc_id long, text string, n_words long, quality string, kept int"


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(zip(w, w[1:], w[2:]))
    marked = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), sum(x in lines[:i] for i, x in enumerate(lines)), len(marked)


def junk(rnd, n):
    return " ".join(rnd.choice(("CLICK!!", "win$$$", "buy###", "xx|", "FREE***")) + rnd.choice("abcdef") for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(9)
    out = [prose(rnd, n) for n in (0, 1, 2, 3, 49, 50, 51, 120, 400)] + [junk(rnd, 80)]
    loop = "one two three " * 40
    out += [None, "", " \n\t", "\x0b\x0c\r", "a b c a b c", loop, loop + prose(rnd, 119), "x\nx\n x\nx\x00\n\n\n", "é ü ß 日本語 🙂" * 30, "###" * 50]
    out += [out[7]] * 2 + ["w" * 3000 + " tail", prose(rnd, 3000), "same line\n" * 200]
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@pytest.mark.parametrize("block", [1 << 20, 97])
def test_base_counts(monkeypatch, texts, block):
    monkeypatch.setattr(rules, "BLOCK", block)
    array = pa.array(texts, pa.string())
    codes, offsets = rules.code_points(array)
    got = rules.base_counts(array, codes, offsets, rules.words_of(codes, offsets))
    assert list(zip(*(got[c].tolist() for c in COUNTS))) == [brute(t) for t in texts]


def plain_logit(model, text):
    """The logit by definition: means of weights, n-gram by n-gram."""
    z, t = model.intercept, text or ""
    codes, offsets = rules.code_points(pa.array([t]))
    w = rules.words_of(codes, offsets)
    kinds = [*rules.word_slots(w), *(np.concatenate([rules.char_slots(codes[i : i + k], k) for i in range(len(codes) - k + 1)] or [np.zeros(0, int)]) for k in (3, 4))]
    for slots in kinds:
        z += int(model.weights[slots].astype(np.int64).sum()) / (max(len(slots), 1) * rules.UNIT)
    return z


def some_model(rnd):
    rows = [(prose(rnd, rnd.randint(60, 150)), 1) for _ in range(90)] + [(junk(rnd, rnd.randint(60, 150)), 0) for _ in range(40)]
    return rules.fit([t for t, _ in rows], [y for _, y in rows])


@pytest.mark.parametrize("block", [1 << 20, 61])
def test_scores_by_definition_and_alone(monkeypatch, texts, block):
    """A logit is a function of the text: the same bits in any slice, with any blocks."""
    model = some_model(random.Random(1))
    want = [plain_logit(model, t) for t in texts]
    monkeypatch.setattr(rules, "BLOCK", block)
    for k in (1, 3, len(texts)):
        got = []
        for i in range(0, len(texts), k):
            codes, offsets = rules.code_points(pa.array(texts[i : i + k], pa.string()))
            got += model.logits(codes, offsets, rules.words_of(codes, offsets)).tolist()
        assert np.allclose(got, want, rtol=0, atol=1e-9)
        if k == 1:
            alone = got
        assert got == alone


def test_held_out_rows_and_calibration():
    rnd = random.Random(4)
    model = some_model(rnd)
    mixed = lambda share: " ".join(rnd.choice(junk(rnd, 3).split() if rnd.random() < share else prose(rnd, 3).split()) for _ in range(90))
    probability = lambda t: model.probability(np.array([plain_logit(model, t)]))[0]
    assert all(probability(prose(rnd, 80)) > 0.9 for _ in range(20)) and all(probability(junk(rnd, 80)) < 0.1 for _ in range(20))
    by_share = [np.mean([probability(mixed(s)) for _ in range(8)]) for s in (0, 0.3, 0.7, 1)]
    assert by_share == sorted(by_share, reverse=True)


def test_platt_gives_the_shares():
    """On logits whose odds are known the probabilities agree with the shares of good rows."""
    rng = np.random.default_rng(2)
    z = rng.normal(0, 2, 20_000)
    y = (rng.random(len(z)) < 1 / (1 + np.exp(-(1.7 * z - 0.6)))).astype(float)
    slope, shift = rules.platt(z, y)
    assert abs(slope - 1.7) < 0.1 and abs(shift + 0.6) < 0.1


def test_query(spark, tmp_path, texts):
    rnd = random.Random(6)
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[7]), (None, None), (5, "another text of a repeated id")]
    good, bad = [(1000 + i, prose(rnd, rnd.randint(55, 120))) for i in range(60)], [(2000 + i, junk(rnd, rnd.randint(55, 120))) for i in range(30)]
    rows = docs + good + bad
    spark.createDataFrame([(i, t, 1, "q", 1) for i, t in rows], COLUMNS).repartition(3).write.parquet(f"{tmp_path}/a/documents.parquet")
    labels = [(i, int(i < 2000)) for i, _ in good[:40] + bad[:20]] + [(1000, None), (None, 1), (77777, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/a/labels.parquet")
    df = queries.op11_quality_rules(spark, f"{tmp_path}/a")
    assert {"doc_id", *COUNTS, "base_failed", "kept"} <= set(df.columns)
    got = df.collect()
    plain = lambda r: (r.doc_id, *(r[c] for c in COUNTS))
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(map(plain, got), key=key) == sorted(((i, *brute(t)) for i, t in rows), key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed and r.quality >= 0.5)
    kept = {r.doc_id for r in got if r.kept}
    assert {i for i, _ in good[40:]} <= kept and not {i for i, _ in bad} & kept
    same = [r.quality for r in got if r.n_words == 120 and r.doc_id in (7, 20, 21, None)]
    assert len(same) == 4 and len(set(same)) == 1  # equal texts, equal scores
    # other partitions, other neighbours: the same bits
    spark.createDataFrame([(i, t, 1, "q", 1) for i, t in rows[::-1]], COLUMNS).repartition(7).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame(labels[::-1], "doc_id long, quality int").write.parquet(f"{tmp_path}/b/labels.parquet")
    again = queries.op11_quality_rules(spark, f"{tmp_path}/b").collect()
    whole = lambda rs: sorted(map(repr, ((*plain(r), r.quality, r.kept) for r in rs)))
    assert whole(again) == whole(got)


def test_few_or_no_labels(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"{'word ' * 30}{i} {'and on ' * 20}{i}", 1, "q", 1) for i in range(5)], COLUMNS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.quality for r in rules.apply(docs, rules.fit_labelled(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")
    assert {round(r.quality, 9) for r in rules.apply(docs, rules.fit_labelled(docs, one)).collect()} == {0.75}
    assert rules.apply(docs.where("false"), rules.fit_labelled(docs.where("false"), one)).count() == 0


