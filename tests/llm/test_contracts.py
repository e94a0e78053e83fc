"""The queries of the corpus operators, whole, over small tables with nulls, null and repeated ids, repeated rows, long texts and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import MODEL, brute_components, brute_language_model, brute_repeats, brute_simhash, luhn, prose, rows, sets
from test_divergence import brute as brute_audit
from test_rules import brute as brute_counts

from skyquarry.llm import blocks, decontam, pii, quality, queries, toxicity
from skyquarry.llm.shared import fit_on_sample

ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, part int, _block string, _train int, _m string"
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards mix potions behind old stone walls"


def corpus():
    rnd = random.Random(21)
    out = [(i, prose(rnd, rnd.randint(1, 120))) for i in range(60)]
    out += [(100, None), (101, ""), (102, " \n"), (103, "x"), (104, out[3][1] + " ending"), (105, out[5][1]), (106, f"{prose(rnd, 20)} {PASSAGE} {prose(rnd, 20)}")]
    out += [(107, "write to jane.doe42@mail7.example.com now"), (108, "so bad. you moron, go. fine"), (200, "what a moron! yes"), (201, "scum and trash\nnothing else")]
    out += [(300, prose(rnd, 230_000))]  # more than a slice and than 1 MiB
    out += [out[7]] * 3 + [(8, "another text for a repeated id")] + [(None, out[9][1]), (None, "without a name"), (None, "without a name"), (None, None)]
    return out


def write(spark, folder, documents, labels, benchmark):
    data = [(i, t, "en", "s", len(t or ""), "odd", 1, "b", 7, "m") for i, t in documents]
    spark.createDataFrame(data, ODD).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def labels_of(documents):
    return [(i, int(len(t or "") % 3 > 0), int(bool(re.search("moron|scum|trash", t or "")))) for i, t in documents if i is not None]


@pytest.fixture(scope="module")
def documents():
    return corpus()


@pytest.fixture(scope="module")
def folder(spark, documents, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"), documents, [*labels_of(documents), (9999, 1, 1), (5, None, None)], [(1, PASSAGE), (2, None)])


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def held(i, k, rest=0):
    return zlib.crc32(("" if i is None else str(i)).encode()) % k == rest


@pytest.mark.parametrize("name,label,k,rest", [("op1_toxicity", "toxic", 5, 0), ("op3_quality", "quality", 3, 1)])
def test_scores(spark, documents, folder, tmp_path, name, label, k, rest):
    query = queries.queries()[name]
    df = query(spark, folder)
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    got = by_id(df)
    assert {i: len(v) for i, v in got.items()} == Counter(i for i, _ in documents)
    for i, found in got.items():
        for r in found:
            assert r.held_out == held(i, k, rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert got[5][0].score == got[105][0].score and got[100][0].score == got[101][0].score  # equal texts; null is empty
    # labels of held-out rows teach nothing
    turned = [(i, 1 - q, 1 - x) if held(i, k, rest) else (i, q, x) for i, q, x in labels_of(documents)]
    again = by_id(query(spark, write(spark, tmp_path / "turned", documents, [*turned, (9999, 1, 1), (5, None, None)], [(1, PASSAGE)])))
    assert all(sorted(r.score for r in again[i]) == sorted(r.score for r in got[i]) for i in got)
    # no labels at all: one score for all texts
    none = query(spark, write(spark, tmp_path / "none", documents[:20], [], [(1, PASSAGE)])).collect()
    assert len(none) == 20 and len({r.predicted for r in none}) == 1


def test_language_model_query(spark, documents, folder):
    df = queries.op2_lm_scoring(spark, folder)
    assert df.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    want, _ = brute_language_model([t for _, t in documents], [not held(i, 10) for i, _ in documents], 1 << 16)
    expected = {}
    for (i, _), w in zip(documents, want):
        expected.setdefault(i, []).append(w)
    got = by_id(df)
    assert got.keys() == expected.keys()
    for i, ws in expected.items():
        found = sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got[i])
        assert np.allclose(found, sorted(ws), rtol=1e-7) and all(r.held_out == held(i, 10) for r in got[i])


def test_fingerprint_query(spark, documents, folder):
    got = by_id(queries.op4_simhash(spark, folder))
    assert {i: len(v) for i, v in got.items()} == Counter(i for i, _ in documents)
    prints = {}
    for i, t in documents:
        if len(t or "") < 100_000:
            prints.setdefault(i, set()).add(brute_simhash(t))
    for i, p in prints.items():
        assert {r.fingerprint for r in got[i]} == p
    ids = sorted(i for i in got if i is not None)
    text = dict(reversed([d for d in documents if d[0] not in (None, 8)]))
    for a, b in zip(ids, [*ids[1:], ids[0]]):
        if 8 in (a, b):
            continue
        t, q = text[a] or "", len(text[a] or "") // 4
        assert {r.edited_sha256 for r in got[a]} == {hashlib.sha256((t[: len(t) - q] + (text[b] or "")[:q]).encode()).hexdigest()}


def test_sentencepiece_query(spark, documents, folder):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = Counter()
    for i, t in documents:
        ids = [*sp.encode(t or ""), 2]
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op5_sentencepiece(spark, folder, MODEL).collect()) == want


def test_repeats_query(spark, documents, folder):
    want = Counter((i, *w) for (i, _), w in zip(documents, brute_repeats([t for _, t in documents], 200)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op6_repeats(spark, folder).collect()) == want


def test_personal_data_query(spark, documents, folder):
    out = queries.op7_pii(spark, folder, "key")
    got = by_id(out)
    assert {i: len(v) for i, v in got.items()} == Counter(i for i, _ in documents)
    for i, t in documents:
        if i == 107:
            assert re.fullmatch(r"write to [a-z]{4}\.[a-z]{3}\d\d@\S+ now", got[i][0].text) and got[i][0].text != t
        else:
            assert t in {r.text for r in got[i]}


def test_token_count_query(spark, documents, folder):
    got = by_id(queries.op8_token_counts(spark, folder, MODEL))
    assert {i: len(v) for i, v in got.items()} == Counter(i for i, _ in documents)
    assert got[100][0].n_tokens == got[101][0].n_tokens == 0 and got[5][0].n_tokens == got[105][0].n_tokens > 0


def test_join_query(spark, documents, folder):
    ss = sets([t for _, t in documents], 4)
    roots = brute_components(ss, 85, 100)
    least = {}
    for (i, _), r in zip(documents, roots):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = Counter((i, len(s), least[r] if s else i) for (i, _), s, r in zip(documents, ss, roots))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in queries.op9_jaccard_join(spark, folder).collect()) == want


def test_decontamination_query(spark, documents, folder):
    got = by_id(queries.op10_decontamination(spark, folder))
    assert {i: len(v) for i, v in got.items()} == Counter(i for i, _ in documents)
    assert {i for i, v in got.items() if any(r.contaminated for r in v)} == {106}


def test_empty_tables(spark, tmp_path):
    folder = write(spark, tmp_path / "empty", [], [], [])
    for name, query in queries.queries().items():
        df = query(spark, folder)
        assert ("lang" if name == "op12_divergence" else "doc_id") in df.columns and df.count() == 0, name


@pytest.mark.parametrize("operator,label", [(toxicity, "toxic"), (quality, "quality")])
def test_scores_are_of_the_text_alone(spark, documents, operator, label):
    """One model, four ways of dealing out the rows: the same bits, for equal texts too."""
    df = spark.createDataFrame(documents, "doc_id long, text string")
    labels = spark.createDataFrame(labels_of(documents), "doc_id long, quality int, toxic int")
    model = fit_on_sample(df, labels, label, F.lit(True), operator.fit, max_docs=500)
    dealt = [df.coalesce(1), df.repartition(7), df.orderBy(F.desc("doc_id")).coalesce(2), df.repartition(80)]
    scores = [sorted(((r.doc_id is None, r.doc_id or 0), r.score) for r in operator.score(d, model).collect()) for d in dealt]
    assert all(s == scores[0] for s in scores[1:])
    by_text = {}
    for r in operator.score(df.withColumn("doc_id", F.coalesce("text", F.lit(""))), model).collect():
        by_text.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(v) == 1 for v in by_text.values())


def test_rules_and_audit_queries(spark, documents, folder):
    got = by_id(queries.op11_quality_rules(spark, folder))
    want = {}
    for i, t in documents:
        want.setdefault(i, []).append(brute_counts(t))
    assert {i: sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}
    audit = sorted(tuple(r) for r in queries.op12_divergence(spark, folder).select("lang", "source", "part", "item", "value", "rank").collect())
    assert audit == brute_audit([(t, "en", "s") for _, t in documents], 30)


def test_noisy_or_of_sentences(spark, documents):
    """A document's score is 1 - the product of 1 - p over its sentences, each scored as a document of its own."""
    df = spark.createDataFrame(documents[:72], "doc_id long, text string")
    labels = spark.createDataFrame(labels_of(documents), "doc_id long, quality int, toxic int")
    model = fit_on_sample(df, labels, "toxic", F.lit(True), toxicity.fit, max_docs=500)
    scores = rows(toxicity.score(df.where("doc_id < 300"), model))
    for i, t in documents[:72]:
        if i is None or i >= 300:
            continue
        data = (t or "").encode()
        s = toxicity.sentences(pa.array([t or ""], pa.string()))
        alone = pa.array([data[a:b].decode() for a, b in zip(s.start, s.stop)], pa.string())
        each = [model.documents(toxicity.sentences(alone.slice(k, 1)), 1)[0][0] for k in range(len(alone))]
        assert np.isclose(scores[i].score, 1 - np.prod([1 - p for p in each])) and scores[i].n_sentences == len(each)


def test_gated_attention_by_definition():
    """Scores and their slopes from plain loops over the passages."""
    rnd = random.Random(2)
    texts = [prose(rnd, n) for n in (0, 1, 40, 900, 1500)]
    model = quality.fit(texts * 4, [0, 1, 0, 1, 1] * 4, epochs=3)
    bag, p = quality.passages(pa.array(texts, pa.string())), model.p
    got, attention = model.score(bag, len(texts))
    for d in range(len(texts)):
        mine = np.flatnonzero(bag.doc == d)
        assert len(mine) == max(1, -(-len(texts[d].encode()) // quality.PASSAGE))
        h = [np.tanh((bag.x[i] - model.mean) / model.scale @ p["W"] + p["b"]) for i in mine]
        e = [float(np.exp((np.tanh(x @ p["V"]) / (1 + np.exp(-(x @ p["U"])))) @ p["w"])) for x in h]
        assert np.allclose(attention[mine], np.array(e) / sum(e))
        z = sum(x * y for x, y in zip(h, e)) / sum(e)
        assert np.isclose(got[d], 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0]))))


def test_copies_of_one_row_spread_over_blocks(spark):
    df = spark.createDataFrame([(None, "the same text")] * 4000, "doc_id long, text string").repartition(4)
    held_rows = blocks.packed(df, 8).collect()
    sizes = Counter()
    for r in held_rows:
        sizes[r.part] += blocks.documents_of([(r.key, r.kind, r.blob)]).num_rows
    assert sum(sizes.values()) == 4000 and len(sizes) == 8 and max(sizes.values()) < 700
    one = [(r.key, r.kind, r.blob) for r in held_rows]
    assert blocks.documents_of(one).equals(blocks.documents_of(one[::-1]))


def test_pipeline_stages(spark):
    """What each stage keeps and writes, from plain versions over its own input."""
    import sentencepiece

    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    model = fit_on_sample(docs, spark.read.parquet(f"{folder}/labels.parquet"), "toxic", F.lit(True), toxicity.fit, max_docs=6000)
    clean = {r.doc_id for r in toxicity.score(docs, model).where("score < 0.5").collect()}
    assert {r.doc_id for r in stages["toxicity"](spark, docs, folder).collect()} == clean
    ids = sorted(text)
    roots = brute_components(sets([text[i] for i in ids], 5), 80, 100)
    assert {r.doc_id for r in stages["near duplicates"](spark, docs, folder).collect()} == {i for k, i in enumerate(ids) if roots[k] == k}
    flagged = {r.doc_id for r in decontam.flags(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).where("contaminated").collect()}
    assert {r.doc_id for r in stages["decontamination"](spark, docs, folder).collect()} == set(ids) - flagged
    plain = {r.doc_id: r.text for r in pii.pseudonymise(docs, pii.session_key(spark)).collect()}
    hidden = stages["personal data"](spark, docs, folder).collect()
    assert {r.doc_id: r.text for r in hidden} == plain and all(r.n_chars == len(r.text or "") for r in hidden)
    card = next(s for s in (f"453201511283036{i}" for i in range(10)) if luhn(s))
    one = spark.createDataFrame([(1, f"card {card} a@b.example.com", "en", "s", 3)], docs.schema)
    assert card not in stages["personal data"](spark, one, folder).first().text
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert {r.doc_id: r.n_tokens for r in stages["tokens"](spark, docs, folder).collect()} == {i: len(sp.encode(t or "")) + 1 for i, t in text.items()}
