"""The queries of this subpackage: each applies one operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, jaccard, lm, pieces, pii, quality, repeats, rules, simhash, tokencount, toxicity
from .shared import fit_on_sample, fold, public_model, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_on_sample(documents, labels, "toxic", fold(F.col("doc_id"), 5) != 0, toxicity.fit, max_docs=6000)
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "worst_start", "worst_end")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10) != 0)
    return scored.select("doc_id", (fold(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_on_sample(documents, labels, "quality", fold(F.col("doc_id"), 3) != 1, quality.fit, max_docs=4000)
    scored = quality.score(documents, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "top_passage")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compare_edits(table(spark, sf_dir, "documents"), asks=F.col("doc_id") % 100 == 0)


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"), model or public_model("piece_bpe_32k.model"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str, key: str | None = None) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(documents, key or pii.session_key(spark))


def op8_token_counts(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return tokencount.count(table(spark, sf_dir, "documents"), model or public_model("piece_bpe_32k.model"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return rules.apply(documents, rules.fit_labelled(documents, table(spark, sf_dir, "labels")))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op1_toxicity": op1_toxicity, "op2_lm_scoring": op2_lm_scoring, "op3_quality": op3_quality, "op4_simhash": op4_simhash, "op5_sentencepiece": op5_sentencepiece, "op6_repeats": op6_repeats, "op7_pii": op7_pii, "op8_token_counts": op8_token_counts, "op9_jaccard_join": op9_jaccard_join, "op10_decontamination": op10_decontamination, "op11_quality_rules": op11_quality_rules, "op12_divergence": op12_divergence}


_JACCARD_SQL = """WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM words WHERE len(w) >= 4) UNION ALL SELECT doc_id, concat('short ', array_to_string(w, ' ')) FROM words WHERE len(w) BETWEEN 1 AND 3)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    links AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 85 * (na.n + nb.n - p.c)),
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.root, d.doc_id)) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS root FROM reach GROUP BY 1) r ON r.a = d.doc_id"""


_DIVERGENCE_SQL = """WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    t AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT k) >= 30), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
    c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3), g AS (SELECT DISTINCT lang, source FROM d),
    gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2), ln AS (SELECT lang, sum(n) AS n FROM c GROUP BY 1),
    p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (gn.n + 5 * v.v) AS p FROM gn JOIN kept k ON k.lang = gn.lang JOIN v ON v.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
    q AS (SELECT c.lang, c.term, 1 + 1000000000::HUGEINT * (sum(c.n) + 5) // (max(ln.n) + 5 * max(v.v)) AS q FROM c JOIN ln ON ln.lang = c.lang JOIN v ON v.lang = c.lang GROUP BY 1, 2),
    f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3),
    parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
        UNION ALL SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts) WHERE part = 'pair' OR rank <= 50"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; the others depend on hashes, learnt weights, merges or ciphers and are tested by brute force."""
    return {"op9_jaccard_join": _JACCARD_SQL, "op12_divergence": _DIVERGENCE_SQL}
