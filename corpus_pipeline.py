"""The training-corpus pipeline: each stage reads what its predecessor kept, and all but the last return the columns of documents.

Every stage's table is written as Parquet to the session's shared checkpoint folder and read again for the next, so a lost executor
costs no more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquarry.llm import decontam, jaccard, pieces, pii, toxicity
from skyquarry.llm.shared import fit_on_sample, materialise, public_model, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.5 or more go; the model learns from the labelled rows of the unfiltered table."""
    model = fit_on_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", F.lit(True), toxicity.fit, max_docs=6000)
    return toxicity.clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by sets of five-word runs with a similarity of 0.8 or more, the fixed rule for such stages, one document stays."""
    return jaccard.keep_one(docs, k=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms, and n_chars follows the text."""
    out = pii.pseudonymise(docs, pii.session_key(spark), counts=False)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else out


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them."""
    return pieces.digest(docs, public_model("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", replace_personal_data),
    ("tokens", tokenise),
]

#: Learnt scores and tokenizer merges have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
    return docs
