"""The jobs as queries: each runs twice into a new folder below the shared one and gives its whole output as it then stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import incremental_catalog, sidecar_audit
from skyquarry.model import oracle
from skyquarry.session import new_folder


def job1_incremental_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary by night; the second run finds no new file."""
    out = new_folder(spark, "incremental-catalog")
    for _ in range(2):
        incremental_catalog.run(spark, f"{sf_dir}/events.parquet", sf_dir, out)
    return incremental_catalog.Output(out).nights(spark)


def job2_sidecar_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text file with its copies; the second run finds no root due."""
    out = new_folder(spark, "sidecar-audit")
    for _ in range(2):
        sidecar_audit.run(spark, f"{sf_dir}/documents.parquet", out, {"now": "2024-03-01 12:00:00"})
    return sidecar_audit.copies(spark, out)


QUERIES = {"job1_incremental_catalog": job1_incremental_catalog, "job2_sidecar_audit": job2_sidecar_audit}

ORACLES = {
    "job1_incremental_catalog": oracle("SELECT session_night, image_type, object_canonical, rig, filter, COUNT(*) AS n, CAST(SUM(exposure_s) AS BIGINT) AS exposure, MIN(date_obs_utc) AS first_utc, MAX(date_obs_utc) AS last_utc FROM v_frames GROUP BY 1, 2, 3, 4, 5"),
    "job2_sidecar_audit": r"""WITH texts AS (SELECT CONCAT('/', COALESCE(source, '')) AS root_id, CONCAT(COALESCE(lang, ''), '/doc', CAST(doc_id AS VARCHAR), '.txt') AS rel_path, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id % 1000000) AS mtime_utc, COALESCE(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
        measured AS (SELECT root_id, rel_path, CAST(strlen(text) AS BIGINT) AS size_bytes, md5(text) AS content_key, mtime_utc, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_words FROM texts),
        files AS (SELECT * FROM measured QUALIFY row_number() OVER (PARTITION BY root_id, rel_path ORDER BY size_bytes DESC, content_key DESC, mtime_utc DESC) = 1)
        SELECT CAST(CONCAT('0x', substr(md5(CONCAT(root_id, '|', rel_path)), 1, 15)) AS BIGINT) AS file_id, root_id, rel_path, size_bytes, mtime_utc, 'ok' AS file_status, content_key, 'add' AS outcome, COUNT(*) OVER (PARTITION BY content_key) AS copies,
        first_value(root_id) OVER w AS keep_root, first_value(rel_path) OVER w AS keep_path, root_id = first_value(root_id) OVER w AND rel_path = first_value(rel_path) OVER w AS keeper, n_lines, n_words
        FROM files WINDOW w AS (PARTITION BY content_key ORDER BY root_id, rel_path)""",
}
