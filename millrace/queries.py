"""Registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import compaction, hotkeys, malformed, references
from millrace.plans import reference_queries
from millrace.tables import load


def p1_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of raw_lines consolidated by copying encoded blocks; the files replaced and their rows."""
    done = compaction.consolidate_lines(load(spark, sf_dir, "raw_lines"))
    return done.groupBy("name").agg(F.sum("rows").alias("rows"))


def p1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as read from the consolidated files."""
    done = compaction.consolidate_lines(load(spark, sf_dir, "raw_lines"))
    files = [r.out_file for r in done.select("out_file").distinct().toLocalIterator()]
    columns = ["file_name", "line_no", "recordtype", "key", "value"]
    return spark.read.parquet(*files).select(*columns) if files else load(spark, sf_dir, "raw_lines").select(*columns).limit(0)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.small_files(compaction.latest_listing(load(spark, sf_dir, "file_infos"))).select("name")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return malformed.rejected(load(spark, sf_dir, "raw_lines")).select("line_id", "reason")


def p2_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return malformed.valid_rows(load(spark, sf_dir, "raw_lines"), malformed.RANKING, "line_id")


def p2_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return malformed.valid_rows(load(spark, sf_dir, "raw_lines"), malformed.VISIT, "line_id")


def _page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits, records = load(spark, sf_dir, "visits"), load(spark, sf_dir, "records")
    target = F.when(F.col("recordtype") == 0, F.col("pageurl")).when(F.col("recordtype") == 1, F.col("desturl"))
    return references.references(visits, "visits", F.col("desturl"), "visitdate", "visit_id").unionByName(references.references(records, "records", target, "recorddate", "record_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphans(_page_references(spark, sf_dir), load(spark, sf_dir, "rankings"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_report(_page_references(spark, sf_dir), load(spark, sf_dir, "rankings"))


def p6_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 90th percentile of the numeric values of each (job, key), exactly."""
    return hotkeys.exact_quantiles(load(spark, sf_dir, "kv_records"), ["jobnumber", "key"], hotkeys.numeric(F.col("value")), (0.5, 0.9))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotkeys.dominant_keys(load(spark, sf_dir, "kv_records"), ["jobnumber"], ["key"], 0.1, by=["binid"])


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotkeys.key_totals(load(spark, sf_dir, "kv_records"), ["jobnumber", "key"], F.col("value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_method, p1_found, p1_lines, p2_found, p2_rankings, p2_visits, p5_found, p5_report, p6_method, p6_found, p6_totals)
    return reference_queries.queries() | {f.__name__: f for f in found}


_FLOAT = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_PARSED = r"""
WITH chomped AS (SELECT *, CASE WHEN value LIKE '%' || chr(13) THEN substr(value, 1, length(value) - 1) ELSE value END AS v FROM raw_lines),
cut AS (SELECT *, regexp_full_match(v, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') AS fine,
    list_transform(regexp_extract_all(',' || v, '(?s),("(?:[^"]|"")*"|[^",]*)', 1), lambda f: CASE WHEN f LIKE '"%' THEN replace(substr(f, 2, length(f) - 2), '""', '"') ELSE f END) AS f FROM chomped),
reasons AS (SELECT *, CASE
    WHEN fine IS NOT TRUE THEN 'quoting'
    WHEN recordtype IS NULL OR recordtype NOT IN ('0', '1') THEN 'type'
    WHEN len(f) <> CASE recordtype WHEN '0' THEN 3 ELSE 9 END THEN 'arity'
    WHEN recordtype = '0' AND NOT (regexp_full_match(f[2], '[+-]?[0-9]+') AND try_cast(f[2] AS BIGINT) IS NOT NULL
        AND regexp_full_match(f[3], '[+-]?[0-9]+') AND try_cast(f[3] AS BIGINT) IS NOT NULL) THEN 'value'
    WHEN recordtype = '1' AND NOT (regexp_full_match(f[9], '[+-]?[0-9]+') AND try_cast(f[9] AS BIGINT) IS NOT NULL
        AND regexp_full_match(f[4], '__FLOAT__') AND coalesce(isfinite(try_cast(f[4] AS DOUBLE)), false)
        AND regexp_full_match(f[3], '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(f[3] AS DATE) IS NOT NULL) THEN 'value'
    WHEN key IS NULL OR key <> CASE recordtype WHEN '0' THEN f[1] ELSE f[2] END THEN 'key'
    END AS reason FROM cut)
""".replace("__FLOAT__", _FLOAT)
_REFS = """
WITH refs AS (SELECT 'visits' AS src, visit_id AS row_id, desturl AS url, visitdate AS day FROM visits
    UNION ALL SELECT 'records', record_id, CASE recordtype WHEN 0 THEN pageurl WHEN 1 THEN desturl END, recorddate FROM records),
orphans AS (SELECT src, coalesce(strftime(day, '%Y-%m'), 'none') AS period, row_id, url FROM refs WHERE url <> '' AND NOT EXISTS (
    SELECT 1 FROM rankings r WHERE r.pageurl = refs.url AND (refs.day IS NULL OR ((r.listed_on IS NULL OR r.listed_on <= refs.day) AND (r.removed_on IS NULL OR refs.day < r.removed_on)))))
"""
_NUMBERS = f"WITH n AS (SELECT jobnumber, key, value, CASE WHEN regexp_full_match(value, '{_FLOAT}') AND isfinite(try_cast(value AS DOUBLE)) THEN try_cast(value AS DOUBLE) END AS v FROM kv_records)"


def oracle_sql() -> dict[str, str]:
    return reference_queries.oracle_sql() | {
        "p1_found": """
            WITH spelled AS (SELECT *, 's3://' || array_to_string(list_reduce(
                list_transform(list_filter(string_split(substr(name, 6), '/'), lambda x: x NOT IN ('', '.')), lambda x: [x]),
                lambda a, x: CASE WHEN x[1] = '..' THEN a[:-2] ELSE a || x END, []::VARCHAR[]), '/') AS short FROM file_infos),
            latest AS (SELECT short, size FROM spelled QUALIFY row_number() OVER (PARTITION BY short ORDER BY listed_at DESC NULLS LAST, listing_id DESC) = 1),
            small AS (SELECT short AS name, regexp_replace(short, '/[^/]*$', '') AS folder FROM latest
                WHERE size BETWEEN 1 AND 1048575 AND NOT regexp_matches(short, '/[._][^/]*$'))
            SELECT name FROM small QUALIFY count(*) OVER (PARTITION BY folder) > 1""",
        "p1_method": "SELECT file_name AS name, CAST(count(DISTINCT line_no) AS BIGINT) AS rows FROM raw_lines WHERE file_name IS NOT NULL AND line_no IS NOT NULL GROUP BY file_name",
        "p1_lines": "SELECT file_name, line_no, recordtype, key, value FROM raw_lines WHERE file_name IS NOT NULL AND line_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_name, line_no ORDER BY loaded_at DESC NULLS LAST, line_id DESC) = 1",
        "p2_found": _PARSED + "SELECT line_id, reason FROM reasons WHERE reason IS NOT NULL",
        "p2_rankings": _PARSED + "SELECT line_id, f[1] AS pageurl, CAST(f[2] AS BIGINT) AS pagerank, CAST(f[3] AS BIGINT) AS avgduration FROM reasons WHERE reason IS NULL AND recordtype = '0'",
        "p2_visits": _PARSED
        + "SELECT line_id, f[1] AS sourceip, f[2] AS desturl, CAST(f[3] AS DATE) AS visitdate, CAST(f[4] AS DOUBLE) AS adrevenue, f[5] AS useragent, f[6] AS countrycode, f[7] AS languagecode, f[8] AS searchword, CAST(f[9] AS BIGINT) AS duration FROM reasons WHERE reason IS NULL AND recordtype = '1'",
        "p5_found": _REFS + "SELECT src, period, row_id FROM orphans",
        "p5_report": _REFS + "SELECT src, period, count(*) AS orphans, count(DISTINCT url) AS urls FROM orphans GROUP BY ALL",
        "p6_method": _NUMBERS
        + ", probs AS (SELECT unnest([0.5, 0.9]) AS prob), ranked AS (SELECT jobnumber, key, v, row_number() OVER w AS rank, count(*) OVER (PARTITION BY jobnumber, key) AS n FROM n WHERE v IS NOT NULL WINDOW w AS (PARTITION BY jobnumber, key ORDER BY v)) SELECT jobnumber, key, n AS n_numbers, CAST(prob AS DOUBLE) AS prob, v AS quantile FROM ranked, probs WHERE rank = greatest(1, ceil(n * CAST(prob * 10 AS BIGINT) / 10))",
        "p6_found": """
            WITH c AS (SELECT jobnumber, binid, key, count(*) AS n FROM kv_records GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY jobnumber, key) AS kn, sum(n) OVER (PARTITION BY jobnumber) AS jn FROM c)
            SELECT jobnumber, binid, key FROM k WHERE kn * 10 >= jn""",
        "p6_totals": _NUMBERS + " SELECT jobnumber, key, count(*) AS n_rows, count(v) AS n_numbers, coalesce(CAST(sum(CASE WHEN v IS NOT NULL THEN CAST(value AS DECIMAL(38, 12)) END) AS DOUBLE), 0) AS total FROM n GROUP BY ALL",
    }
