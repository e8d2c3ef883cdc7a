"""Registered queries of the training-data problems tagged llm, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import frequent, leaks, percentiles, spans, tokens
from millrace.session import written
from millrace.tables import load


def _measures(spark: SparkSession, sf_dir: str):
    """(measure, its rows, group, value) of problem 3."""
    records = load(spark, sf_dir, "records")
    month = F.coalesce(F.date_format("recorddate", "yyyy-MM"), F.lit("none"))
    for measure, kind, group, value in (("adrevenue", 1, F.substring("sourceip", 1, 8), F.col("adrevenue")), ("pagerank", 0, month, F.col("pagerank"))):
        yield measure, records.where(F.col("recordtype") == kind), group, value


def _answers(rows: DataFrame, group: Column, value: Column) -> DataFrame:
    return percentiles.percentiles(percentiles.merged_sketches(percentiles.partial_sketches(rows, group, F.col("recorddate"), value)))


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of ad revenue per address prefix and of page rank per month, from one
    sketch per group and day."""
    out = [_answers(rows, group, value).select(F.lit(measure).alias("measure"), "*") for measure, rows, group, value in _measures(spark, sf_dir)]
    return out[0].unionByName(out[1])


def p3_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's number of values, and whether its percentiles' true ranks are within their error."""
    out = []
    for measure, rows, group, value in _measures(spark, sf_dir):
        answers = written(_answers(rows, group, value), "answers")
        out.append(percentiles.bounds_hold(rows, group, value, answers).select(F.lit(measure).alias("measure"), "*"))
    return out[0].unionByName(out[1])


_FIELDS = (("kv_records", "key"), ("records", "sourceip"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [frequent.items_above(load(spark, sf_dir, t), c, 0.005).select(F.lit(f"{t}.{c}").alias("field"), "item") for t, c in _FIELDS]
    return parts[0].unionByName(parts[1])


def p4_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 most frequent values of each field with their counts."""
    parts = [frequent.top_items(load(spark, sf_dir, t), c, 100).select(F.lit(f"{t}.{c}").alias("field"), "item", "n") for t, c in _FIELDS]
    return parts[0].unionByName(parts[1])


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(load(spark, sf_dir, "documents"))


def p7_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the byte offsets at which each document's tokens end: where the last ends, and whether each ends
    behind the one before, so that the tokens cover the text."""
    ends = tokens.encode_corpus(load(spark, sf_dir, "documents"), offsets=True)
    rising = (F.size(F.array_distinct("ends")) == F.size("ends")) & (F.sort_array("ends") == F.col("ends"))
    return ends.select("doc_id", F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("bigint").alias("n_bytes"), rising.alias("rising"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p8_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of at least 13 words in which one word may be substituted."""
    return leaks.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_pairs(spans.find_repeats(load(spark, sf_dir, "documents")))


def p9_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct groups of documents that hold a common stretch: least and greatest member, members, the sum of their ids."""
    groups = spans.shared_groups(spans.find_repeats(load(spark, sf_dir, "documents")))
    sums = groups.groupBy("class_id").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"), F.count("*").alias("members"), F.sum("doc_id").alias("total"))
    return sums.drop("class_id")


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_report(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_percentiles, p3_bounds, p4_found, p4_top, p7_ids, p7_offsets, p8_found, p8_overlaps, p9_found, p9_groups, p9_shared)}


_WINDOWS = """
    WITH w AS (SELECT doc_id, i, md5_number(substr(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)),
    held AS (SELECT DISTINCT doc_id, h FROM w SEMI JOIN (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)) USING (h))
"""
_WORDS = "regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "p3_bounds": """
            SELECT 'adrevenue' AS measure, substr(sourceip, 1, 8) AS grp, count(*) AS n, true AS within FROM records WHERE recordtype = 1 AND isfinite(adrevenue) GROUP BY ALL
            UNION ALL SELECT 'pagerank', coalesce(strftime(recorddate, '%Y-%m'), 'none'), count(*), true FROM records WHERE recordtype = 0 AND pagerank IS NOT NULL GROUP BY ALL""",
        "p4_found": """
            SELECT 'kv_records.key' AS field, key AS item FROM kv_records WHERE key <> '' GROUP BY key HAVING count(*) >= 0.005 * (SELECT count(*) FROM kv_records)
            UNION ALL SELECT 'records.sourceip', sourceip FROM records WHERE sourceip <> '' GROUP BY sourceip HAVING count(*) >= 0.005 * (SELECT count(*) FROM records)""",
        "p4_top": """
            (SELECT 'kv_records.key' AS field, key AS item, count(*) AS n FROM kv_records WHERE key <> '' GROUP BY key ORDER BY n DESC, item LIMIT 100)
            UNION ALL (SELECT 'records.sourceip', sourceip, count(*) AS n FROM records WHERE sourceip <> '' GROUP BY sourceip ORDER BY n DESC, sourceip LIMIT 100)""",
        "p7_offsets": "SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, true AS rising FROM documents",
        "p8_found": f"""
            WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
            dw AS (SELECT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)),
            iw AS (SELECT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i))
            SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)""",
        "p9_found": _WINDOWS + "SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM held a JOIN held b USING (h) WHERE a.doc_id < b.doc_id",
        "p9_groups": _WINDOWS
        + "SELECT d[1] AS least, d[-1] AS greatest, len(d) AS members, CAST(list_sum(d) AS BIGINT) AS total FROM (SELECT DISTINCT list(doc_id ORDER BY doc_id) AS d FROM held GROUP BY h)",
        "p9_shared": _WINDOWS
        + """, islands AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 300 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island
                FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w SEMI JOIN held USING (h))),
            spans AS (SELECT doc_id, max(i) + 300 - min(i) AS n FROM islands GROUP BY doc_id, island)
            SELECT d.doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars, CAST(coalesce(sum(n), 0) AS BIGINT) AS shared_chars, count(n) AS spans, CAST(coalesce(max(n), 0) AS BIGINT) AS longest
            FROM documents d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id, text""",
        # 13 words with one substituted hold six equal ones in a row; along their diagonals runs of equal words
        # are found, and neighbouring runs with one word between them
        "p8_overlaps": f"""
            WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
            dw AS (SELECT doc_id, k, array_to_string(w[k:k + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS k FROM d)),
            iw AS (SELECT item_id, k, array_to_string(w[k:k + 5], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 4)) AS k FROM i)),
            diagonals AS (SELECT DISTINCT doc_id, item_id, dw.k - iw.k AS s FROM dw JOIN iw USING (g)),
            cells AS (SELECT doc_id, item_id, s, d.w AS dw, i.w AS iw, unnest(range(1, len(i.w) + 1)) AS k FROM diagonals JOIN d USING (doc_id) JOIN i USING (item_id)),
            equal AS (SELECT doc_id, item_id, s, k, k - row_number() OVER (PARTITION BY doc_id, item_id, s ORDER BY k) AS run FROM cells WHERE s + k >= 1 AND dw[s + k] = iw[k]),
            runs AS (SELECT doc_id, item_id, s, min(k) AS a, max(k) AS b FROM equal GROUP BY doc_id, item_id, s, run),
            spans AS (SELECT *, b - a + 1 AS one, CASE WHEN lead(a) OVER w = b + 2 THEN lead(b) OVER w - a + 1 END AS two FROM runs WINDOW w AS (PARTITION BY doc_id, item_id, s ORDER BY a)),
            best AS (SELECT doc_id, item_id, max(one) AS one, CASE WHEN max(two) > max(one) THEN {{'n': -max(two), 'u': 1}} ELSE {{'n': -max(one), 'u': 0}} END AS o FROM spans GROUP BY doc_id, item_id, s)
            SELECT doc_id, item_id, CAST(max(one) AS INT) AS exact_words, CAST(-min(o).n AS INT) AS overlap_words, CAST(min(o).u AS INT) AS substituted
            FROM best WHERE o.n <= -13 GROUP BY doc_id, item_id""",
    }
