"""Queries of the map/reduce operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.hashing import fnv1_bin
from millrace.functions.text import fixed6, prefix, strict_date, strict_float, strict_int, tokens, words
from millrace.operators import aggregates, filters, joins, shuffle
from millrace.plans.job import Job, Pipeline, map_pairs, reduce_pairs
from millrace.plans.programs import PROGRAMS, RANKING, VISIT
from millrace.session import scratch, spread
from millrace.sources.sinks import write_key_value
from millrace.sources.text import delimited, key_value, text_lines, union_inputs
from millrace.streaming.counts import windowed_counts
from millrace.tables import load

_STRINGS = ("order", "customer", "price", "day")


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spread(load(spark, sf_dir, "documents").select("text")).select(F.explode(words(F.col("text"))).alias("word"))
    return aggregates.count_by(found, "word")


def tokenize_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spread(load(spark, sf_dir, "documents").select("text")).select(F.explode(tokens(F.col("text"))).alias("token"))
    return aggregates.count_by(found, "token")


def _as_text(df: DataFrame, label: str) -> str:
    """A frame of one text column as text files; where."""
    place = scratch(df.sparkSession, label)
    df.write.option("lineSep", "\n").text(place)
    return place


def scan_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as text files, read line by line; how often each line occurs."""
    place = _as_text(load(spark, sf_dir, "documents").where("text IS NOT NULL").select("text"), "lines")
    return aggregates.count_by(text_lines(spark, place), "value")


def kv_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one, two and three tab-separated fields."""
    parts = [F.when(F.col("event_id") % 3 >= i, c) for i, c in enumerate((F.col("event_type"), F.col("user_id").cast("string"), F.col("props")))]
    return key_value(load(spark, sf_dir, "events").select(F.concat_ws("\t", *parts).alias("value")))


def _text_tables(spark: SparkSession, sf_dir: str, *tables: str) -> list[str]:
    """The benchmark's tables as comma-separated text files, nulls as empty fields."""
    names = {"rankings": RANKING, "visits": VISIT}
    out = []
    for t in tables:
        cells = [F.coalesce(F.col(c).cast("decimal(38,10)" if c == "adrevenue" else "string").cast("string"), F.lit("")) for c in names[t]]
        out.append(_as_text(load(spark, sf_dir, t).select(F.concat_ws(",", *cells).alias("value")), t))
    return out


def program_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's scan over text files."""
    return PROGRAMS["scan"].plan(spark, *_text_tables(spark, sf_dir, "rankings"))


def program_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's aggregation over text files; sums to three decimals."""
    out = PROGRAMS["aggregate"].plan(spark, *_text_tables(spark, sf_dir, "visits"))
    return out.select("key", F.round(F.col("value").cast("double"), 3).alias("total"))


def program_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's join over two text inputs; averages to three decimals."""
    out = PROGRAMS["join"].plan(spark, *_text_tables(spark, sf_dir, "rankings", "visits"))
    pair = F.split("value", "\t")
    return out.select("key", F.round(pair[0].cast("double"), 3).alias("avg_rank"), F.round(pair[1].cast("double"), 3).alias("avg_revenue"))


def min_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smaller of two numbers of each row."""
    return load(spark, sf_dir, "part").select("p_partkey", F.least("p_size", F.lit(25)).alias("smaller"))


def kv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoder itself, counted: pairs of kv_records written as lines and read again."""
    lines = load(spark, sf_dir, "kv_records").select(F.concat_ws("\t", "key", "value").alias("value"))
    return aggregates.count_by(key_value(lines), "key", "value")


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as comma-separated text; some with a wrong number, date or number of fields."""
    k = F.col("o_orderkey")
    price = F.when(k % 7 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    day = F.when(k % 11 == 0, F.lit("1995-13-01")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    extra = F.when(k % 13 == 0, F.lit("extra"))
    return load(spark, sf_dir, "orders").select(F.concat_ws(",", k.cast("string"), F.col("o_custkey").cast("string"), price, day, extra).alias("value"))


def parse_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = delimited(_order_lines(spark, sf_dir), _STRINGS)
    return rows.select(strict_int(F.col("order")).alias("o"), strict_int(F.col("customer")).alias("c"), strict_float(F.col("price")).alias("price"), strict_date(F.col("day")).alias("day"))


def scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.above(load(spark, sf_dir, "lineitem"), F.col("l_quantity"), 45).select("l_orderkey", "l_linenumber", "l_quantity")


def filter_date_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.before(delimited(_order_lines(spark, sf_dir), _STRINGS), "day", "2000-01-01").select("order", "day")


def filter_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.starts_with(load(spark, sf_dir, "part"), "p_type", "S").select("p_partkey", "p_type")


def filter_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.count_by(filters.in_list(load(spark, sf_dir, "events"), "event_type", ["click", "error", "click"]), "event_type")


def agg_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.count_by(load(spark, sf_dir, "events"), "event_type")


def agg_sum_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.sum_by(load(spark, sf_dir, "orders"), [prefix(F.col("o_orderpriority"), 8).alias("pre")], F.col("o_totalprice"))


def visits_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's aggregation on visits: revenue by the first 8 characters of the address."""
    return aggregates.sum_by(load(spark, sf_dir, "visits"), [prefix(F.col("sourceip"), 8).alias("pre")], F.col("adrevenue"), scale=10)


def agg_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return aggregates.multi_agg(load(spark, sf_dir, "lineitem"), ["l_returnflag"], avg_qty=aggregates.exact_avg(q), avg_price=aggregates.exact_avg(p), n=F.count("*"))


def group_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aggregates.collect_by(load(spark, sf_dir, "nation"), ["n_regionkey"], F.col("n_name"))
    return rows.select("n_regionkey", F.concat_ws(",", "items").alias("names"))


def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_nationkey")
    return joins.inner_equi(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), customers, "o_custkey", "c_custkey")


def join_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: filter, join and two averages in one plan."""
    orders = load(spark, sf_dir, "orders").where("o_orderdate < timestamp_ntz'2000-01-01 00:00:00'").select("o_custkey", "o_totalprice")
    both = joins.inner_equi(orders, load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "o_custkey", "c_custkey")
    return both.groupBy("c_custkey").agg(aggregates.exact_avg(F.col("c_acctbal")).alias("avg_bal"), aggregates.exact_avg(F.col("o_totalprice")).alias("avg_price"))


def visits_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's join on visits and rankings: average rank and revenue by address."""
    visits = load(spark, sf_dir, "visits").where("visitdate < date'2000-01-01'").select("sourceip", "desturl", "adrevenue")
    both = joins.inner_equi(visits, load(spark, sf_dir, "rankings").select("pageurl", "pagerank"), "desturl", "pageurl")
    return both.groupBy("sourceip").agg(aggregates.exact_avg(F.col("pagerank")).alias("avg_rank"), aggregates.exact_avg(F.col("adrevenue"), 10).alias("avg_revenue"), F.count("*").alias("n"))


def _pairs_of_words(df: DataFrame) -> DataFrame:
    return df.select(F.explode(words(F.col("value"))).alias("key"), F.lit("1").alias("value"))


def _count_pairs(df: DataFrame) -> DataFrame:
    return aggregates.count_by(df, "key", name="value")


def _text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents").select("text")).select(F.lit("").alias("key"), F.col("text").alias("value"))


def multi_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two chained jobs in one plan: count words, keep those that start with t."""
    chain = Pipeline([Job(_pairs_of_words, _count_pairs), Job(lambda df: filters.starts_with(df, "key", "t"))])
    return chain.over(_text_pairs(spark, sf_dir)).select(F.col("key").alias("word"), F.col("value").alias("n"))


def multi_source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"))
    both = union_inputs(("customer", c), ("supplier", s))
    return both.groupBy("source", "nation").agg(F.count("*").alias("n"), F.count("segment").alias("segments"))


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "region").select("*")


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "supplier")
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.select(F.to_json(F.struct("*")).alias("j")).select(F.from_json("j", schema).alias("r")).select("r.*")


def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.count_by(load(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("k")), "k")


def repartition_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle.hash_partition(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 16, "o_custkey")


def repartition_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three partitions with the partition each lies in."""
    rows = load(spark, sf_dir, "events").select("event_id", "event_type")
    placed = shuffle.custom_partition(rows, 3, F.when(F.col("event_type").startswith("c"), 0).otherwise(2))
    return placed.withColumn("bin", F.spark_partition_id().cast("bigint"))


def fnv_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.count_by(load(spark, sf_dir, "kv_records").select("key", fnv1_bin(F.col("key"), 24).cast("bigint").alias("bin")), "key", "bin")


def udtf_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word count with a Python mapper and a declarative reducer."""
    import re

    split = re.compile("[a-zA-Z0-9]+").findall
    return _count_pairs(map_pairs(_text_pairs(spark, sf_dir), lambda _, text: ((w.lower(), "1") for w in split(text)))).select(F.col("key").alias("word"), F.col("value").alias("n"))


def udaf_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event counts with a Python reducer over an iterator of values."""
    pairs = load(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.lit("1").alias("value"))
    counted = reduce_pairs(pairs, lambda key, values: [(key, sum(1 for _ in values))])
    return counted.select(F.col("key").alias("event_type"), F.col("value").cast("bigint").alias("n"))


def sink_text_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue sums written as text lines and read again."""
    place = scratch(spark, "text")
    sums = aggregates.sum_by(load(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_extendedprice"))
    write_key_value(sums, place, F.col("l_suppkey"), [fixed6(F.col("total"))])
    back = key_value(spark.read.option("lineSep", "\n").text(place))
    return back.select(F.col("key").cast("bigint").alias("l_suppkey"), F.col("value").cast("double").alias("total"))


def events_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed counts of the streaming operator over the table as a batch."""
    rows = windowed_counts(load(spark, sf_dir, "events"), "ts", "event_type")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), F.col("key").alias("event_type"), "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        word_count, tokenize_raw, scan_text_lines, kv_decode, kv_lines, parse_delimited, scan_filter, filter_date_before, filter_prefix, filter_in_list, agg_count, agg_sum_by_prefix,
        visits_revenue, agg_multi, group_collect, join_inner, join_agg, visits_join, multi_stage, multi_source_union, identity, json_roundtrip, json_field, repartition_hash,
        repartition_custom, fnv_bins, udtf_map, udaf_reduce, sink_text_kv, events_per_hour, program_scan, program_aggregate, program_join, min_of_two,
    )
    return {f.__name__: f for f in own}


_ORDER_LINES = """
WITH orders_text AS (SELECT o_orderkey AS k, concat_ws(',', o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) END,
    CASE WHEN o_orderkey % 11 = 0 THEN '1995-13-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END, CASE WHEN o_orderkey % 13 = 0 THEN 'extra' END) AS value FROM orders),
parts AS (SELECT string_split(value, ',') AS p FROM orders_text WHERE len(string_split(value, ',')) = 4)
"""
_TEXT_VISITS = """
WITH v AS (SELECT coalesce(sourceip, '') AS ip, coalesce(desturl, '') AS url, visitdate AS day, CAST(adrevenue AS DECIMAL(38, 10)) AS revenue FROM visits
    WHERE NOT contains(concat(sourceip, desturl, useragent, countrycode, languagecode, searchword), ','))
"""
_COUNT_WORDS = "SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(regexp_replace(text, '[^a-zA-Z0-9\\s]+', ' ', 'g')), '\\s+')) AS word FROM documents) WHERE word <> ''"
_AVG = "CAST(sum(CAST({0} AS DECIMAL(28, {1}))) AS DOUBLE) / nullif(count({0}), 0)"
_SUM = "coalesce(CAST(sum(CAST({0} AS DECIMAL(28, {1}))) AS DOUBLE), 0)"


def oracle_sql() -> dict[str, str]:
    white = r"[\t-\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
    return {
        "word_count": _COUNT_WORDS + " GROUP BY word",
        "tokenize_raw": f"SELECT token, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '{white}')) AS token FROM documents) WHERE token <> '' GROUP BY token",
        "scan_text_lines": "SELECT CASE WHEN l LIKE '%' || chr(13) THEN substr(l, 1, length(l) - 1) ELSE l END AS value, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents WHERE text IS NOT NULL) GROUP BY 1",
        "kv_decode": "WITH l AS (SELECT concat_ws(chr(9), event_type, CASE WHEN event_id % 3 >= 1 THEN user_id END, CASE WHEN event_id % 3 >= 2 THEN props END) AS v FROM events), p AS (SELECT *, string_split(v, chr(9)) AS f FROM l) SELECT CASE WHEN len(f) = 2 THEN f[1] ELSE '' END AS key, CASE WHEN len(f) = 2 THEN f[2] ELSE v END AS value FROM p",
        "kv_lines": "WITH l AS (SELECT concat_ws(chr(9), key, value) AS v FROM kv_records), p AS (SELECT v, string_split(v, chr(9)) AS f FROM l) SELECT CASE WHEN len(f) = 2 THEN f[1] ELSE '' END AS key, CASE WHEN len(f) = 2 THEN f[2] ELSE v END AS value, count(*) AS n FROM p GROUP BY 1, 2",
        "parse_delimited": _ORDER_LINES + "SELECT CAST(p[1] AS BIGINT) AS o, CAST(p[2] AS BIGINT) AS c, try_cast(p[3] AS DOUBLE) AS price, try_cast(p[4] AS DATE) AS day FROM parts",
        "scan_filter": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45",
        "filter_date_before": _ORDER_LINES + "SELECT p[1] AS \"order\", p[4] AS day FROM parts WHERE coalesce(try_cast(p[4] AS DATE) < DATE '2000-01-01', true)",
        "filter_prefix": "SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'S')",
        "filter_in_list": "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'error') GROUP BY event_type",
        "agg_count": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
        "agg_sum_by_prefix": f"SELECT substr(o_orderpriority, 1, 8) AS pre, {_SUM.format('o_totalprice', 2)} AS total FROM orders GROUP BY 1",
        "visits_revenue": f"SELECT substr(sourceip, 1, 8) AS pre, {_SUM.format('adrevenue', 10)} AS total FROM visits GROUP BY 1",
        "agg_multi": f"SELECT l_returnflag, {_AVG.format('l_quantity', 2)} AS avg_qty, {_AVG.format('l_extendedprice', 2)} AS avg_price, count(*) AS n FROM lineitem GROUP BY l_returnflag",
        "group_collect": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
        "join_inner": "SELECT o_orderkey, o_custkey, c_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
        "join_agg": f"SELECT c_custkey, {_AVG.format('c_acctbal', 2)} AS avg_bal, {_AVG.format('o_totalprice', 2)} AS avg_price FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY c_custkey",
        "visits_join": f"SELECT sourceip, {_AVG.format('pagerank', 2)} AS avg_rank, {_AVG.format('adrevenue', 10)} AS avg_revenue, count(*) AS n FROM visits JOIN rankings ON desturl = pageurl WHERE visitdate < DATE '2000-01-01' GROUP BY sourceip",
        "multi_stage": _COUNT_WORDS + " AND starts_with(word, 't') GROUP BY word",
        "multi_source_union": "SELECT source, nation, count(*) AS n, count(segment) AS segments FROM (SELECT 'customer' AS source, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_nationkey, NULL FROM supplier) GROUP BY 1, 2",
        "identity": "SELECT * FROM region",
        "json_roundtrip": "SELECT * FROM supplier",
        "json_field": "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
        "repartition_hash": "SELECT o_orderkey, o_custkey FROM orders",
        "repartition_custom": "SELECT event_id, event_type, CAST(CASE WHEN starts_with(event_type, 'c') THEN 0 ELSE 2 END AS BIGINT) AS bin FROM events",
        "fnv_bins": """
            WITH k AS (SELECT key, count(*) AS n FROM kv_records GROUP BY key),
            b AS (SELECT key, n, hex(encode(key)) AS x FROM k),
            h AS (SELECT key, n, list_reduce(list_transform(range(0, length(x) // 2), lambda i: CAST(instr('0123456789ABCDEF', x[2 * i + 1]) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 17 AS HUGEINT)),
                lambda a, c: xor((a * 1099511628211) % 18446744073709551616, c), CAST(14695981039346656037 AS HUGEINT)) AS hash FROM b)
            SELECT key, CAST(hash % 24 AS BIGINT) AS bin, n FROM h""",
        "udtf_map": _COUNT_WORDS + " GROUP BY word",
        "udaf_reduce": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
        "sink_text_kv": f"SELECT l_suppkey, {_SUM.format('l_extendedprice', 2)} AS total FROM lineitem GROUP BY l_suppkey",
        "program_scan": "SELECT pageurl AS key, CAST(pagerank AS VARCHAR) AS value FROM rankings WHERE pagerank > 50 AND pageurl IS NOT NULL AND NOT contains(pageurl, ',')",
        "program_aggregate": _TEXT_VISITS + "SELECT substr(ip, 1, 8) AS key, round(round(CAST(coalesce(sum(revenue), 0) AS DOUBLE), 6), 3) AS total FROM v GROUP BY 1",
        "program_join": _TEXT_VISITS
        + ", r AS (SELECT coalesce(pageurl, '') AS url, coalesce(pagerank, 0) AS rank FROM rankings WHERE NOT contains(coalesce(pageurl, ''), ',')) SELECT ip AS key, round(round(CAST(sum(rank) AS DOUBLE) / count(*), 6), 3) AS avg_rank, round(round(CAST(sum(coalesce(revenue, 0)) AS DOUBLE) / count(*), 6), 3) AS avg_revenue FROM v JOIN r ON v.url = r.url WHERE coalesce(day < DATE '2000-01-01', true) GROUP BY ip",
        "min_of_two": "SELECT p_partkey, least(p_size, 25) AS smaller FROM part",
        "events_per_hour": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    }
