"""Rows that fail to parse, apart from the valid ones, each with its reason.

The text is read permissively under an explicit schema with the corrupt text kept
(``from_csv``), if it has as many commas as its layout asks for, so no text can exceed
what the reader bears. A row is taken as read only if the reader found nothing corrupt and
the text has the plain shape of its type (no quotes, right number of fields, ASCII
numbers, ``yyyy-MM-dd``), for the reader itself is more lenient than the rules. All
others are classified again, exactly, by quoting, count and cast checks. Everything is
Column expressions; there is no recursion over the text, so its length doesn't matter.

Reasons, the first that applies: ``quoting``, ``type``, ``arity``, ``value``, ``key``.
Defined results: a null value fails as ``quoting``, a null type as ``type``, a null key
as ``key``; an empty value is one field; one trailing CR of the value is dropped first;
columns the rules don't name are carried through unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INT = r"[+-]?[0-9]+"
_FLOAT = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_PLAIN = r'[^",\r\n\x00]*'
_SHAPES = {"string": _PLAIN, "bigint": r"[+-]?[0-9]{1,18}", "double": _FLOAT, "date": _DATE}
_CORRUPT = "_corrupt"


@dataclass(frozen=True)
class Layout:
    """A record type: its tag, (name, type) of its fields, and the field the key repeats."""

    tag: str
    fields: tuple[tuple[str, str], ...]
    key: str

    @property
    def schema(self) -> str:
        return ", ".join(f"{n} {t}" for n, t in self.fields) + f", {_CORRUPT} string"

    @property
    def shape(self) -> str:
        return "^" + ",".join(_SHAPES[t] for _, t in self.fields) + r"\z"

    @property
    def key_at(self) -> int:
        return [n for n, _ in self.fields].index(self.key)


RANKING = Layout("0", (("pageurl", "string"), ("pagerank", "bigint"), ("avgduration", "bigint")), "pageurl")
VISIT = Layout(
    "1",
    (("sourceip", "string"), ("desturl", "string"), ("visitdate", "date"), ("adrevenue", "double"), ("useragent", "string"), ("countrycode", "string"), ("languagecode", "string"), ("searchword", "string"), ("duration", "bigint")),
    "desturl",
)
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "quote": '"', "escape": '"', "nullValue": "\x00", "dateFormat": "yyyy-MM-dd"}


def chomp(value: Column) -> Column:
    """Without one trailing CR."""
    return F.when(value.endswith("\r"), F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value)


def _inner(segments: Column) -> Column:
    return F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 2, F.lit(0)))


def _well_quoted(segments: Column, text: Column) -> Column:
    """``segments`` is the text cut at quotes: every second one lies inside quotes. Between
    two quoted parts there is nothing (a doubled quote) or text that begins and ends with
    a comma; the first part ends and the last begins with one."""
    first, last = F.element_at(segments, 1), F.element_at(segments, -1)
    # of the inner segments, those with an even index lie inside quotes
    inner = F.transform(_inner(segments), lambda x, i: (i % 2 == 0) | (x == "") | (x.startswith(",") & x.endswith(",")))
    ends = ((first == "") | first.endswith(",")) & ((last == "") | last.startswith(","))
    return ~text.contains('"') | ((F.size(segments) % 2 == 1) & ends & F.forall(inner, lambda b: b))


def _split_quoted(segments: Column) -> Column:
    """Fields of a well-quoted record. Commas inside quotes are escaped while splitting;
    the escape character itself was escaped before."""

    def part(x: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.replace(x, F.lit(","), F.lit("\x01b"))).when(x == "", F.lit('"')).otherwise(x)

    joined = F.concat(F.element_at(segments, 1), F.array_join(F.transform(_inner(segments), part), ""), F.element_at(segments, -1))
    return F.transform(F.split(joined, ",", -1), lambda f: F.replace(F.replace(f, F.lit("\x01b"), F.lit(",")), F.lit("\x01a"), F.lit("\x01")))


def split_record(text: Column) -> Column:
    quoted = _split_quoted(F.split(F.replace(text, F.lit("\x01"), F.lit("\x01a")), '"', -1))
    return F.when(text.contains('"'), quoted).otherwise(F.split(text, ",", -1))


def strict_cast(field: Column, kind: str) -> Column:
    """The typed field, null where the rules refuse it."""
    if kind == "bigint":
        return F.when(field.rlike(f"^{_INT}\\z"), field.try_cast("bigint"))
    if kind == "double":
        number = F.when(field.rlike(f"^{_FLOAT}\\z"), field.try_cast("double"))
        return F.when(F.abs(number) < float("inf"), number)
    if kind == "date":
        return F.when(field.rlike(f"^{_DATE}\\z"), field.try_cast("date"))
    return field


def classified(df: DataFrame, layouts: tuple[Layout, ...] = (RANKING, VISIT), tag: str = "recordtype", key: str = "key", value: str = "value") -> DataFrame:
    """The rows with ``__mr_reason`` (null: valid) and, per layout, a struct ``__mr_t<tag>`` with the
    typed fields of its valid rows."""
    text, kind = F.col("__mr_text"), F.col(tag)
    rows = df.withColumn("__mr_text", chomp(F.col(value)))
    commas = F.length(text) - F.length(F.replace(text, F.lit(",")))
    read = rows.withColumns({f"__mr_p{x.tag}": F.when((kind == x.tag) & (commas == len(x.fields) - 1), F.from_csv(text, x.schema, _OPTIONS | {"maxColumns": str(len(x.fields) + 1)})) for x in layouts})
    # the fields only of rows that aren't taken as read
    taken = F.lit(False)
    for x in layouts:
        as_read = (kind == x.tag) & text.rlike(x.shape) & F.col(f"__mr_p{x.tag}.{_CORRUPT}").isNull()
        for n, t in x.fields:
            if t == "double":  # the reader takes 1e400 for infinity
                as_read = as_read & (F.abs(F.col(f"__mr_p{x.tag}.{n}")) < float("inf"))
        taken = taken | as_read
    read = read.withColumn("__mr_taken", F.coalesce(taken, F.lit(False)))
    fields = F.col("__mr_fields")
    read = read.withColumn("__mr_fields", F.when(~F.col("__mr_taken"), split_record(text)))
    cut = F.split(text, '"', -1)
    reason = F.when(~F.coalesce(_well_quoted(cut, text), F.lit(False)), "quoting").when(~F.coalesce(kind.isin([x.tag for x in layouts]), F.lit(False)), "type")
    typed = {}
    for x in layouts:
        own = kind == x.tag
        casts = {n: strict_cast(fields[i], t) for i, (n, t) in enumerate(x.fields)}
        reason = reason.when(own & (F.size(fields) != len(x.fields)), "arity")
        bad = F.lit(False)
        for n, t in x.fields:
            if t != "string":
                bad = bad | casts[n].isNull()
        reason = reason.when(own & bad, "value").when(own & ~F.coalesce(F.col(key) == fields[x.key_at], F.lit(False)), "key")
        # the reader gives null for an empty text
        by_reader = F.struct(*[(F.coalesce(c, F.lit("")) if t == "string" else c).alias(n) for n, t in x.fields for c in [F.col(f"__mr_p{x.tag}.{n}")]])
        exact = F.struct(*[c.alias(n) for n, c in casts.items()])
        typed[f"__mr_t{x.tag}"] = F.when(own & F.col("__mr_reason").isNull(), F.when(F.col("__mr_taken"), by_reader).otherwise(exact))
    quick = F.lit(False)
    for x in layouts:
        quick = quick | ((kind == x.tag) & F.coalesce(F.col(key) == F.coalesce(F.col(f"__mr_p{x.tag}.{x.key}"), F.lit("")), F.lit(False)))
    reason = F.when(F.col("__mr_taken"), F.when(quick, F.lit(None)).otherwise("key")).otherwise(reason)
    return read.withColumn("__mr_reason", reason).withColumns(typed).drop("__mr_text", "__mr_fields", "__mr_taken", *[f"__mr_p{x.tag}" for x in layouts])


def _settled(rows: DataFrame) -> DataFrame:
    """Keeps filters above the classification: pushed below, they would repeat its
    expressions, the reader's among them, dozens of times."""
    return rows.withColumn("__mr_part", F.spark_partition_id()).where("__mr_part >= 0")


def rejected(df: DataFrame, **names: str) -> DataFrame:
    """The failing rows as they were, with ``reason``."""
    return _settled(classified(df, **names)).where("__mr_reason IS NOT NULL").select(*[F.col(c) for c in df.columns if c != "reason"], F.col("__mr_reason").alias("reason"))


def valid_rows(df: DataFrame, layout: Layout, id_col: str, **names: str) -> DataFrame:
    """The valid rows of one layout: the id and the typed fields."""
    rows = _settled(classified(df, **names)).where(F.col(f"__mr_t{layout.tag}").isNotNull())
    return rows.select(id_col, F.col(f"__mr_t{layout.tag}.*"))
