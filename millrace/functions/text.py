"""Column expressions over text: tokens, strict parsing, bounded prefixes, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.operators.malformed import strict_cast

#: Unicode white space, the inside of a character class. Fixed values.
WHITE = r"\t-\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def sanitized(text: Column) -> Column:
    """Runs of anything but ASCII letters, digits and white space become one blank; lower case."""
    return F.lower(F.regexp_replace(text, r"[^a-zA-Z0-9\s]+", " "))


def tokens(text: Column, member: str = f"[^{WHITE}]") -> Column:
    """The maximal runs of member characters (by default of anything but white space), as an
    array; null text gives null. Matching tokens is several times faster than splitting."""
    return F.regexp_extract_all(text, F.lit(member + "+"), F.lit(0))


def words(text: Column) -> Column:
    """Tokens of the sanitized text in one regex pass (lower-casing comes after the match)."""
    return F.transform(tokens(text, "[a-zA-Z0-9]"), F.lower)


def fields(text: Column, separator: str = ",") -> Column:
    """Pieces between literal separators, trailing empty ones kept; no quoting. A separator of one
    character is split without a regex."""
    literal = ("" if separator.isalnum() else "\\") + separator if len(separator) == 1 else r"\Q" + separator + r"\E"
    return F.split(text, literal, -1)


def n_fields(text: Column, separator: str = ",") -> Column:
    """How many ``fields`` there are, without splitting."""
    seen = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(separator)))
    return (seen / len(separator.encode())).cast("int") + 1


def prefix(text: Column, n: int) -> Column:
    """The first ``n`` characters; shorter text as it is."""
    return F.substring(text, 1, n)


def strict_int(text: Column) -> Column:
    return strict_cast(text, "bigint")


def strict_float(text: Column) -> Column:
    return strict_cast(text, "double")


def strict_date(text: Column) -> Column:
    return strict_cast(text, "date")


def fixed6(number: Column) -> Column:
    """Six decimals without grouping, for text output."""
    return F.format_string("%.6f", number)
