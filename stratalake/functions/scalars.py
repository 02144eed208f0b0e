"""Column functions; all of them are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def normalize_merchant(raw: Column) -> Column:
    """Upper case without apostrophes, store numbers and punctuation; null when nothing is left."""
    c = F.regexp_replace(F.upper(raw), "['’]", "")
    c = F.regexp_replace(c, r"#\s*\d+|-\s*\d+|\b\d{3,}\b", " ")
    c = F.regexp_replace(c, r"[^A-Z0-9 ]", " ")
    c = F.trim(F.regexp_replace(c, r" +", " "))
    return F.nullif(c, F.lit(""))


def signed_amount(amount: Column, direction: Column) -> Column:
    """Debits are negative; every other direction, null included, is not."""
    return F.when(direction == "DEBIT", -amount).otherwise(amount)


def iso_date(text: Column) -> Column:
    """A date for exactly YYYY-MM-DD that exists, else null; never an error."""
    return F.when(text.rlike(ISO_DATE), F.try_to_date(text, "yyyy-MM-dd"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def short_key(*parts: Column, length: int = 16) -> Column:
    """The first hexadecimal digits of the SHA-256 of the parts joined by '|'; nulls are empty parts."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.substring(F.sha2(text, 256), 1, length)


def payload_json(columns: list[str]) -> Column:
    """JSON of the columns in the order of their names, nulls included, so the input's column order doesn't matter."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(columns))), {"ignoreNullFields": "false"})


def payload_hash(columns: list[str]) -> Column:
    return F.sha2(payload_json(columns), 256)


def is_close(a: Column, b: Column, rel: float = 1e-9, abs_: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_))


def null_rate(c: Column) -> Column:
    """Aggregate: the share of nulls as a double, null without rows."""
    return F.avg(c.isNull().cast("double"))


def duplicates(c: Column) -> Column:
    """Aggregate: rows less distinct values; null keys count as duplicates."""
    return F.count(F.lit(1)) - F.count_distinct(c)
