"""Money columns: output types and the Brazilian text format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A sum keeps every digit a decimal can have, so totals cannot overflow before
# 10^36; a difference of two numeric(15,2) values needs 16 digits.
TOTAL = "decimal(38,2)"
DIFFERENCE = "decimal(18,2)"


def total(amount: Column | str) -> Column:
    return F.sum(amount).cast(TOTAL)


def difference(left: Column | str, right: Column | str) -> Column:
    left, right = (F.col(c) if isinstance(c, str) else c for c in (left, right))
    return (left - right).cast(DIFFERENCE)


def to_ptbr(amount: Column | str) -> Column:
    """``1024.70`` -> ``1024,7``: decimal comma, last zero of the cents dropped."""
    text = F.regexp_replace(F.col(amount).cast("string") if isinstance(amount, str)
                            else amount.cast("string"), "(\\.\\d)0$", "$1")
    return F.replace(text, F.lit("."), F.lit(","))


def _plain(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    without_thousands = F.replace(F.trim(text), F.lit("."), F.lit(""))
    return F.replace(without_thousands, F.lit(","), F.lit("."))


def from_ptbr(text: Column | str, dtype: str = "decimal(15,2)") -> Column:
    """``1.434.135,3`` -> ``1434135.30``; text that is no number raises."""
    return _plain(text).cast(dtype)


def try_ptbr(text: Column | str, dtype: str = "decimal(15,2)") -> Column:
    """The same, but null for text that is no number or does not fit."""
    return _plain(text).try_cast(dtype)


def is_bad_money(text: Column | str, dtype: str = "decimal(15,2)") -> Column:
    """True where a text is given but is no number that fits ``dtype``."""
    text = F.col(text) if isinstance(text, str) else text
    return text.isNotNull() & _plain(text).try_cast(dtype).isNull()
