"""CPF and CNPJ check-digit rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the public check-digit rules (modulo 11).
CPF_WEIGHTS = ((10, 9, 8, 7, 6, 5, 4, 3, 2), (11, 10, 9, 8, 7, 6, 5, 4, 3, 2))
CNPJ_WEIGHTS = (
    (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2),
    (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2),
)


def _digit(document: Column, position: int) -> Column:
    return F.ascii(F.substring(document, position, 1)) - F.lit(ord("0"))


def _check_digit(document: Column, weights: tuple[int, ...]) -> Column:
    weighted = F.lit(0)
    for position, weight in enumerate(weights, start=1):
        weighted = weighted + _digit(document, position) * F.lit(weight)
    rest = weighted % 11
    return F.when(rest < 2, F.lit(0)).otherwise(F.lit(11) - rest)


def _digits_agree(document: Column, weights: tuple[tuple[int, ...], ...]) -> Column:
    agree = F.lit(True)
    for row in weights:
        agree = agree & (_digit(document, len(row) + 1) == _check_digit(document, row))
    return agree & ~document.rlike("^(\\d)\\1*$")


def document_status(document: Column) -> Column:
    """VALIDO, or the first rule the document breaks."""
    size = F.length(document)
    return (
        F.when(document.isNull() | ~document.rlike("^[0-9]+$"), F.lit("NAO_NUMERICO"))
        .when(~size.isin(11, 14), F.lit("TAMANHO_INVALIDO"))
        .when((size == 11) & ~_digits_agree(document, CPF_WEIGHTS),
              F.lit("DIGITO_VERIFICADOR_INVALIDO"))
        .when((size == 14) & ~_digits_agree(document, CNPJ_WEIGHTS),
              F.lit("DIGITO_VERIFICADOR_INVALIDO"))
        .otherwise(F.lit("VALIDO"))
    )


def repairs(document: Column) -> Column:
    """Sorted valid documents that an invalid one can stand for: its digits as they are, with a
    leading zero, or less one digit.  Null for valid and null documents.

    A document written with one digit too many or without its leading zero is thus found
    again, as its check digits rule out nearly all others.
    """
    def candidates(digits: Column) -> Column:
        size = F.length(digits)
        fewer = F.transform(
            F.sequence(F.lit(1), F.greatest(size, F.lit(1))),
            lambda i: F.concat(F.substring(digits, F.lit(1), i - 1), F.substring(digits, i + 1, size)),
        )
        possible = F.concat(F.array(digits, F.concat(F.lit("0"), digits)), fewer)
        # Others cannot be valid, and need no check digits.
        long_enough = F.filter(F.array_distinct(possible), lambda c: F.length(c).isin(11, 14))
        return F.array_sort(F.filter(long_enough, lambda c: document_status(c) == "VALIDO"))

    digits = F.regexp_replace(document, "[^0-9]", "")
    # Bound to a name by a list of one, so that the digits are picked once.
    found = F.element_at(F.transform(F.array(digits), candidates), 1)
    return F.when(document.isNotNull() & (document_status(document) != "VALIDO"), found)


def canonical(document: Column, found: Column | None = None) -> Column:
    """The valid document meant: itself, or its only repair; null where there is none or are several."""
    found = repairs(document) if found is None else found
    return F.when(document_status(document) == "VALIDO", document).when(F.size(found) == 1, F.get(found, F.lit(0)))
