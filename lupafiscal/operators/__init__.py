"""All checks; importing a module registers its checks."""

from lupafiscal.operators import (  # noqa: F401
    ceilings,
    exchange,
    impact,
    invoices,
    openings,
    quality,
    report,
    suppliers,
    timing,
    volumes,
)
from lupafiscal.operators.registry import CHECKS, run

__all__ = ["CHECKS", "run"]
