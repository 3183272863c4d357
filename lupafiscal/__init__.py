"""Public-spending audit as Spark DataFrame jobs."""

from lupafiscal.audit import Audit
from lupafiscal.operators import CHECKS, run

__all__ = ["Audit", "CHECKS", "run"]
