"""Name -> check.  A check takes the audit handle and returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lupafiscal.audit import Audit

Check = Callable[[Audit], DataFrame]

CHECKS: dict[str, Check] = {}


def check(*names: str) -> Callable[[Check], Check]:
    """Register a check, under several names where their results are the same."""

    def register(fn: Check) -> Check:
        for name in names:
            if name in CHECKS:
                raise ValueError(f"check {name} is registered twice")
            CHECKS[name] = fn
        return fn

    return register


def run(name: str, a: Audit) -> DataFrame:
    return CHECKS[name](a)
