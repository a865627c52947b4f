"""Options of writes that the session holds: ``strataform.compress``, ``strataform.hash`` and ``strataform.block``.

An argument of a write comes before the session's option, and that before the default.
"""

from __future__ import annotations

from contextlib import contextmanager
from typing import Any

from pyspark.sql import SparkSession

from .errors import ArgumentError

DEFAULTS: dict[str, Any] = {"compress": 1, "hash": True, "block": 65_536}


def get(spark: SparkSession, name: str, given: Any = None) -> Any:
    """The given value, or the session's, or the default."""
    if given is not None:
        return given
    held = spark.conf.get(f"strataform.{name}", None)
    if held is None:
        return DEFAULTS[name]
    if name == "hash":
        if held not in ("true", "false"):
            raise ArgumentError("strataform.hash is true or false")
        return held == "true"
    if not held.isdigit():
        raise ArgumentError(f"strataform.{name} is a whole number")
    return int(held)


@contextmanager
def using(spark: SparkSession, **options: Any):
    """Options for the writes inside."""
    unknown = options.keys() - DEFAULTS.keys()
    if unknown:
        raise ArgumentError(f"no options of these names: {', '.join(sorted(unknown))}")
    before = {k: spark.conf.get(f"strataform.{k}", None) for k in options}
    for k, v in options.items():
        spark.conf.set(f"strataform.{k}", str(v).lower())
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(f"strataform.{k}")
            else:
                spark.conf.set(f"strataform.{k}", v)
