"""The engine's scalar functions as Spark columns; each takes the name of a column or any SQL expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilflow.functions.dialect import SPARK


def _column(method: str):
    def call(*args) -> Column:
        return F.expr(getattr(SPARK, method)(*args))

    call.__name__ = method
    call.__doc__ = f"``{method}`` of the arguments as a column."
    return call


luhn, entropy, looks_random, looks_live = (_column(m) for m in ("luhn", "entropy", "looks_random", "live"))
is_placeholder, is_setting, is_identifier = (_column(m) for m in ("placeholder", "setting", "identifier"))
is_valid_ipv4, is_private_ipv4, version_context = (_column(m) for m in ("valid_ipv4", "private_ipv4", "version_context"))
edit_distance, same_secret = (_column(m) for m in ("edit_distance", "same_secret"))
keep_ends, mask_prefixed, mask_email, mask_digits, mask_card, mask_url, mask_value = (
    _column(m) for m in ("keep_ends", "mask_prefixed", "mask_email", "mask_digits", "mask_card", "mask_url", "mask_value")
)
