"""The engine's functions under names that SQL can call: scalar ones as expressions inside Catalyst, ``scan_text`` as a table function."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from veilflow.detect.rules import RULES, DetectorRegistry
from veilflow.detect.scan import MATCH, scan_line
from veilflow.functions.dialect import SPARK

_NUMBER = re.compile(r"('[^']*')|(?<![\w.])([0-9]+[.][0-9]+)(?![\w.])")


def _bodies() -> dict[str, tuple[str, str, str]]:
    """Parameters, type and expression of each scalar function."""
    one = {
        "luhn": "BOOLEAN", "shannon_entropy": "DOUBLE", "looks_random": "BOOLEAN", "is_placeholder": "BOOLEAN", "is_valid_ipv4": "BOOLEAN", "is_private_ipv4": "BOOLEAN",
        "mask_email": "STRING", "mask_digits": "STRING", "mask_card": "STRING", "mask_url": "STRING", "mask_prefixed": "STRING",
    }
    of = {"shannon_entropy": SPARK.entropy, "is_placeholder": SPARK.placeholder, "is_valid_ipv4": SPARK.valid_ipv4, "is_private_ipv4": SPARK.private_ipv4}
    out = {name: ("value STRING", kind, of.get(name, getattr(SPARK, name, None))("value")) for name, kind in one.items()}
    masks = " ".join(f"WHEN '{r.id}' THEN {SPARK.mask_value(r.id, 'value')}" for r in RULES)
    out["mask_value"] = ("rule STRING, value STRING", "STRING", f"CASE rule {masks} ELSE {SPARK.keep_ends('value', 3, 3)} END")
    out["same_secret"] = ("a STRING, b STRING", "BOOLEAN", SPARK.same_secret("a", "b"))
    return out


def register(spark: SparkSession, registry: DetectorRegistry | None = None) -> list[str]:
    """Make the functions known to a session and return their names; ``registry`` gives the rules that scan_text follows."""
    rules = registry or DetectorRegistry()

    @udtf(returnType=MATCH)
    class ScanText:
        """Findings of one line: ``LATERAL scan_text(line, array('developer'))``; a null in place of categories means all rules."""

        def __init__(self):
            self.known: dict = {}

        def eval(self, line: str, categories: list) -> Iterator[tuple]:
            key = None if categories is None else tuple(categories)
            if key not in self.known:
                self.known[key] = [(r, r.compiled()) for r in rules.select(None if key is None else list(key))]
            for rule, value, start, end in scan_line(line or "", self.known[key]):
                yield rule.id, rule.label, rule.category, rule.severity, value, rules.mask(rule.id, value), start, end

    spark.udtf.register("scan_text", ScanText)
    bodies = _bodies()
    for name, (params, kind, body) in bodies.items():
        exact = _NUMBER.sub(lambda m: m[1] or m[2] + "D", body)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN cast({exact} AS {kind})")
    return [*bodies, "scan_text"]
