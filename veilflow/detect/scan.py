"""Findings in lines of text: variants, rules, deduplication, overlap resolution; one Arrow batch of lines at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilflow.detect.rules import SEVERITIES, DetectorDef, DetectorRegistry, Needs

#: A whole run of spaces behind or before one of : / . @ = _ - with something on either side; of a run that begins the line the first stays.
_BESIDE_JOINER = re.compile(r"(?<=[:/.@=_-]) +(?=[^ ])|(?<=[^ ]) +(?=[:/.@=_-])|(?<=\A ) +(?=[:/.@=_-])")
MATCH = "detector_id string, label string, category string, severity string, value string, masked string, start int, end int"


def fold_confusables(text: str) -> str:
    """O and l inside token-like runs read as digits; the length stays."""

    def fold(m: re.Match) -> str:
        run = m[0]
        if not re.search(r"[_\-0-9]", run):
            return run
        return re.sub(r"l(?=[A-Za-z0-9]{3})", "1", re.sub(r"[Oo](?=[A-Za-z0-9]{3})", "0", run))

    return re.sub(r"[A-Za-z0-9_\-.]{8,}", fold, text) if re.search(r"[_\-0-9]", text) else text


def despace(text: str) -> tuple[str, list[int]] | None:
    """The text without runs of spaces next to a joiner, with the place of each kept character; None if nothing goes."""
    kept, at, i = [], [], 0
    for m in _BESIDE_JOINER.finditer(text):
        kept.append(text[i : m.start()])
        at.extend(range(i, m.start()))
        i = m.end()
    if not kept:
        return None
    at.extend(range(i, len(text)))
    return "".join([*kept, text[i:]]), at


def variants(text: str) -> list[tuple[str, str, list[int] | None]]:
    out = [("original", text, None)]
    if (folded := fold_confusables(text)) != text:
        out.append(("folded", folded, None))
    if joined := despace(text):
        out.append(("despaced", *joined))
    return out


def resolve_overlaps(matches: list[tuple]) -> list[tuple]:
    """Keep matches disjoint from all better ones: by severity, then length, then start, then order found.  (rule, value, start, end)"""
    kept: list[tuple] = []
    for m in sorted(matches, key=lambda m: (SEVERITIES.index(m[0].severity), m[2] - m[3], m[2])):
        if all(m[3] <= k[2] or k[3] <= m[2] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m[2])


def scan_line(text: str, rules: list[tuple[DetectorDef, re.Pattern]]) -> list[tuple[DetectorDef, str, int, int]]:
    """All findings of a line: (rule, value, start, end)."""
    if not text.strip():
        return []
    views = [(view, offsets, Needs(view)) for _, view, offsets in variants(text)]
    found: list[tuple[DetectorDef, str, int, int]] = []
    for rule, pattern in rules:
        for view, offsets, may in views:
            if not may(rule):
                continue
            for m in pattern.finditer(view):
                value = m[rule.group]
                if not value or (rule.validate and not rule.validate(value, view)):
                    continue
                start, end = m.span(rule.group)
                if offsets is not None:
                    start, end = offsets[start], offsets[end - 1] + 1
                end = min(end, len(text))
                if not any(f[0] is rule and f[2] == start and len(f[1]) >= len(value) for f in found):
                    found.append((rule, value, start, end))
    return resolve_overlaps(found)


def scan_lines(lines: DataFrame, registry: DetectorRegistry | None = None, categories: list[str] | None = None, line_col: str = "line") -> DataFrame:
    """One row per finding: all columns of ``lines`` but the text, then MATCH.  Failures are raised, never turned into nulls."""
    registry = registry or DetectorRegistry()
    rules = registry.select(categories)
    keep = [f for f in lines.schema.fields if f.name != line_col]
    schema = T.StructType([*keep, *T.StructType.fromDDL(MATCH).fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(r, r.compiled()) for r in rules]
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column(batch.schema.get_field_index(line_col)).to_pylist()):
                for rule, value, start, end in scan_line(text or "", compiled):
                    rows.append(i)
                    out.append((rule.id, rule.label, rule.category, rule.severity, value, registry.mask(rule.id, value), start, end))
            kept = [batch.column(batch.schema.get_field_index(f.name)).take(pa.array(rows, pa.int64())) for f in keep]
            made = [pa.array([o[k] for o in out], pa.string() if k < 6 else pa.int32()) for k in range(8)]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=schema.names)

    return lines.mapInArrow(work, schema)


_WRAP, _TOKEN = re.compile(r"^[\"'`(\[{<]+|[\"'`)\]}>,;:]+$"), re.compile(r"[A-Za-z0-9_.=+/-]{4,}")


def tokenish(word: str) -> bool:
    """Whether a word, without quotes and brackets around it, looks like a piece of a token."""
    core = _WRAP.sub("", word)
    if not _TOKEN.fullmatch(core):
        return False
    return any("0" <= c <= "9" for c in core) or (re.search("[a-z]", core) is not None and re.search("[A-Z]", core) is not None)


def extended_end(line: str, start: int, end: int, least: int = 12) -> int:
    """The end of what must be covered: a span of ``least`` characters or more goes on over token-like words that follow one space apart."""
    if end - start < least:
        return end
    for m in re.finditer(r"[^ ]+", line):
        if m.start() < end:
            continue
        if m.start() > end + 1 or not tokenish(m[0]):
            break
        end = m.end()
    return end


def covering(line: str, start: int, end: int) -> tuple[int, int]:
    """The characters of all words that a finding touches, with the fragments that go on behind it."""
    end = extended_end(line, start, end)
    left = line.rfind(" ", 0, start) + 1
    right = line.find(" ", end) if end > start else end
    return left, len(line) if right < 0 else right


def cover_lines(lines: DataFrame, registry: DetectorRegistry | None = None, categories: list[str] | None = None, line_col: str = "line", cover: str = ";") -> DataFrame:
    """``lines`` with every word that a finding touches replaced by ``cover``, a character that no rule takes for part of a value."""
    rules = (registry or DetectorRegistry()).select(categories)

    def hide(text: str, compiled: list) -> str:
        for _, _, start, end in scan_line(text, compiled):
            a, b = covering(text, start, end)
            text = text[:a] + cover * (b - a) + text[b:]
        return text

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(r, r.compiled()) for r in rules]
        for batch in batches:
            at = batch.schema.get_field_index(line_col)
            columns = list(batch.columns)
            columns[at] = pa.array([None if t is None else hide(t, compiled) for t in columns[at].to_pylist()], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return lines.mapInArrow(work, lines.schema)
