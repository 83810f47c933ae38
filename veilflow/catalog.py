"""All queries of the engine by name, each with the SQL that an independent engine runs for the same rows.

A query is one template over the tables of a folder; Spark and the other engine get it in their own dialect.  Cases that no table
holds are inline rows, the same on both sides.  Queries that SQL cannot express (scans with overlap resolution and stateful folds) are
DataFrame code from the other modules and have no counterpart here.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilflow.detect import native
from veilflow.detect.rules import CATEGORIES, RULES, SEVERITIES
from veilflow.functions.dialect import DUCK, SPARK, Dialect
from veilflow.operators import geometry as G
from veilflow.operators.ranges import numbered
from veilflow.plans import scan_sql, scans, sightings
from veilflow.sources.adapters import TABLES, spread

TEMPLATES: dict[str, Callable[[Dialect], str]] = {}


def query(f: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
    TEMPLATES[f.__name__.rstrip("_")] = f
    return f


def values(d: Dialect, rows: list[tuple], names: str) -> str:
    """Inline rows."""
    cell = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else f"cast({x} AS DOUBLE)" if isinstance(x, float) else str(x) if isinstance(x, int) else d.lit(x)
    body = ", ".join("(" + ", ".join(cell(x) for x in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({names}))"


# ------------------------------------------------------------------ sources as tables

def lines(d: Dialect) -> str:
    """Lines of documents that are not blank, and the inline lines."""
    split = d.split("text", "\n") if not d.spark else "split(text, '\\n')"
    n = d.range("1", d.size("ls"))
    docs = d.explode(f"doc_id, i AS line_no, {d.at('ls', 'i')} AS line", f"(SELECT doc_id, {split} AS ls FROM {d.table('documents')} WHERE text IS NOT NULL) q", n, "i")
    return f"(SELECT doc_id, line_no, line FROM ({docs}) r WHERE trim(line) <> '' UNION ALL SELECT * FROM {values(d, list(FIXTURE_LINES), 'doc_id, line_no, line')})"


def hits(d: Dialect) -> str:
    """Events as sightings: a user is a video, a day is a second, boxes and confidences follow from the ids."""
    first = "min(ts) OVER (PARTITION BY user_id)"
    seconds = f"(unix_micros(cast(ts AS TIMESTAMP)) - unix_micros(cast({first} AS TIMESTAMP)))" if d.spark else f"(epoch_us(ts) - epoch_us({first}))"
    return (
        f"(SELECT event_id, user_id AS video, event_type AS k, round({seconds} / 86400000000.0, 6) AS t, cast(event_id % 7 * 40 AS DOUBLE) AS x, cast(event_id % 5 * 30 AS DOUBLE) AS y,"
        f" cast(60 + event_id % 3 * 10 AS DOUBLE) AS w, cast(20 + event_id % 2 * 8 AS DOUBLE) AS h, round(0.45 + (event_id % 50) / 100.0, 2) AS conf, event_id % 3 = 0 AS strong FROM {d.table('events')})"
    )


def _secret(*parts: str) -> str:
    return "".join(parts)


_A = "Zq7Rt2Wx9Kd4Lm1Pn8Vb"
#: One line or more for each rule; token-like text is put together here and is no credential of anything.
FIXTURE_LINES = tuple(
    (-1, i, line)
    for i, line in enumerate(
        (
            _secret("key sk", "_live_", _A), _secret("pk", "_test_", _A), _secret("x gh", "p_", _A), _secret("AK", "IA", "QWERTY1234567890 end"), _secret("aws_secret_access", "_key = ", _A, _A[:16]),
            _secret("AI", "za", _A, _A[:15]), _secret("use sk", "-proj-", _A, _A), _secret("use sk", "-ant-", _A, _A), _secret("xo", "xb-", "1234567890-abcdef"), _secret("https://hooks.", "slack.com/services/", _A, "/", _A),
            _secret("S", "G.", _A, ".", _A), _secret("np", "m_", _A, _A[:12]), _secret("A", "C", "0123456789abcdef" * 2, " sid"), _secret("ey", "J", _A, ".", _A, ".", _A), "-----BEGIN RSA PRIVATE KEY-----",
            _secret("ssh", "-rsa ", _A, _A), _secret("Authorization: Bear", "er ", _A), "password = correct9horse", "pwd: changeme", _secret("ENCRYPTION", "_KEY=", _A), "SIGNING_KEY=abc_123", "API_KEY=your_api_key_here",
            "apiKey: OPENAI_KEY", "KEYBOARD_LAYOUT=qwerty123", "DB_TOKEN=true", "jane.doe@mail.example.org", "nobody@example.com", "call (415) 555-0137 now", "version 415-555-0137", "+44 20 7946 0958", "ssn 078-05-1120",
            "4111 1111 1111 1111", "4111 1111 1111 1112", "GB82WEST12345698765432", _secret("postgres", "://user:pa55@db.host:5432/app"), _secret("https", "://bob:s3cret@site.test/x"), "8.8.4.4 and 10.0.0.7", "version 1.2.3.4", "300.1.2.3",
            "host build-7.internal up", "arn:aws:iam::123456789012:role/x", "plain words only",
        )
    )
)


# ------------------------------------------------------------------ one query for each text rule

def rule_rows(d: Dialect, rule) -> str:
    pattern, more = d.rule_pattern(rule)
    found = d.explode("doc_id, line_no, line, value", f"(SELECT * FROM {lines(d)} l WHERE {d.may('line', 'lower(line)', rule)}) p", d.every("line", pattern, rule.group, rule.ignore_case), "value")
    return f"SELECT doc_id, line_no, '{rule.id}' AS detector_id, '{rule.category}' AS category, '{rule.severity}' AS severity, value, {d.mask_value(rule.id, 'value')} AS masked FROM ({found}) f WHERE value <> '' AND {more} AND {d.validate(rule.id, 'value', 'line')}"


for _rule in RULES:
    TEMPLATES["det_" + _rule.id.replace("-", "_")] = lambda d, rule=_rule: rule_rows(d, rule)


def found(d: Dialect) -> str:
    """Findings of all rules, before overlap resolution; one pass over the lines in Spark."""
    if not d.spark:
        return "(" + " UNION ALL ".join(rule_rows(d, r) for r in RULES) + ")"
    every = []
    for r in RULES:
        pattern, _ = d.rule_pattern(r)
        every.append(f"CASE WHEN {d.may('line', 'low', r)} THEN transform({d.every('line', pattern, r.group, r.ignore_case)}, v -> named_struct('id', '{r.id}', 'value', v)) ELSE cast(array() AS array<struct<id:string,value:string>>) END")
    rows = f"SELECT doc_id, line_no, line, m.id AS detector_id, m.value AS value FROM (SELECT *, lower(line) AS low FROM {lines(d)} x) l LATERAL VIEW explode(concat({', '.join(every)})) u AS m"
    case = lambda each, other: "CASE detector_id " + " ".join(f"WHEN '{r.id}' THEN {each(r)}" for r in RULES) + f" ELSE {other} END"
    by = lambda field: "CASE " + " ".join(f"WHEN detector_id IN ({', '.join(chr(39) + r.id + chr(39) for r in RULES if getattr(r, field) == x)}) THEN '{x}'" for x in dict.fromkeys(getattr(r, field) for r in RULES)) + " END"
    right = case(lambda r: d.validate(r.id, "value", "line"), "FALSE")
    return f"(SELECT doc_id, line_no, detector_id, {by('category')} AS category, {by('severity')} AS severity, value, {case(lambda r: d.mask_value(r.id, 'value'), 'NULL')} AS masked FROM ({rows}) f WHERE value <> '' AND {right})"


RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
dims = lambda d, xs, name: values(d, [(x, i) for i, x in enumerate(xs)], f"{name}, ord")


def _q(name: str, template: Callable[[Dialect], str]) -> None:
    TEMPLATES[name] = template


# ------------------------------------------------------------------ scalar functions over words of documents and inline values

#: Every word of the documents, cut at white space, and the inline values.
WORDS = lambda d: f"(SELECT DISTINCT w FROM ({d.explode('w', d.table('documents'), d.split_space('text'), 'w')}) q WHERE w <> '' UNION SELECT * FROM {values(d, [(x,) for x in _VALUES], 'w')})"
_VALUES = ("4111 1111 1111 1111", "411111111111", "abcd", "aaaa", "your_api_key_here", "testing123456", "true", "12.5", "OPENAI_KEY", "0PENAI_KEY", "snake_case_words_only", "Mixed9Case7Token", "10.0.0.1", "172.20.1.1", "172.32.1.1", "08.8.8.8", "256.1.1.1", "1.2.3", "hunter2", "xxxx1", "no", "undefined", _A, "jane@host.org", "j@h", "+1 415 555 0137")
for _name, _body in {
    "luhn": lambda d: d.luhn("w"), "entropy": lambda d: f"round({d.entropy('w')}, 6)", "placeholder": lambda d: d.placeholder("w"), "looks_random": lambda d: d.looks_random("w"), "setting": lambda d: d.setting("w"),
    "ident_ref": lambda d: d.identifier("w"), "mask_keep_ends": lambda d: d.keep_ends("w", 3, 3), "mask_prefixed": lambda d: d.mask_prefixed("w"), "mask_email": lambda d: d.mask_email("w"), "mask_phone": lambda d: d.mask_digits("w"), "mask_card": lambda d: d.mask_card("w"),
    "tokenish": lambda d: G.tokenish(d, "w"),
}.items():
    _q(_name, lambda d, body=_body: f"SELECT w, {body(d)} AS result FROM {WORDS(d)} q")
_q("ipv4", lambda d: f"SELECT w, {d.valid_ipv4('w')} AS valid, {d.private_ipv4('w')} AS private FROM {WORDS(d)} q")
_q("mask_url", lambda d: f"SELECT w, {d.mask_url('w')} AS result FROM (SELECT DISTINCT url AS w FROM {d.table('pages')} WHERE url IS NOT NULL UNION SELECT * FROM {values(d, [(x,) for x in ('postgres' + '://u:p@h/x', 'https://a.b/c?d', 'redis' + '://h:6379', 'redis' + '://secret:abc', 'nourl', 'mysql://' + 'h' * 60)], 'w')}) q")
_q("mask_value", lambda d: f"SELECT detector_id, value, CASE " + " ".join(f"WHEN detector_id = '{r.id}' THEN {d.mask_value(r.id, 'value')}" for r in RULES) + f" ELSE {d.keep_ends('value', 3, 3)} END AS masked FROM (SELECT DISTINCT detector_id, value FROM " + found(d) + " f UNION SELECT * FROM " + values(d, [(r.id, v) for r in RULES for v in (_A, "ab@cd.org", "sk_live_" + _A)] + [("unknown", _A)], "detector_id, value") + ") q")
_DOTTED = lambda d: "(" + d.explode("line, v", f"(SELECT DISTINCT line FROM {lines(d)} l WHERE {d.like('line', '[0-9][.][0-9]')}) p", d.every("line", "([0-9]+(?:[.][0-9]+)+)", 1), "v") + ")"
_q("version_ctx", lambda d: f"SELECT line, v, {d.version_context('line', 'v')} AS result FROM (SELECT DISTINCT line, v FROM {_DOTTED(d)} x UNION SELECT * FROM {values(d, [('version 1.2.3.4', '1.2.3.4'), ('at 1.2.3.4', '1.2.3.4'), ('Node. 1.2.3.4', '1.2.3.4'), ('a long way from v 9.9.9.9', '9.9.9.9'), ('dev 9.9.9.9', '9.9.9.9'), ('v1 1.1.1.1', '1.1.1.1'), ('none', 'x')], 'line, v')}) q")
_PAIRS = [("sk_live_abcdef123456", "sk_live_abcdef12345"), ("abcdefgh1234", "abcdefgh1239"), ("10.20.30.41", "10.20.30.42"), ("short", "short"), ("kitten12", "sitting1"), (_A, _A.lower()), (_A, _A[:9]), ("abcdefghij", "zzzzzzzzzz"), ("token-aaaa-1111", "token aaaa 1111")]
_q("edit_distance", lambda d: f"SELECT a, b, cast({d.edit_distance('a', 'b', '4')} AS INT) AS result FROM {values(d, _PAIRS, 'a, b')} q UNION ALL SELECT a.c_name AS a, b.s_name AS b, cast({d.edit_distance('a.c_name', 'b.s_name', '12')} AS INT) AS result FROM {d.table('customer')} a JOIN {d.table('supplier')} b ON a.c_custkey = b.s_suppkey")
#: Values of neighbouring findings of a document, and names that share a key.
_NEIGHBOURS = lambda d: f"(SELECT a, b FROM (SELECT value AS a, lead(value) OVER (PARTITION BY doc_id ORDER BY line_no, detector_id, value) AS b FROM {found(d)} f) p WHERE b IS NOT NULL UNION ALL SELECT c.c_name AS a, s.s_name AS b FROM {d.table('customer')} c JOIN {d.table('supplier')} s ON c.c_custkey = s.s_suppkey UNION ALL SELECT * FROM {values(d, _PAIRS, 'a, b')})"
_q("same_secret", lambda d: f"SELECT a, b, {d.same_secret('a', 'b')} AS result FROM {_NEIGHBOURS(d)} q")
_q("safe_name", lambda d: "SELECT w, coalesce(nullif(" + d.sub(d.sub("w", "[^A-Za-z0-9._-]+", "-"), "^-+|-+$") + ", ''), 'video') AS result FROM " + WORDS(d) + " q")
_q("fmt", lambda d: f"SELECT t, {G.fmt_time(d, 't')} AS result, {G.fmt_timecode(d, 't')} AS timecode, {G.fmt_range(d, 't', 't + 0.04')} AS span, {G.fmt_bytes(d, 'b')} AS bytes FROM (SELECT cast(event_id AS DOUBLE) * 0.37 AS t, cast(event_id * event_id * 37 AS BIGINT) AS b FROM {d.table('events')}) q")


# ------------------------------------------------------------------ lines

_KEPT = lambda d: d.keep(d.split("line", " "), "w", "w <> ''")
_q("build_line", lambda d: f"SELECT l.doc_id, l.line_no, {d.join(_KEPT(d), ' ')} AS line, s.word_starts FROM {lines(d)} l JOIN (SELECT doc_id, line_no, {d.sorted('collect_list(start)' if d.spark else 'list(start)')} AS word_starts FROM {G.words_at(d, lines(d), _KEPT(d))} w GROUP BY doc_id, line_no) s ON l.doc_id = s.doc_id AND l.line_no = s.line_no")
_q("despace", lambda d: f"SELECT doc_id, line_no, {native.despaced('line')} AS result FROM {lines(d)} l" if d.spark else f"WITH l AS (SELECT doc_id AS id, line_no, line FROM {lines(d)} q), {scan_sql.DESPACED}")
_q("category_filter", lambda d: f"SELECT * FROM {found(d)} f WHERE category IN ('personal', 'financial')")
_q("ocr_words", lambda d: f"SELECT doc_id, line_no, idx, text, x, y, w, h, confidence FROM {G.ocr_words(d, lines(d))} q")
_q("ocr_flatten", lambda d: f"SELECT doc_id, line_no, idx, trim(text) AS text, x / 2 AS x, y / 2 AS y, w / 2 AS w, h / 2 AS h, confidence / 100 AS confidence FROM (SELECT doc_id, line_no, idx, text, x * 2 AS x, y * 2 AS y, w * 2 AS w, h * 2 AS h, confidence * 100 AS confidence FROM {G.ocr_words(d, lines(d))} q) r WHERE trim(text) <> ''")


def places(d: Dialect) -> str:
    """doc_id, line_no, value, s: every offset at which the value of a finding stands in its line."""
    cut = "split(l.line, concat('\\\\Q', f.value, '\\\\E'), -1)" if d.spark else "string_split(l.line, f.value)"
    base = f"(SELECT f.doc_id, f.line_no, f.value, {cut} AS parts FROM (SELECT DISTINCT doc_id, line_no, value FROM {found(d)} x) f JOIN {lines(d)} l ON f.doc_id = l.doc_id AND f.line_no = l.line_no WHERE instr(l.line, f.value) > 0)"
    each = d.explode("doc_id, line_no, value, parts, i", f"{base} p", d.range("1", d.size("parts")), "i")
    ends = f"(sum(length({d.at('parts', 'i')}) + length(value)) OVER (PARTITION BY doc_id, line_no, value ORDER BY i) - length(value))"
    return f"(SELECT doc_id, line_no, value, cast(s AS INT) AS s FROM (SELECT doc_id, line_no, value, i, {d.size('parts')} AS n, {ends} AS s FROM ({each}) e) q WHERE i < n)"


_q("match_boxes", lambda d: f"SELECT m.doc_id, m.line_no, m.value, m.s, min(w.x) AS x, min(w.y) AS y, max(w.x + w.w) - min(w.x) AS w, max(w.y + w.h) - min(w.y) AS h, round(avg(w.confidence), 6) AS confidence FROM {places(d)} m JOIN {G.ocr_words(d, lines(d))} w ON m.doc_id = w.doc_id AND m.line_no = w.line_no AND m.s < w.start + length(w.text) AND w.start < m.s + length(m.value) GROUP BY m.doc_id, m.line_no, m.value, m.s")


# ------------------------------------------------------------------ aggregates over findings

_q("severity_tally", lambda d: f"SELECT s.severity, count(f.value) AS n FROM {dims(d, SEVERITIES, 'severity')} s LEFT JOIN {found(d)} f ON f.severity = s.severity GROUP BY s.severity")
_q("by_category", lambda d: f"SELECT c.category, c.ord, count(*) AS n, count(DISTINCT f.value) AS n_values FROM {dims(d, CATEGORIES, 'category')} c JOIN {found(d)} f ON f.category = c.category GROUP BY c.category, c.ord")
_RULE_DIM = [(r.id, r.label, r.category, r.severity) for r in RULES] + [("face", "Face", "visual", "medium"), ("qr", "QR code", "visual", "high")]
_q("detector_dim", lambda d: f"SELECT f.detector_id, r.label, count(*) AS n FROM {found(d)} f JOIN {values(d, _RULE_DIM, 'id, label, category, severity')} r ON f.detector_id = r.id GROUP BY f.detector_id, r.label")
_q("rule_counts", lambda d: f"SELECT r.category, count(*) AS n, coalesce(sum(f.n), 0) AS n_found FROM {values(d, _RULE_DIM, 'id, label, category, severity')} r LEFT JOIN (SELECT detector_id, count(*) AS n FROM {found(d)} x GROUP BY detector_id) f ON f.detector_id = r.id GROUP BY ROLLUP (r.category)")
_q("review_decisions", lambda d: f"SELECT f.doc_id, f.line_no, f.detector_id, f.masked, coalesce(l.redact, TRUE) AS redact FROM {found(d)} f LEFT JOIN (SELECT doc_id, min(toxic) = 0 AS redact FROM {d.table('labels')} GROUP BY doc_id) l ON f.doc_id = l.doc_id")
_q("redaction_ratio", lambda d: f"SELECT count(*) AS total, sum(CASE WHEN coalesce(l.redact, TRUE) THEN 1 ELSE 0 END) AS redacted FROM {found(d)} f LEFT JOIN (SELECT doc_id, min(toxic) = 0 AS redact FROM {d.table('labels')} GROUP BY doc_id) l ON f.doc_id = l.doc_id")
_q("distinct_keys", lambda d: f"SELECT doc_id, count(DISTINCT detector_id || '|' || lower(value)) AS n_keys FROM {found(d)} f GROUP BY doc_id")
_q("ordered_findings", lambda d: f"SELECT doc_id, line_no, masked, row_number() OVER (ORDER BY {RANK}, doc_id, line_no, detector_id, value) AS place FROM {found(d)} x")
_q("top_finding", lambda d: f"SELECT doc_id, masked FROM (SELECT doc_id, masked, row_number() OVER (PARTITION BY doc_id ORDER BY {RANK}, line_no, detector_id, value) AS r FROM {found(d)} f) q WHERE r = 1")
_q("best_identity", lambda d: f"SELECT doc_id, detector_id, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {RANK}, CASE WHEN detector_id IN ('labeled-secret', 'secret-assignment', 'bearer-token', 'password-assignment') THEN 1 ELSE 0 END, -length(value), line_no, detector_id, value) AS r FROM {found(d)} f) q WHERE r = 1")
_q("union_hits", lambda d: f"SELECT doc_id AS id, detector_id || '|' || lower(value) AS k, 'ocr' AS source FROM {found(d)} f UNION ALL SELECT event_id AS id, k, 'qr' AS source FROM {hits(d)} h WHERE strong")


# ------------------------------------------------------------------ sightings in time

CLOSE = "sqrt((a.x + a.w / 2 - b.x - b.w / 2) * (a.x + a.w / 2 - b.x - b.w / 2) + (a.y + a.h / 2 - b.y - b.h / 2) * (a.y + a.h / 2 - b.y - b.h / 2))"
_q("qr_corroborate", lambda d: f"SELECT event_id, video, k, t FROM {hits(d)} a WHERE strong OR EXISTS (SELECT 1 FROM {hits(d)} b WHERE b.video = a.video AND b.k = a.k AND b.t <> a.t AND abs(b.t - a.t) <= 4 AND {CLOSE} <= 3 * greatest(a.w, a.h) + 40)")
_q("qr_window", lambda d: f"SELECT event_id, count(*) OVER (PARTITION BY video, k ORDER BY t RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS n FROM {hits(d)} a")
_SESSION = lambda d: f"(SELECT *, sum(fresh) OVER (PARTITION BY video, k ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY video, k ORDER BY t, event_id) <= 1.25 THEN 0 ELSE 1 END AS fresh FROM {hits(d)} a) q)"
_q("sessions", lambda d: f"SELECT video, k, s, min(t) AS first_t, max(t) AS last_t, max(conf) AS conf, count(*) AS n FROM {_SESSION(d)} q GROUP BY video, k, s")
_q("findings_time", lambda d: f"SELECT q.video, k, s, greatest(0.0, min(t) - 0.5) AS start_t, least(max(v.dur), max(t) + 0.5) AS end_t FROM {_SESSION(d)} q JOIN (SELECT video, max(t) AS dur FROM {hits(d)} a GROUP BY video) v ON v.video = q.video GROUP BY q.video, k, s")
_q("established", lambda d: f"SELECT video, k, s, max(conf) AS conf FROM {_SESSION(d)} q WHERE conf >= 0.45 GROUP BY video, k, s HAVING max(conf) >= 0.7")
_q("strongest_hit", lambda d: f"SELECT video, event_id, conf FROM (SELECT *, row_number() OVER (PARTITION BY video, floor(t) ORDER BY conf DESC, event_id) AS r FROM {hits(d)} a) q WHERE r = 1")
_q("face_stitch", lambda d: f"SELECT video, k, event_id, t, {G.face_match('lx', 'ly', 'lw', 'lh', 'x', 'y', 'w', 'h')} AND lt < t AND t - lt <= 1.25 AS stitches FROM (SELECT *, lag(t) OVER w1 AS lt, lag(x) OVER w1 AS lx, lag(y) OVER w1 AS ly, lag(w) OVER w1 AS lw, lag(h) OVER w1 AS lh FROM {hits(d)} a WINDOW w1 AS (PARTITION BY video, k ORDER BY t, event_id)) q WHERE lt IS NOT NULL")
_q("reach", lambda d: f"SELECT a.event_id AS a_id, b.event_id AS b_id, {CLOSE} <= 3 * greatest(a.w, a.h, b.w, b.h) + 40 AS near, {CLOSE} AS dist FROM {hits(d)} a JOIN {hits(d)} b ON a.video = b.video AND a.k = b.k AND a.event_id < b.event_id AND abs(a.t - b.t) <= 1.25")
_q("dup_pairs", lambda d: f"SELECT a.event_id AS a_id, b.event_id AS b_id FROM {hits(d)} a JOIN {hits(d)} b ON a.video = b.video AND a.event_id < b.event_id AND abs(a.t - b.t) <= 1.5 AND {G.overlap('a', 'b')} > 0.3 AND {d.same_secret('a.k', 'b.k')}")
_q("iou_pairs", lambda d: f"SELECT a.event_id AS a_id, b.event_id AS b_id, round({G.iou('a', 'b')}, 6) AS iou FROM {hits(d)} a JOIN {hits(d)} b ON a.video = b.video AND a.event_id < b.event_id AND floor(a.t * 2) = floor(b.t * 2) AND {G.iou('a', 'b')} > 0.3")
_q("box_math", lambda d: f"SELECT a.event_id AS a_id, b.event_id AS b_id, round({CLOSE}, 6) AS dist, round({G.overlap('a', 'b')}, 6) AS ratio, round({G.iou('a', 'b')}, 6) AS iou, {G.moved('a', 'b')} AS moved FROM {hits(d)} a JOIN {hits(d)} b ON a.video = b.video AND b.event_id > a.event_id AND abs(b.t - a.t) <= 1.25")
_q("face_match", lambda d: f"SELECT a.event_id AS a_id, b.event_id AS b_id, {G.face_match('a.x', 'a.y', 'a.w', 'a.h', 'b.x', 'b.y', 'b.w', 'b.h')} AS result FROM {hits(d)} a JOIN {hits(d)} b ON a.video = b.video AND b.event_id > a.event_id AND abs(b.t - a.t) <= 1.25")
_q("qr_dedupe", lambda d: f"SELECT a.event_id FROM {hits(d)} a WHERE NOT EXISTS (SELECT 1 FROM {hits(d)} b WHERE b.video = a.video AND b.k = a.k AND floor(b.t * 2) = floor(a.t * 2) AND b.event_id < a.event_id AND {G.overlap('a', 'b')} > 0)")

_VIDEOS = lambda d: f"(SELECT video, max(t) AS dur FROM {hits(d)} a GROUP BY video HAVING max(t) > 0)"
GRID = lambda d: "(" + d.explode("video, i, least(dur - 0.001, i * 0.5) AS t", f"{_VIDEOS(d)} v", d.range("0", "greatest(1, floor(dur / 0.5))"), "i") + ")"
_q("sample_grid", lambda d: f"SELECT video, i, round(t, 6) AS t FROM {GRID(d)} g")
_AROUND = lambda d: (
    "(SELECT video, i, t, max(f) OVER (PARTITION BY video ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before_t, min(f) OVER (PARTITION BY video ORDER BY t RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after_t"
    f" FROM (SELECT video, i, t, cast(NULL AS DOUBLE) AS f FROM {GRID(d)} g UNION ALL SELECT video, NULL AS i, t, t AS f FROM {hits(d)} h) u)"
)
_q("nearest_frame", lambda d: f"SELECT video, i, round(t, 6) AS t, frame_t, coalesce(abs(frame_t - t) <= 0.05, FALSE) AS ok FROM (SELECT video, i, t, CASE WHEN before_t IS NULL OR after_t - t < t - before_t THEN after_t ELSE before_t END AS frame_t FROM {_AROUND(d)} w WHERE i IS NOT NULL) q")
_FINDINGS = lambda d: f"(SELECT video, k, s, greatest(0.0, min(t) - 0.5) AS start_t, max(t) + 0.5 AS end_t, max(conf) AS conf FROM {_SESSION(d)} q GROUP BY video, k, s)"
_q("active_at", lambda d: f"SELECT g.video, g.i, count(*) AS n FROM {GRID(d)} g JOIN {_FINDINGS(d)} f ON f.video = g.video AND f.start_t <= g.t AND g.t <= f.end_t GROUP BY g.video, g.i")
_BRACKET = lambda d: (
    f"(SELECT g.video, g.i, g.t, f.k, f.s, coalesce(max(CASE WHEN o.t <= g.t THEN o.t END), min(o.t)) AS before_t, coalesce(min(CASE WHEN o.t >= g.t THEN o.t END), max(o.t)) AS after_t"
    f" FROM {GRID(d)} g JOIN {_FINDINGS(d)} f ON f.video = g.video AND f.start_t <= g.t AND g.t <= f.end_t JOIN {_SESSION(d)} o ON o.video = f.video AND o.k = f.k AND o.s = f.s GROUP BY g.video, g.i, g.t, f.k, f.s)"
)


def boxes_at(d: Dialect) -> str:
    """Boxes of each finding at each sample: those of the observations around it, paired by their nearest corners, each pair as one box if it is in
    reach; what stands afterwards alone is added unless something covers it."""
    at = lambda side: f"(SELECT b.video, b.i, b.k, b.s, b.before_t, b.after_t, o.event_id, o.x, o.y, o.w, o.h FROM {_BRACKET(d)} b JOIN {_SESSION(d)} o ON o.video = b.video AND o.k = b.k AND o.s = b.s AND o.t = b.{side}_t)"
    key = "p.video = q.video AND p.i = q.i AND p.k = q.k AND p.s = q.s"
    far = "sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y))"
    hull = lambda lo, side: f"CASE WHEN apart THEN {lo} ELSE greatest({lo} + {side}, a{lo} + a{side}) - least({lo}, a{lo}) END AS {side}" if side else f"CASE WHEN apart THEN {lo} ELSE least({lo}, a{lo}) END AS {lo}"
    return (
        f"WITH p AS {at('before')}, a AS {at('after')}, m AS (SELECT p.*, q.x AS ax, q.y AS ay, q.w AS aw, q.h AS ah, p.before_t = p.after_t OR {far} > 4 * greatest(p.w, p.h) + 60 AS apart,"
        f" row_number() OVER (PARTITION BY p.video, p.i, p.k, p.s, p.event_id ORDER BY {far}, q.event_id) AS r FROM p JOIN a q ON {key}),"
        " one AS (SELECT video, i, k, s, event_id, CASE WHEN apart THEN x ELSE least(x, ax) END AS x, CASE WHEN apart THEN y ELSE least(y, ay) END AS y,"
        " CASE WHEN apart THEN w ELSE greatest(x + w, ax + aw) - least(x, ax) END AS w, CASE WHEN apart THEN h ELSE greatest(y + h, ay + ah) - least(y, ay) END AS h FROM m WHERE r = 1),"
        " more AS (SELECT q.video, q.i, q.k, q.s, q.event_id, q.x, q.y, q.w, q.h FROM a q WHERE q.before_t <> q.after_t"
        f" AND NOT EXISTS (SELECT 1 FROM one p WHERE {key} AND p.x <= q.x AND p.y <= q.y AND p.x + p.w >= q.x + q.w AND p.y + p.h >= q.y + q.h)"
        f" AND NOT EXISTS (SELECT 1 FROM a p WHERE {key} AND p.event_id < q.event_id AND p.x <= q.x AND p.y <= q.y AND p.x + p.w >= q.x + q.w AND p.y + p.h >= q.y + q.h))"
        " SELECT video, i, k, s, event_id, x, y, w, h FROM one UNION ALL SELECT video, i, k, s, event_id, x, y, w, h FROM more"
    )


_q("boxes_at", boxes_at)
_q("active_boxes", lambda d: (
    f"SELECT f.video, f.i, f.k, f.s, f.event_id, {G.dilated('f', 640, 360)} FROM ({boxes_at(d)}) f LEFT JOIN (SELECT doc_id, min(toxic) = 0 AS redact FROM {d.table('labels')} GROUP BY doc_id) l ON l.doc_id = f.video WHERE coalesce(l.redact, TRUE)"
))
_q("dilate", lambda d: f"SELECT event_id, {G.dilated('f', 320, 200)} FROM {hits(d)} f")
_q("running_max", lambda d: f"SELECT event_id, max(conf) OVER (PARTITION BY video, k ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS best, min(t) OVER (PARTITION BY video, k ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS first_t FROM {hits(d)} a")
_q("distinct_times", lambda d: f"SELECT video, {d.size(d.sorted(d.distinct('ts')))} AS n FROM (SELECT video, {'collect_list(t)' if d.spark else 'list(t)'} AS ts FROM {hits(d)} a GROUP BY video) q")


# ------------------------------------------------------------------ arrays, images, geometry

_CELLS = lambda d, scale: f"(SELECT vec_id, label, {d.map('embedding', 'v', f'cast(least(255, floor(abs(cast(v AS DOUBLE)) * {scale})) AS INT)')} AS c FROM {d.table('embeddings')})"
_DIFF = lambda d: d.map(d.range("1", d.size("c")), "i", f"abs({d.at('c', 'i')} - {d.at('p', 'i')})")
_q("dark_frames", lambda d: f"SELECT vec_id, {d.total(d.map('c', 'v', d.num('v')))} / {d.size('c')} < 110 AS dark FROM {_CELLS(d, 1000)} q")
_q("sig_diff", lambda d: f"SELECT vec_id, cells, round(mean, 6) AS mean, cells >= 8 OR mean >= 1.0 AS changed FROM (SELECT vec_id, {d.size(d.keep(_DIFF(d), 'v', 'v > 14'))} AS cells, {d.total(d.map(_DIFF(d), 'v', d.num('v')))} / {d.size('c')} AS mean FROM (SELECT vec_id, c, lag(c) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM {_CELLS(d, 255)} q) r WHERE p IS NOT NULL) s")
_q("luma", lambda d: f"SELECT r, g, b, cast(floor((77 * r + 150 * g + 29 * b) / 256.0) AS INT) AS luma FROM (SELECT cast(event_id % 256 AS INT) AS r, cast(event_id * 7 % 256 AS INT) AS g, cast(event_id * 13 % 256 AS INT) AS b FROM {d.table('events')}) q")
_q("percentile_idx", lambda d: f"SELECT vec_id, {d.at(d.sorted('c'), f'cast(floor(({d.size(chr(99))} - 1) * 0.95 + 0.5) AS INT) + 1')} AS p95, {d.at(d.sorted('c'), f'cast(floor({d.size(chr(99))} / 2.0) AS INT) + 1')} AS upper_median FROM {_CELLS(d, 255)} q")
_SIZES = [(480, 270), (1024, 1024), (1366, 768), (1600, 900), (800, 1280), (2560, 1440), (4096, 2304), (4000, 700)]
#: Sizes of frames: those that follow from parts, and some that screens have.
FRAMES = lambda d: f"(SELECT DISTINCT cast(240 + 80 * p_size AS INT) AS w, cast(160 + p_partkey % 2000 AS INT) AS h FROM {d.table('part')} UNION SELECT * FROM {values(d, _SIZES, 'w, h')})"
_TIMES = lambda d, frames, column, xs: "(" + d.explode(f"w, h, {column}", f"{frames} f", d.array(*map(str, xs)), column) + ")"
_q("ocr_scale", lambda d: f"SELECT w, h, round(least(2.0, greatest(1.0, least(1600.0 / h, sqrt(2000000.0 / (cast(w AS DOUBLE) * h))))), 6) AS scale FROM {FRAMES(d)} q")
_q("tile_ladder", lambda d: (
    f"SELECT w, h, m, {d.map(d.keep(d.range('0', '20'), 'i', 'm < enough AND first < shortest AND (i = 0 OR least(shortest, first * pow(2.5, i - 1)) < least(enough, shortest))'), 'i', 'cast(floor(least(shortest, first * pow(2.5, i)) + 0.5) AS BIGINT)')} AS sides"
    f" FROM (SELECT w, h, m, 22.0 * greatest(w, h) / 128 AS enough, m * 128 / 22.0 AS first, cast(least(w, h) AS DOUBLE) AS shortest FROM {_TIMES(d, FRAMES(d), 'm', (64, 20, 400))} q) r"
))
_q("tile_rects", lambda d: G.tile_rects(d, _TIMES(d, FRAMES(d), "s", (372, 931))))
_q("tile_explode", lambda d: f"SELECT w, h, s, x, y, det FROM ({G.tile_rects(d, _TIMES(d, FRAMES(d), 's', (372,)))}) q, {values(d, [('face',), ('qr',)], 'det')} k")
#: Sides of what is covered: of sightings, grown by their age.
_BOXES = lambda d: f"(SELECT DISTINCT cast(w + event_id % 500 AS INT) AS w, cast(h + event_id % 300 AS INT) AS h FROM {hits(d)} a)"
_q("mosaic_grid", lambda d: f"SELECT bw, bh, cells, {G.mosaic('bw', 'bh', 'cells')} FROM (SELECT w AS bw, h AS bh, cells FROM {_TIMES(d, _BOXES(d), 'cells', (1, 3, 6, 9, 15, 40))} b UNION SELECT * FROM {values(d, [(w, h, c) for w, h in ((30, 12), (64, 64), (210, 35), (512, 480), (1500, 990)) for c in (1, 3, 6, 9, 15, 40)], 'bw, bh, cells')}) q")
_q("export_params", lambda d: f"SELECT w, h, greatest(2, w - w % 2) AS ew, greatest(2, h - h % 2) AS eh, least(16000000.0, greatest(2000000.0, 0.12 * w * h * 30)) AS bitrate FROM (SELECT * FROM {FRAMES(d)} f UNION SELECT * FROM {values(d, [(101, 57), (1, 1)], 'w, h')}) q")
_q("scale_pitch", lambda d: f"SELECT pitch, CASE WHEN pitch IS NULL OR pitch <= 0 THEN 2.0 ELSE round(least(6.0, greatest(1.0, 26.0 / (0.48 * pitch))), 6) END AS scale FROM (SELECT DISTINCT cast(length(line) AS DOUBLE) / 4 AS pitch FROM {lines(d)} l UNION SELECT * FROM {values(d, [(0.0,), (5.0,), (12.5,), (16.0,), (40.0,), (100.0,), (None,)], 'pitch')}) q")
_q("needs_rebuild", lambda d: f"SELECT density, skew, region, region AND density >= 0.02 AND abs(skew) >= 1.0 AS rebuild FROM (SELECT conf / 20 AS density, x / 50 - 2 AS skew, strong AS region FROM {hits(d)} h UNION ALL SELECT * FROM {values(d, [(0.02, 1.0, True), (0.019, 3.0, True), (0.3, -2.5, True), (0.3, 0.99, True), (0.3, 5.0, False)], 'density, skew, region')}) q")
_q("strength_label", lambda d: f"SELECT cells, CASE WHEN cells <= 4 THEN 'strongest' WHEN cells <= 6 THEN 'strong' WHEN cells <= 8 THEN 'moderate' WHEN cells <= 13 THEN 'light' ELSE 'weak' END AS label FROM (SELECT DISTINCT cast(3 + (w + h) % 13 AS INT) AS cells FROM {_BOXES(d)} b) q")
_DURATIONS = lambda d: f"(SELECT DISTINCT dur FROM (SELECT max(t) AS dur FROM {hits(d)} a GROUP BY video UNION ALL SELECT t * 90 AS dur FROM {hits(d)} b UNION ALL SELECT * FROM {values(d, [(8.0,), (22.0,), (90.0,), (95.0,), (1000.0,), (2700.0,), (9999.0,)], 'dur')}) e)"
_q("tick_step", lambda d: f"SELECT dur, CASE " + " ".join(f"WHEN dur / {i} <= 9 THEN {i}" for i in (1, 2, 5, 10, 15, 30, 60, 120, 300)) + f" ELSE 600 END AS step FROM {_DURATIONS(d)} q")
_q("affine_box", lambda d: f"SELECT event_id, {G.affine('f', 0.5, -0.25, 10, 0.25, 2, -5)} FROM {hits(d)} f")
_CORNERS = [("good", "https://a.io/x", 1, 0.0, 0.0, 100.0, 0.0, 100.0, 100.0, 0.0, 100.0), ("thin", "https://a.io/x", 1, 0.0, 0.0, 100.0, 0.0, 100.0, 20.0, 0.0, 20.0), ("small", "x", 1, 0.0, 0.0, 10.0, 0.0, 10.0, 10.0, 0.0, 10.0), ("skewed", "abcdefghij", 2, 0.0, 0.0, 80.0, 0.0, 110.0, 60.0, 30.0, 60.0), ("unnumbered", "Zażółć gęślą", 0, 0.0, 0.0, 80.0, 0.0, 80.0, 80.0, 0.0, 80.0), ("folded", "abcdefghij", 1, 0.0, 0.0, 0.0, 0.0, 80.0, 80.0, 0.0, 80.0), ("tilted", "https://a.io/x", 1, 0.0, 0.0, 60.0, 0.0, 95.0, 49.0, 35.0, 49.0), ("short", "abc", 1, 0.0, 0.0, 90.0, 0.0, 90.0, 90.0, 0.0, 90.0), ("empty", "", 1, 0.0, 0.0, 90.0, 0.0, 90.0, 90.0, 0.0, 90.0), ("dense", "abcdefghij", 40, 0.0, 0.0, 90.0, 0.0, 90.0, 90.0, 0.0, 90.0)]
#: Codes where sightings are, each leaning by what its id says, and hand-made ones.
_QR = lambda d: (
    f"(SELECT concat('sighting ', cast(event_id AS VARCHAR(20))) AS note, concat(k, ' ', cast(event_id AS VARCHAR(20))) AS data, cast(event_id % 5 AS INT) AS version, x AS tlx, y AS tly, x + w AS trx, y + event_id % 4 * 6.0 AS try_,"
    f" x + w - event_id % 3 * 15.0 AS brx, y + w AS bry, x + event_id % 3 * 5.0 AS blx, y + w - event_id % 6 * 9.0 AS bly FROM {hits(d)} a UNION ALL SELECT * FROM {values(d, _CORNERS, 'note, data, version, tlx, tly, trx, try_, brx, bry, blx, bly')})"
)
_q("qr_geometry", lambda d: G.qr_geometry(d, _QR(d)))
_q("judge_qr", lambda d: G.judge_qr(d, _QR(d)))


def spark_text(name: str) -> str:
    """The template in Spark's dialect; numbers with a point are doubles there, as they are elsewhere."""
    return re.sub(r"('[^']*')|(?<![\w.])([0-9]+[.][0-9]+)(?![\w.])", lambda m: m[1] or m[2] + "D", TEMPLATES[name](SPARK))


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = spark_text(name)
        for t in TABLES:
            if SPARK.table(t) in text:
                table = spark.read.parquet(f"{sf_dir}/{t}.parquet")
                (spread(table) if t == "documents" else table).createOrReplaceTempView(SPARK.table(t))
        return spark.sql(text)

    run.__name__ = name
    return run


def ordered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings by severity, then place: numbered in sampled ranges, so that no task orders all of them, however ids are spread."""
    rows = _run("ordered_findings_rows")(spark, sf_dir)
    return numbered(rows, ["rank", "doc_id", "line_no", "detector_id", "value"], "place").select("doc_id", "line_no", "masked", "place")


TEMPLATES["ordered_findings_rows"] = lambda d: f"SELECT {RANK} AS rank, doc_id, line_no, detector_id, value, masked FROM {found(d)} x"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _run(name) for name in TEMPLATES if name != "ordered_findings_rows"} | {"ordered_findings": ordered_findings} | scans.QUERIES | sightings.QUERIES
ORACLES: dict[str, str] = {name: template(DUCK) for name, template in TEMPLATES.items() if name != "ordered_findings_rows"} | scans.ORACLES | sightings.ORACLES
