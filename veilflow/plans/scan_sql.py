"""The scan of lines in SQL of another engine, written apart from the Spark form: rows and windows where that one has arrays and folds.

Views come from tokens of a line, places from sums over the pieces of a marked text, overlaps are resolved by a recursive walk over ranked
matches.  Patterns, tests and masks of rules are shared, as they are fixed values.
"""

from __future__ import annotations

from veilflow.detect.native import marking
from veilflow.detect.rules import RULES, SEVERITIES
from veilflow.functions.dialect import DUCK
from veilflow.operators.geometry import tokenish

_GLUE = "':/.@=_-'"


def lines_cte(table: str = "documents", id_col: str = "doc_id", text_col: str = "text", lines: str = "l") -> str:
    return f"ls AS (SELECT {id_col} AS id, string_split({text_col}, chr(10)) AS ls FROM {table} WHERE {text_col} IS NOT NULL), {lines} AS (SELECT id, k AS line_no, ls[k] AS line FROM ls, unnest(range(1, len(ls) + 1)) AS u(k) WHERE trim(ls[k], ' ') <> '')"


#: Tokens are runs of spaces and what stands between; a run is cut by its neighbours, one that begins the line but for its first space.
VIEWS = rf"""
tk AS (SELECT id, line_no, regexp_extract_all(line, ' +|[^ ]+') AS ts FROM l WHERE contains(line, ' ')),
tw AS (SELECT id, line_no, generate_subscripts(ts, 1) AS p, unnest(ts) AS tok FROM tk),
tn AS (SELECT *, lag(tok) OVER o AS prev, lead(tok) OVER o AS next FROM tw WINDOW o AS (PARTITION BY id, line_no ORDER BY p)),
tc AS (SELECT id, line_no, p, tok, CASE WHEN NOT starts_with(tok, ' ') OR next IS NULL THEN 0 WHEN prev IS NULL THEN CASE WHEN contains({_GLUE}, left(next, 1)) THEN length(tok) - 1 ELSE 0 END
  WHEN contains({_GLUE}, right(prev, 1)) OR contains({_GLUE}, left(next, 1)) THEN length(tok) ELSE 0 END AS gone FROM tn),
ds AS (SELECT id, line_no, string_agg(left(tok, length(tok) - gone), '' ORDER BY p) AS text FROM tc GROUP BY id, line_no HAVING sum(gone) > 0),
cut AS (SELECT id, line_no, spot, gone FROM (SELECT id, line_no, gone, sum(length(tok) - gone) OVER (PARTITION BY id, line_no ORDER BY p) AS spot FROM tc) q WHERE gone > 0),
fp AS (SELECT id, line_no, regexp_extract_all(line, '[A-Za-z0-9_.-]+|[^A-Za-z0-9_.-]+') AS ps FROM l WHERE regexp_matches(line, '[Ool][A-Za-z0-9]')),
fw AS (SELECT id, line_no, generate_subscripts(ps, 1) AS p, unnest(ps) AS run FROM fp),
ff AS (SELECT id, line_no, p, run, CASE WHEN regexp_full_match(run, '[A-Za-z0-9_.-]{{8,}}') AND regexp_matches(run, '[_0-9-]') THEN array_to_string(list_transform(range(1, length(run) + 1), lambda i:
  CASE WHEN regexp_full_match(substr(run, i + 1, 3), '[A-Za-z0-9]{{3}}') THEN CASE substr(run, i, 1) WHEN 'O' THEN '0' WHEN 'o' THEN '0' WHEN 'l' THEN '1' ELSE substr(run, i, 1) END ELSE substr(run, i, 1) END), '') ELSE run END AS to_ FROM fw),
fs AS (SELECT id, line_no, string_agg(to_, '' ORDER BY p) AS text FROM ff GROUP BY id, line_no HAVING bool_or(to_ <> run)),
v AS (SELECT id, line_no, 0 AS view, line AS text FROM l UNION ALL SELECT id, line_no, 1, text FROM fs UNION ALL SELECT id, line_no, 2, text FROM ds),
vl AS (SELECT *, lower(text) AS low FROM v)"""

#: Of all lines of ``l``.
DESPACED = f"{VIEWS} SELECT l.id AS doc_id, l.line_no, coalesce(ds.text, l.line) AS result FROM l LEFT JOIN ds USING (id, line_no)"


def _rule(i: int) -> str:
    r = RULES[i]
    pattern, more = DUCK.rule_pattern(r)
    marked = marking(DUCK, "text", pattern, r.group, r.ignore_case)
    parts = f"SELECT id, line_no, view, text, string_split({marked}, chr(1)) AS ps FROM vl WHERE {DUCK.may('text', 'low', r)}"
    each = f"SELECT id, line_no, view, text, generate_subscripts(ps, 1) AS k, unnest(ps) AS part FROM ({parts}) q WHERE len(ps) > 1"
    placed = f"SELECT *, coalesce(sum(length(part) - (k > 1)::INT) OVER (PARTITION BY id, line_no, view ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM ({each}) q"
    valued = f"SELECT id, line_no, view, text, s, s + instr(part, chr(2)) - 1 AS e, substr(text, s::INT + 1, instr(part, chr(2))::INT - 1) AS value FROM ({placed}) q WHERE k > 1"
    return f"SELECT {i} AS rule, id, line_no, view, s, e, value FROM ({valued}) q WHERE value <> '' AND {more} AND {DUCK.validate(r.id, 'value', 'text')}"


_PLACE = "coalesce((SELECT sum(gone) FROM cut WHERE cut.id = m.id AND cut.line_no = m.line_no AND m.view = 2 AND cut.spot <= {at}), 0)"
MATCHES = (
    "m AS (" + " UNION ALL ".join(_rule(i) for i in range(len(RULES))) + f"), ml AS (SELECT rule, id, line_no, view, s + {_PLACE.format(at='m.s')} AS s, e + {_PLACE.format(at='m.e - 1')} AS e, value FROM m),"
    " d AS (SELECT rule, id, line_no, view, s::BIGINT AS s, e::BIGINT AS e, value FROM (SELECT *, max(length(value)) OVER (PARTITION BY id, line_no, rule, s ORDER BY view ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS longest FROM ml) q WHERE longest IS NULL OR longest < length(value))"
)
_case = lambda field, x="rule": f"CASE {x} " + " ".join(f"WHEN {i} THEN '{getattr(r, field)}'" for i, r in enumerate(RULES)) + " END"
_RANK = "CASE rule " + " ".join(f"WHEN {i} THEN {SEVERITIES.index(r.severity)}" for i, r in enumerate(RULES)) + " END"
RESOLVED = f"""
o AS (SELECT *, row_number() OVER (PARTITION BY id, line_no ORDER BY {_RANK}, s - e, s, rule, view) AS r FROM d),
g AS (
  SELECT id, line_no, 1 AS r, [struct_pack(s := s, e := e, r := r)] AS kept FROM o WHERE r = 1
  UNION ALL
  SELECT g.id, g.line_no, g.r + 1, CASE WHEN len(list_filter(g.kept, lambda x: o.s < x.e AND x.s < o.e)) > 0 THEN g.kept ELSE list_append(g.kept, struct_pack(s := o.s, e := o.e, r := o.r)) END
  FROM g JOIN o ON o.id = g.id AND o.line_no = g.line_no AND o.r = g.r + 1
),
k AS (SELECT id, line_no, unnest(arg_max(kept, r)).r AS r FROM g GROUP BY id, line_no),
f AS (SELECT o.* FROM o JOIN k USING (id, line_no, r))"""
_MASK = "CASE rule " + " ".join(f"WHEN {i} THEN {DUCK.mask_value(r.id, 'value')}" for i, r in enumerate(RULES)) + " END"


def scan_sql(select: str, table: str = "documents", id_col: str = "doc_id", text_col: str = "text", more: str = "") -> str:
    return f"WITH RECURSIVE {lines_cte(table, id_col, text_col)}, {VIEWS}, {MATCHES}, {RESOLVED}{more} {select}"


#: Words of a line that holds a finding, with places; and how far the cover of a finding goes, one word after another.
WORDS = f""",
sw AS (SELECT id, line_no, string_split(line, ' ') AS ws FROM l WHERE (id, line_no) IN (SELECT (id, line_no) FROM f)),
se AS (SELECT id, line_no, generate_subscripts(ws, 1) AS p, unnest(ws) AS word FROM sw),
sp AS (SELECT id, line_no, p, word, sum(length(word) + 1) OVER (PARTITION BY id, line_no ORDER BY p) - length(word) - 1 AS a FROM se),
w AS (SELECT id, line_no, p, word, a, a + length(word) AS b, {tokenish(DUCK, 'word')} AS fits FROM sp WHERE word <> ''),
x AS (
  SELECT id, line_no, r, e AS far FROM f WHERE e - s >= 12
  UNION ALL
  SELECT x.id, x.line_no, x.r, n.b FROM x JOIN (SELECT id, line_no, a, b, fits FROM w) n ON n.id = x.id AND n.line_no = x.line_no AND n.a >= x.far AND n.a <= x.far + 1 AND n.fits
),
c AS (SELECT f.*, greatest(f.e, coalesce(y.far, f.e)) AS far FROM f LEFT JOIN (SELECT id, line_no, r, max(far) AS far FROM x GROUP BY id, line_no, r) y USING (id, line_no, r))"""
_CONFIDENCE = "round((abs(id * 31 + p) % 50 + 50) / 100.0, 2)"
FINDINGS = f"SELECT id AS doc_id, line_no, {_case('id')} AS detector_id, {_case('label')} AS label, {_case('category')} AS category, {_case('severity')} AS severity, {_MASK} AS masked, s AS start_at, e AS end_at, sha256(value) AS value_sha256 FROM f"
#: Lines of words joined by single spaces: places are counted over the words that are left.
HITS = f""",
hw AS (SELECT id, line_no, p, word, 8 * (sum(length(word) + 1) OVER (PARTITION BY id, line_no ORDER BY p) - length(word) - 1) AS x FROM (SELECT id, line_no, generate_subscripts(ws, 1) AS p, unnest(ws) AS word FROM (SELECT id, line_no, string_split(raw, ' ') AS ws FROM rl) a) b),
hb AS (SELECT id, line_no, p, word, x, 8 * length(word) AS w FROM hw WHERE word <> ''),
hp AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY id, line_no ORDER BY p) - length(word) - 1 AS a, round((abs(id * 31 + p) % 50 + 50) / 100.0, 2) AS conf FROM hb)
SELECT c.id AS doc_id, c.line_no, sha256({_case('id', 'any_value(c.rule)')} || '|' || lower(any_value(c.value))) AS key_sha256, {_case('id', 'any_value(c.rule)')} AS detector_id, {_case('severity', 'any_value(c.rule)')} AS severity,
  any_value(c.s) AS start_at, any_value(c.e) AS end_at, any_value(c.far) AS cover_end, min(hp.x)::DOUBLE AS x, any_value(18 * c.line_no)::DOUBLE AS y, (max(hp.x + hp.w) - min(hp.x))::DOUBLE AS w, 16::DOUBLE AS h, round(any_value(q.mean), 6) AS confidence
FROM c JOIN hp ON hp.id = c.id AND hp.line_no = c.line_no AND c.s < hp.a + length(hp.word) AND hp.a < c.far
JOIN (SELECT id, line_no, avg(conf::DOUBLE) AS mean FROM hp GROUP BY id, line_no) q ON q.id = c.id AND q.line_no = c.line_no
GROUP BY c.id, c.line_no, c.r"""
_JOINED = "l AS (SELECT id, line_no, line AS raw, array_to_string(list_filter(string_split(line, ' '), lambda y: y <> ''), ' ') AS line FROM l0)"


_FOUND_LINES = "rl AS (SELECT id, line_no, raw FROM l WHERE (id, line_no) IN (SELECT (id, line_no) FROM f))"
_HITS_SQL = f"WITH RECURSIVE {lines_cte(lines='l0')}, {_JOINED}, {VIEWS}, {MATCHES}, {RESOLVED}{WORDS}, {_FOUND_LINES}{HITS}"


ORACLES = {
    "findings": scan_sql(FINDINGS),
    "findings_by_category": scan_sql(f"SELECT {_case('category')} AS category, {_case('severity')} AS severity, {_case('id')} AS detector_id, count(*) AS n, count(DISTINCT id) AS n_docs FROM f GROUP BY rule"),
    "findings_in_pages": scan_sql(f"SELECT id AS page_id, line_no, {_case('id')} AS detector_id, {_MASK} AS masked, s AS start_at, e AS end_at FROM f", "pages", "page_id", "html"),
    "dedupe": scan_sql(f"SELECT id AS doc_id, line_no, {_case('id')} AS detector_id, s AS start_at, e AS end_at, sha256(value) AS value_sha256 FROM d"),
    "resolve_overlaps": scan_sql(f"SELECT id AS doc_id, {_case('id')} AS detector_id, count(*) AS n_before, count(k.r) AS n_after FROM o LEFT JOIN k USING (id, line_no, r) GROUP BY id, rule"),
    "redacted_rescan": scan_sql(f"SELECT {_case('id')} AS detector_id, count(*) AS n_before, 0::BIGINT AS n_after FROM f GROUP BY rule"),
    "extend": scan_sql(f"SELECT id AS doc_id, line_no, {_case('id')} AS detector_id, s AS start_at, e AS end_at, far AS cover_end FROM c", more=WORDS),
    "hits": _HITS_SQL,
    "fold_confusables": f"WITH {lines_cte()}, {VIEWS} SELECT l.id AS doc_id, l.line_no, coalesce(fs.text, l.line) AS folded, length(coalesce(fs.text, l.line)) AS n FROM l LEFT JOIN fs USING (id, line_no)",
    "variants": f"WITH {lines_cte()}, {VIEWS} SELECT id AS doc_id, line_no, ['original', 'folded', 'despaced'][view + 1] AS kind, text FROM v",
}
