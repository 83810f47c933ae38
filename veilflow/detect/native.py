"""The line scanner inside Catalyst: no Python worker takes part in it.

A line has up to three views: as read, with confusable characters folded, and without spaces beside joiners.  For every rule that a view
can hold at all, each match is marked in the text by one replacement; the marked text is cut at the marks, and a fold over the lengths of
the pieces gives every match its place.  Places of the third view are carried back over the spaces that were cut before them.  Matches of
all views are deduplicated and cleared of overlaps as arrays of one row, so a scan shuffles nothing.

Built-in rules only: rules of one's own have tests and masks in Python and go through ``veilflow.detect.scan``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilflow.detect.rules import RULES, SEVERITIES, DetectorDef
from veilflow.functions.dialect import SPARK, Dialect

#: Marks around a value, and what stands for them where a text holds them itself; no rule tells the three apart.
OPEN, SHUT, OTHER = "\x01", "\x02", "\x03"
#: Runs of spaces that go: behind or before a joiner, with something on either side; of a run that begins the line the first space stays.
SPACES = r"(?<=[:/.@=_\-]) +(?=[^ ])|(?<=[^ ]) +(?=[:/.@=_\-])|(?<=^ ) +(?=[:/.@=_\-])"
_TOKEN = r"[A-Za-z0-9_\-.]"
HIT = "array<struct<rule:int,view:int,s:int,e:int,value:string>>"


def opening(pattern: str, group: int) -> int:
    """Where the parenthesis of a capturing group stands."""
    i, seen, inside = 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "(" and pattern[i + 1] != "?":
            seen += 1
            if seen == group:
                return i
        i += 1
    raise ValueError(f"no group {group} in {pattern}")


def marking(d: Dialect, text: str, pattern: str, group: int, ignore_case: bool) -> str:
    """``text`` with marks around the value of every match; the value is the last thing that a pattern takes."""
    at = opening(pattern, group)
    p = ("(?i)" if ignore_case else "") + f"({pattern[:at]}){pattern[at:]}"
    clean = f"translate({text}, '{OPEN}{SHUT}', '{OTHER}{OTHER}')"
    if d.spark:
        return f"regexp_replace({clean}, {d.pattern(p)}, '$1{OPEN}${group + 1}{SHUT}')"
    return f"regexp_replace({clean}, {d.pattern(p)}, '\\1{OPEN}\\{group + 1}{SHUT}', 'g')"


def marked_spans(marked: str) -> str:
    """Places (s, e) of what stands between the marks of a marked text, counted without the marks."""
    parts = f"split({marked}, '{OPEN}', -1)"
    step = f"(sum_, part_) -> named_struct('at', sum_.at + length(part_) - 1, 'out', concat(sum_.out, array(named_struct('s', sum_.at, 'e', sum_.at + instr(part_, '{SHUT}') - 1))))"
    return (
        f"transform(array({parts}), cut_ -> aggregate(slice(cut_, 2, size(cut_)), named_struct('at', length(cut_[0]), 'out', cast(array() AS array<struct<s:int,e:int>>)), {step}, sum_ -> sum_.out))[0]"
    )


def folded(line: str) -> str:
    """Inside runs of eight token characters or more with a digit, ``_`` or ``-``: O before three letters or digits reads 0, l reads 1."""
    fold = r"regexp_replace(regexp_replace(run_, '[Oo](?=[A-Za-z0-9]{3})', '0'), 'l(?=[A-Za-z0-9]{3})', '1')"
    pieces = f"split({line}, r'(?<!{_TOKEN})(?={_TOKEN})|(?<={_TOKEN})(?!{_TOKEN})')"
    run = rf"run_ RLIKE r'^{_TOKEN}{{8,}}\z' AND run_ RLIKE r'[_\-0-9]' AND run_ RLIKE '[Ool]'"
    return f"(CASE WHEN {line} RLIKE '[Ool][A-Za-z0-9]{{3}}' AND {line} RLIKE r'[_\\-0-9]' THEN array_join(transform({pieces}, run_ -> CASE WHEN {run} THEN {fold} ELSE run_ END), '') ELSE {line} END)"


def despaced(line: str) -> str:
    return f"regexp_replace({line}, r'{SPACES}', '')"


def cuts(line: str) -> str:
    """Runs that ``despaced`` takes out: their place in what is left, and their length."""
    spans = marked_spans(f"regexp_replace(translate({line}, '{OPEN}{SHUT}', '{OTHER}{OTHER}'), r'{SPACES}', '{OPEN}$0{SHUT}')")
    before = "aggregate(slice(spans_, 1, i_), 0, (sum_, x_) -> sum_ + x_.e - x_.s)"
    return f"transform(array({spans}), spans_ -> transform(spans_, (c_, i_) -> named_struct('at', c_.s - {before}, 'n', c_.e - c_.s)))[0]"


def views(line: str, fold: str = "folded_", plain: str = "despaced_") -> str:
    """The views of a line, given its folded and despaced form: number, text, text in lower case, and cuts."""
    none = "cast(array() AS array<struct<at:int,n:int>>)"
    view = lambda n, text, cut: f"named_struct('n', {n}, 'text', {text}, 'low', lower({text}), 'cuts', {cut})"
    more = lambda text, n, cut: f"CASE WHEN {text} <> {line} THEN array({view(n, text, cut)}) ELSE array() END"
    return f"concat(array({view(0, line, none)}), {more(fold, 1, none)}, {more(plain, 2, cuts(line))})"


def _may(rule: DetectorDef) -> str:
    return SPARK.may("view_.text", "view_.low", rule).replace("lower(view_.text)", "view_.low")


def _found(number: int, rule: DetectorDef) -> str:
    """Matches of a rule in ``view_`` that pass its test, in places of the view."""
    spans = marked_spans(marking(SPARK, "view_.text", rule.pattern, rule.group, rule.ignore_case))
    hit = f"named_struct('rule', {number}, 'view', view_.n, 's', x_.s, 'e', x_.e, 'value', substring(view_.text, x_.s + 1, x_.e - x_.s))"
    return f"CASE WHEN {_may(rule)} THEN filter(transform(filter({spans}, x_ -> x_.e > x_.s), x_ -> {hit}), hit_ -> {SPARK.validate(rule.id, 'hit_.value', 'view_.text')}) ELSE cast(array() AS {HIT}) END"


def _in_line(hits: str) -> str:
    """Hits of ``view_`` in places of the original line."""
    place = lambda at: f"({at} + aggregate(view_.cuts, 0, (sum_, c_) -> sum_ + CASE WHEN c_.at <= {at} THEN c_.n ELSE 0 END))"
    moved = f"named_struct('rule', x_.rule, 'view', x_.view, 's', {place('x_.s')}, 'e', {place('(x_.e - 1)')} + 1, 'value', x_.value)"
    return f"CASE WHEN size(view_.cuts) = 0 THEN {hits} ELSE transform({hits}, x_ -> {moved}) END"


#: Prefilters that are classes of characters, widened by what folding and taking spaces out can bring about.
_WIDE = {
    "[0-9]{4}": "[0-9Ool]{4}", "[+][0-9]": "[+][0-9Ool]", "[0-9]-[0-9]": "[0-9Ool] *- *[0-9Ool]", "[0-9][.][0-9]": "[0-9Ool] *[.] *[0-9Ool]", "[A-Z]{2}[0-9]{2}": "[A-Z]{2}[0-9Ool]{2}",
    "[sSaA][kKcC][0-9a-fA-F]{8}": "[sSaA][kKcC][0-9a-fA-FOol]{8}",
}


def worth_scanning(line: str, rules: list[DetectorDef]) -> str:
    """False only where no view of the line can hold anything: needed words are looked for without spaces and in characters that folding makes equal."""
    like = lambda w: w.lower().translate(str.maketrans("ol", "01", " "))
    words = list(dict.fromkeys(like(w) for r in rules if r.needs and not r.needs.startswith("[") for w in r.needs.split("|")))
    words = [w for w in words if not any(v != w and v in w for v in words)]
    classes = list(dict.fromkeys(_WIDE[r.needs] for r in rules if r.needs.startswith("[")))
    if any(not r.needs for r in rules):
        return "true"
    tests = [f"contains(plain_, '{w}')" for w in words] + ([f"{line} RLIKE r'{'|'.join(classes)}'"] if classes else [])
    return f"exists(array(translate(lower({line}), 'ol ', '01')), plain_ -> {' OR '.join(tests)})"


def by_rule(rules: list[DetectorDef], what: str, numbers: str) -> str:
    """A field of the rule that the column ``numbers`` names."""
    texts = ", ".join(f"'{getattr(r, what)}'" for r in rules)
    return f"element_at(array({texts}), {numbers} + 1)"


def deduplicated(hits: str) -> str:
    """Without hits of a rule that begin where an earlier one of its does, unless they are longer than all of these."""
    earlier = f"exists(slice({hits}, 1, i_), x_ -> x_.rule = hit_.rule AND x_.s = hit_.s AND length(x_.value) >= length(hit_.value))"
    return f"filter({hits}, (hit_, i_) -> NOT {earlier})"


def resolved(hits: str, rank: str) -> str:
    """Hits that overlap no better one, by ``rank`` of ``hit_``, length, place and order, from left to right."""
    ranked = f"transform({hits}, (hit_, i_) -> named_struct('rank', {rank}, 'short', hit_.s - hit_.e, 's', hit_.s, 'i', i_, 'e', hit_.e, 'rule', hit_.rule, 'value', hit_.value, 'view', hit_.view))"
    best = f"array_sort({ranked})"
    kept = f"aggregate(slice(best_, 2, size(best_)), slice(best_, 1, 1), (kept_, hit_) -> CASE WHEN exists(kept_, x_ -> hit_.s < x_.e AND x_.s < hit_.e) THEN kept_ ELSE concat(kept_, array(hit_)) END)"
    fields = "named_struct('s', x_.s, 'e', x_.e, 'rule', x_.rule, 'view', x_.view, 'value', x_.value)"
    return f"array_sort(transform(transform(array({best}), best_ -> {kept})[0], x_ -> {fields}))"


@functools.lru_cache(maxsize=64)
def _expressions(categories: tuple[str, ...] | None) -> tuple[str, str, list[DetectorDef]]:
    if categories is not None and not categories:
        raise ValueError("select at least one category")
    rules = [r for r in RULES if categories is None or r.category in categories]
    each = f"transform(array(concat({', '.join(_found(i, r) for i, r in enumerate(rules))})), found_ -> {_in_line('found_')})[0]"
    # In the order of the catalogue, then of the views, then of the line.
    return worth_scanning("{line}", rules), f"array_sort(flatten(transform(views_, view_ -> {each})))", rules


def rank_of(rules: list[DetectorDef]) -> str:
    """The rank of ``hit_`` by the severity of its rule."""
    return f"element_at(array({', '.join(str(SEVERITIES.index(r.severity)) for r in rules)}), hit_.rule + 1)"


def scanned(lines: DataFrame, categories: list[str] | None = None, line_col: str = "line", resolve: bool = True, every: bool = False) -> tuple[DataFrame, list[DetectorDef]]:
    """``lines`` that may hold a finding (``every``: all), with ``hits_``, an array of rule (a number in the list that is returned too), view, s, e and value."""
    worth, found, rules = _expressions(None if categories is None else tuple(categories))
    worth = worth.replace("{line}", line_col)
    if every:
        rows, found = lines, f"CASE WHEN trim({line_col}) <> '' AND {worth} THEN {found} ELSE cast(array() AS {HIT}) END"
    else:
        rows = lines.where(F.expr(f"trim({line_col}) <> ''")).where(F.expr(worth))
    rows = rows.withColumns({"folded_": F.expr(folded(line_col)), "despaced_": F.expr(despaced(line_col))}).withColumn("views_", F.expr(views(line_col)))
    # No filter looks at hits: it would be pushed below and find them twice.
    rows = rows.withColumn("hits_", F.expr(found)).withColumn("hits_", F.expr(deduplicated("hits_")))
    if resolve:
        rows = rows.withColumn("hits_", F.expr(resolved("hits_", rank_of(rules))))
    return rows.drop("folded_", "despaced_", "views_"), rules


def described(rules: list[DetectorDef], hit: str) -> dict[str, str]:
    """Columns of a finding from a struct ``hit``."""
    masks = " ".join(f"WHEN {i} THEN {SPARK.mask_value(r.id, f'{hit}.value')}" for i, r in enumerate(rules))
    return {
        "detector_id": by_rule(rules, "id", f"{hit}.rule"), "label": by_rule(rules, "label", f"{hit}.rule"), "category": by_rule(rules, "category", f"{hit}.rule"), "severity": by_rule(rules, "severity", f"{hit}.rule"),
        "value": f"{hit}.value", "masked": f"CASE {hit}.rule {masks} END", "start": f"{hit}.s", "end": f"{hit}.e",
    }


def find(lines: DataFrame, categories: list[str] | None = None, line_col: str = "line", resolve: bool = True) -> DataFrame:
    """One row per finding: all columns of ``lines`` but the text, then detector_id, label, category, severity, value, masked, start, end."""
    rows, rules = scanned(lines, categories, line_col, resolve)
    keep = [c for c in lines.columns if c != line_col]
    each = rows.select(*keep, F.explode_outer("hits_").alias("hit_")).where("hit_ is not null")
    return each.select(*keep, *(F.expr(e).alias(name) for name, e in described(rules, "hit_").items()))


# ------------------------------------------------------------------ what a finding covers

def extended(words: str, start: str, end: str, least: int = 12) -> str:
    """The end of what must be covered: a span of ``least`` characters goes on over token-like words that follow one space apart.

    ``words``: array of structs with ``text`` and ``start``, in order.
    """
    from veilflow.operators.geometry import tokenish

    word_end = "word_.start + length(word_.text)"
    step = (
        f"(far_, word_) -> CASE WHEN far_.over OR word_.start < far_.at THEN far_ WHEN word_.start > far_.at + 1 OR NOT {tokenish(SPARK, 'word_.text')} THEN named_struct('at', far_.at, 'over', true)"
        f" ELSE named_struct('at', {word_end}, 'over', false) END"
    )
    return f"(CASE WHEN {end} - {start} < {least} THEN {end} ELSE aggregate({words}, named_struct('at', {end}, 'over', false), {step}, far_ -> far_.at) END)"


def words_of(line: str) -> str:
    """Words of a line, cut at spaces, with their places."""
    step = "(sum_, w_) -> named_struct('at', sum_.at + length(w_) + 1, 'out', CASE WHEN w_ = '' THEN sum_.out ELSE concat(sum_.out, array(named_struct('text', w_, 'start', sum_.at))) END)"
    return f"aggregate(split({line}, ' '), named_struct('at', 0, 'out', cast(array() AS array<struct<text:string,start:int>>)), {step}, sum_ -> sum_.out)"


def _filled(line_col: str, fill: str) -> str:
    """The line of ``hits_`` and ``words_`` with every word that a hit touches, and the fragments that go on behind it, replaced by ``fill``."""
    spans = f"transform(hits_, hit_ -> named_struct('s', hit_.s, 'e', {extended('words_', 'hit_.s', 'hit_.e')}))"
    touched = "exists(spans_, x_ -> x_.s < word_.start + length(word_.text) AND word_.start < x_.e)"
    # Words and the gaps before them, in turn: a gap stays, a word that is touched is filled.
    before = "CASE WHEN i_ = 0 THEN 0 ELSE words_[i_ - 1].start + length(words_[i_ - 1].text) END"
    text = f"transform(array({spans}), spans_ -> array_join(transform(words_, (word_, i_) -> concat(repeat(' ', word_.start - {before}), CASE WHEN {touched} THEN repeat('{fill}', length(word_.text)) ELSE word_.text END)), ''))[0]"
    tail = f"repeat(' ', length({line_col}) - element_at(words_, -1).start - length(element_at(words_, -1).text))"
    return f"concat({text}, {tail})"


def cover(lines: DataFrame, categories: list[str] | None = None, line_col: str = "line", fill: str = ";") -> DataFrame:
    """``lines`` that may hold a finding with every word that one touches, and the fragments that go on behind it, replaced by ``fill``."""
    rows, _ = scanned(lines, categories, line_col)
    covered = F.expr(f"CASE WHEN size(hits_) = 0 THEN {line_col} ELSE {_filled(line_col, fill)} END")
    rows = rows.withColumn("words_", F.expr(words_of(line_col)))
    # Made by a generator, so that filters on the new line are not pushed below and make it again.
    return rows.select(*[c for c in lines.columns if c != line_col], F.explode(F.array(covered)).alias(line_col)).select(*lines.columns)


def covered(lines: DataFrame, categories: list[str] | None = None, line_col: str = "line", fill: str = ";") -> DataFrame:
    """``lines`` that hold a finding, as ``cover`` leaves them, with ``rules_``, the numbers of the rules of their findings."""
    rows, _ = scanned(lines, categories, line_col)
    # An outer generator: neither it nor the filter on what it makes is turned into a filter below, which would find hits twice.
    rows = rows.select(*lines.columns, F.explode_outer(F.expr("CASE WHEN size(hits_) > 0 THEN array(hits_) END")).alias("hits_")).where("hits_ is not null")
    rows = rows.withColumn("words_", F.expr(words_of(line_col)))
    filled = F.explode(F.array(F.expr(_filled(line_col, fill)))).alias(line_col)
    return rows.select(*[c for c in lines.columns if c != line_col], filled, F.expr("hits_.rule").alias("rules_")).select(*lines.columns, "rules_")
