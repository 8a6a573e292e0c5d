"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Base spans are found by fixed patterns per kind (see KINDS); they always stay. High-recall generators
propose overlapping spans: of every run of digit groups all parts of up to ``PARTS`` groups (and the whole
run) that have a phone's, a card's or an address's number of digits, and mail addresses, spelt out or not.
What a proposal is told by is discrete (FEATURES: format, check, what stands before and after it; not whether
it is a whole run, since base spans are), so all proposals of a corpus fall into cells whose number is bounded by the features' ranges
(CELLS, some 134,000).

Learning: a proposal that a base span marks (the plus of a phone, the at sign of a mail address, a card or
an address that stands alone) is a sure example. No feature tells that mark, and one without it is not
taken for a counterexample: what is learnt from are marked and unmarked proposals. Those within a span of
another kind are sure counterexamples; those that merely overlap a span of their own kind are left out.
Trees of depth two are boosted (logistic loss, Newton leaves) on the cells' counts, which hold all documents,
to tell the share of marked ones. In cells that hold nothing but personal data this share is that of people
who write the mark; it is read off the best held-out cells (a fifth of documents, by hash) that have half of
all marked ones. An unmarked proposal is accepted from the lowest score on down to which held-out
proposals, all taken together, have at least ``precision`` of that share, and those of that score half of it.
A kind adds nothing with fewer than ``support`` marked held-out proposals, or if fewer than ``least_share`` of the
best cells are marked, as the unmarked are then rather numbers of another sort.

Everything on the documents is SQL: positions come from the lengths of matches and of the gaps
between them, summed in blocks, and spans are met by halving, so time is linear in a text's matches but for a
logarithm. The trees are compiled into one expression. The texts are read once.

Defined cases: a null text counts as empty and has no spans; positions are code points, end
exclusive; repeated rows are judged alike; null doc_ids are kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

KINDS = ("email", "ip", "card", "phone")

# The lookbehinds with \G and the possessive loops find what the plain patterns find, in linear time.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
NUMBER = r"(?<![0-9])[0-9]++(?:[ ().-]{1,3}[0-9]++)*+"
SPELT = rf"(?i)(?<!{_LOCAL}){_LOCAL}++ ?(?:\(at\)|\[at\]|(?<= )at(?= )) ?[a-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|(?<= )dot(?= )) ?[a-z0-9-]++)++"
_BEFORE = 24  # characters before a proposal that its features see
PARTS = 6

#: Feature and the number of values it can have.
FEATURES = {"kind": 4, "digits": 7, "groups": 6, "signs": 5, "valid": 2, "glued": 2, "before": 4, "word": 5}
CELLS = 2 * math.prod(FEATURES.values())


def _running(x: str) -> str:
    """SQL for the sums of what stands before each element of an array of numbers. Appending copies, so the
    sums are taken in blocks of 64, then over blocks."""
    return f"""get(transform(array(transform(transform(sequence(0, (size({x}) - 1) div 64), b -> slice({x}, b * 64 + 1, 64)),
        k -> aggregate(k, array(0), (a, v) -> concat(a, array(element_at(a, -1) + v))))),
      local -> get(transform(array(aggregate(local, array(0), (a, l) -> concat(a, array(element_at(a, -1) + element_at(l, -1))))),
        base -> flatten(transform(local, (l, i) -> transform(slice(l, 1, size(l) - 1), v -> v + get(base, i))))), 0)), 0)"""


def located(name: str, text: str, pattern: str, gate: Column | None = None) -> tuple[dict[str, Column], Column]:
    """Two steps: columns to make first, then the matches as an array of (start, end, match, left), from
    the columns' names. Matches do not overlap; left is what stands just before them."""
    m, g = f"{name}_matches", f"{name}_gaps"
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    if gate is not None:
        matches, gaps = F.when(gate, matches), F.when(gate, gaps)
    lengths = f"transform({m}, (x, j) -> length(get({g}, j)) + length(x))"
    found = F.expr(
        f"""if(size({m}) > 0, get(transform(array({lengths}), n -> get(transform(array({_running('n')}), before -> transform({m}, (x, j) -> named_struct(
            'start', get(before, j) + length(get({g}, j)), 'end', get(before, j) + get(n, j), 'match', x, 'left', right(get({g}, j), {_BEFORE})))), 0)), 0),
          cast(array() as array<struct<start: int, end: int, match: string, left: string>>))"""
    )
    return {m: matches, g: gaps}, found


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        v = F.ascii(F.substr(digits, F.length(digits) - i + 1, F.lit(1))) - 48
        return acc + F.when(i % 2 == 1, v).when(v > 4, v * 2 - 9).otherwise(v * 2)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(digits))), F.lit(0), step) % 10 == 0


def _small_parts(match: Column) -> Column:
    """Every number between dots is at most 255, leading zeros aside."""
    return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _passes(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    return {
        "email": F.lit(True), "ip": _small_parts(match), "card": n.between(13, 19) & luhn(_digits(match)), "phone": n.between(9, 15),
    }[kind]


def _before(left: str) -> str:
    """0: white space, the text's begin, or a plus (the base pattern's own mark for phones)."""
    return f"case when {left} = '' or {left} rlike '[\\\\s+]$' then 0 when {left} rlike '[\\\\p{{L}}_]$' then 1 when {left} rlike '[(\\\\[<:=,;]$' then 2 else 3 end"


def _word(left: str) -> str:
    words = ("tel|phone|call|fax|mobile|cell", "card|visa|pay|credit|iban|account", "ip|host|server|addr|address", "mail|contact|write")
    return "case " + " ".join(f"when {left} rlike '(?i)\\\\b(?:{w})\\\\b' then {k}" for k, w in enumerate(words, 1)) + " else 0 end"


_PROPOSED = "array<struct<start: int, end: int, kind: int, digits: int, groups: int, signs: int, valid: int, glued: int, before: int, word: int>>"


def _mail(of: str) -> str:
    """SQL for the proposals of an array of mail addresses, spelt out or not; told by what they spell."""
    plain = "lower(regexp_replace(regexp_replace(s.match, '(?i) ?(?:[(\\\\[]dot[)\\\\]]| dot ) ?', '.'), '(?i) ?(?:[(\\\\[]at[)\\\\]]| at ) ?', '@'))"
    return f"""transform({of}, s -> get(transform(array({plain}), m -> named_struct('start', s.start, 'end', s.end, 'kind', 0,
      'digits', least(6, size(split(substring_index(m, '@', -1), '[.]'))), 'groups', least(5, length(substring_index(m, '@', 1)) div 4), 'signs', 0,
      'valid', if(m rlike '[.][a-z]{{2,6}}$', 1, 0), 'glued', 0, 'before', {_before('s.left')}, 'word', {_word('s.left')})), 0))"""


def _numbers(of: str) -> str:
    """SQL for the proposals of an array of runs of digit groups. A part is told by its groups and the
    separators within it, never by cutting the run, so that a run of any length takes linear time."""
    lengths = "transform(g, (x, j) -> length(get(p, j)) + length(x))"
    digits = "get(d, i + n) - get(d, i)"
    joined, inner = "array_join(slice(g, i + 1, n), '')", "array_join(slice(p, i + 2, n - 1), '')"
    signs = f"get(transform(array({inner}), x -> case when x = '' then 0 when x rlike '^[.]+$' then 1 when x rlike '^-+$' then 2 when x rlike '^ +$' then 3 else 4 end), 0)"
    luhn_sum = """aggregate(sequence(1, length(m)), 0, (a, k) -> a + get(transform(array(ascii(substr(m, length(m) - k + 1, 1)) - 48),
      v -> if(k % 2 = 1, v, if(v > 4, v * 2 - 9, v * 2))), 0)) % 10 = 0"""

    def part(kind: int, valid: str, low: int) -> str:
        return f"""named_struct('start', s.start + get(at, i) + length(get(p, i)), 'end', s.start + get(at, i + n - 1) + length(get(p, i + n - 1)) + length(get(g, i + n - 1)), 'kind', {kind},
          'digits', least(6, greatest(0, {digits} - {low})), 'groups', least({PARTS}, n) - 1, 'signs', {signs}, 'valid', if({valid}, 1, 0),
          'glued', if(i + n = size(g) or startswith(get(p, i + n), ' '), 0, 1), 'before', if(i = 0, {_before('s.left')}, if(endswith(get(p, i), ' '), 0, if(endswith(get(p, i), '('), 2, 3))), 'word', {_word('s.left')})"""

    small = "forall(slice(g, i + 1, n), x -> length(x) <= 3 and cast(x as int) <= 255)"
    kinds = f"""concat(
      if(n = 4 and {inner} = '...', array({part(1, small, 4)}), cast(array() as {_PROPOSED})),
      if({digits} between 13 and 19, array({part(2, f"get(transform(array({joined}), m -> {luhn_sum}), 0)", 13)}), cast(array() as {_PROPOSED})),
      if({digits} between 9 and 15, array({part(3, f"{digits} between 10 and 12", 9)}), cast(array() as {_PROPOSED})))"""
    lengths_of = f"concat(sequence(1, least({PARTS}, size(g) - i)), if(i = 0 and size(g) between {PARTS + 1} and 19, array(size(g)), cast(array() as array<int>)))"
    parts = f"flatten(transform(sequence(0, size(g) - 1), i -> flatten(transform({lengths_of}, n -> if({digits} between 4 and 19, {kinds}, cast(array() as {_PROPOSED}))))))"

    def let(name: str, value: str, body: str) -> str:
        return f"get(transform(array({value}), {name} -> {body}), 0)"

    sums = let("at", _running("n"), let("d", f"concat({_running('transform(g, x -> length(x))')}, array(aggregate(g, 0, (a, x) -> a + length(x))))", parts))
    return f"""flatten(transform({of}, s -> if(length(s.match) < 7, cast(array() as {_PROPOSED}),
      {let('g', "regexp_extract_all(s.match, '[0-9]+', 0)", let('p', "split(s.match, '[0-9]+', -1)", let('n', lengths, sums)))})))"""


def _met(spans: str, s: str) -> str:
    """SQL for the first of the sorted, disjoint spans that ends after s starts, found by halving; null if there is none."""
    mid = "cast((a.lo + a.hi) div 2 as int)"
    step = f"if(a.lo >= a.hi, a, if(get({spans}, {mid}).end <= {s}.start, named_struct('lo', {mid} + 1, 'hi', a.hi), named_struct('lo', a.lo, 'hi', {mid})))"
    return f"if(size({spans}) = 0, null, get({spans}, aggregate(sequence(0, cast(log2(size({spans})) as int)), named_struct('lo', 0, 'hi', size({spans})), (a, k) -> {step}, a -> a.lo)))"


def proposals(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of docs, without the text: doc_id, held (not learnt from), base spans, and proposed
    ones with their state: 0 unmarked, 1 marked, 2 overlaps a base span of its kind, 3 one of another kind."""
    found = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    patterns = {
        "email": (EMAIL, F.col("text").contains("@")), "ip": (IP, F.col("text").rlike(r"[0-9]\.[0-9]")), "card": (CARD, F.col("text").rlike(r"[0-9][ -]?[0-9][ -]?[0-9]")),
        "phone": (PHONE, F.col("text").rlike(r"\+[0-9]")), "number": (NUMBER, F.col("text").rlike(r"[0-9]")), "spelt": (SPELT, F.col("text").rlike(r"(?i)\bdot\b")),
    }
    first, second = {}, {}
    for k, (pattern, gate) in patterns.items():
        made, where = located(k, "text", pattern, gate)
        first |= made
        second[k] = where
    split = found.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held"), *(c.alias(n) for n, c in first.items()))
    placed = split.select("doc_id", "held", *(c.alias(k) for k, c in second.items()))

    def kept_of(kind: str) -> Column:
        return F.filter(kind, lambda s: _passes(kind, s["match"])).alias(kind)

    def base_of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    kept = placed.select("doc_id", "held", "number", "spelt", *(kept_of(k) for k in KINDS))
    told = kept.select("doc_id", "held", *KINDS, F.expr(_numbers("number")).alias("parts"), F.expr(f"concat({_mail('email')}, {_mail('spelt')})").alias("mails"))

    def state(kind: int) -> str:
        others = " or ".join(f"coalesce({_met(k, 's')}.start < s.end, false)" for k in KINDS if k != KINDS[kind])
        marked = "b.end = s.end and b.start between s.start - 1 and s.start"
        return f"get(transform(array({_met(KINDS[kind], 's')}), b -> case when coalesce({marked}, false) then 1 when coalesce(b.start < s.end, false) then 2 when {others} then 3 else 0 end), 0)"

    def judged(of: str, kind: int) -> str:
        fields = ", ".join(f"'{f}', s.{f}" for f in ("start", "end", *FEATURES))
        return f"transform(filter({of}, s -> s.kind = {kind}), s -> named_struct({fields}, 'state', {state(kind)}))"

    proposed = "concat(" + ", ".join(judged("mails" if k == 0 else "parts", k) for k in range(len(KINDS))) + ")"
    return told.select("doc_id", "held", F.concat(*(base_of(k) for k in KINDS)).alias("base"), F.expr(proposed).alias("proposed"))


Tree = tuple  # (feature, at most, left, right) or a number


def _grow(rows: np.ndarray, cells: dict[str, np.ndarray], g: np.ndarray, h: np.ndarray, depth: int) -> Tree | float:
    tg, th = g[rows].sum(), h[rows].sum()
    best, choice = 1e-9, None
    for f, size in FEATURES.items() if depth else ():
        lg, lh = (np.cumsum(np.bincount(cells[f][rows], w[rows], size))[:-1] for w in (g, h))
        gain = lg**2 / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - tg**2 / (th + 1)
        gain = np.where((lh > 1e-12) & (th - lh > 1e-12), gain, 0)
        if len(gain) and gain.max() > best:
            best, choice = gain.max(), (f, int(gain.argmax()))
    if not choice:
        return float(0.3 * tg / (th + 1))
    f, cut = choice
    left = cells[f][rows] <= cut
    return f, cut, _grow(rows[left], cells, g, h, depth - 1), _grow(rows[~left], cells, g, h, depth - 1)


def _value(tree: Tree | float, cells: dict[str, np.ndarray]) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(cells["n"]), tree)
    return np.where(cells[tree[0]] <= tree[1], _value(tree[2], cells), _value(tree[3], cells))


def boost(cells: dict[str, np.ndarray], rounds: int = 40, depth: int = 2) -> list[Tree | float]:
    """cells: arrays of features, n proposals and y marked ones among them."""
    trees: list[Tree | float] = []
    score, total = np.zeros(len(cells["n"])), max(1, cells["n"].sum())
    for _ in range(rounds if len(score) else 0):
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        # In units of a thousand proposals: the leaves' regularisation then does not depend on the corpus' size.
        g, h = (cells["y"] - cells["n"] * p) * 1000 / total, cells["n"] * p * (1 - p) * 1000 / total
        trees.append(_grow(np.arange(len(score)), cells, g, h, depth))
        score = score + _value(trees[-1], cells)
    return trees


def thresholds(cells: dict[str, np.ndarray], trees: list, precision: float, support: int, least_share: float) -> dict[int, float]:
    """kind -> lowest score from which unmarked proposals are accepted; cells: of documents not learnt from."""
    out = {}
    scores = sum((_value(t, cells) for t in trees), np.zeros(len(cells["n"])))
    for kind in range(len(KINDS)):
        own = cells["kind"] == kind
        levels = np.unique(scores[own])[::-1]
        n, y = (np.array([c[own][scores[own] == v].sum() for v in levels], float) for c in (cells["n"], cells["y"]))
        if y.sum() < support:
            continue
        n_up, y_up = np.cumsum(n), np.cumsum(y)
        half = int(np.searchsorted(y_up, y.sum() / 2))
        share = y_up[half] / n_up[half]
        good = np.flatnonzero((y_up >= precision * share * n_up - 1e-9) & (y >= share / 2 * n))
        if share >= least_share and len(good):
            # Scores that no held-out proposal has are judged by the trees' own share, down to halfway to the next level.
            last, floor = levels[good[-1]], math.log(share / (2 - share))
            out[kind] = float(min(last, max(floor, (last + levels[good[-1] + 1]) / 2 if good[-1] + 1 < len(levels) else floor)))
    return out


def _sql(tree: Tree | float, s: str) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    return f"if({s}.{tree[0]} <= {tree[1]}, {_sql(tree[2], s)}, {_sql(tree[3], s)})"


def find(docs: DataFrame, text: str = "text", precision: float = 0.98, support: int = 20, least_share: float = 0.2) -> DataFrame:
    """One row per row of docs: doc_id, base and added spans (kind, start, end), both sorted."""
    seen = materialise(proposals(docs, text), "proposals")
    each = seen.select("held", F.explode("proposed").alias("s")).filter("s.state <> 2").select("held", *(F.col(f"s.{f}").alias(f) for f in FEATURES), (F.col("s.state") == 1).cast("int").alias("y"))
    rows = each.groupBy("held", *FEATURES).agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()  # at most CELLS rows
    columns = {c: np.array([r[c] for r in rows], np.int64) for c in ("held", "n", "y", *FEATURES)}
    learnt, held = ({c: v[columns["held"] == h] for c, v in columns.items()} for h in (0, 1))
    trees = boost(learnt)
    limits = thresholds(held, trees, precision, support, least_share)
    score = " + ".join(_sql(t, "s") for t in trees) or "0D"
    accepted = " or ".join(f"(s.kind = {k} and {score} >= {v - 1e-9!r}D)" for k, v in limits.items()) or "false"
    chosen = seen.select("doc_id", "base", F.expr(f"array_sort(transform(filter(proposed, s -> s.state = 0 and ({accepted})), s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end)))").alias("c"))
    # Of accepted spans of a kind, those within another go; spans sorted by start hold few others, all close by.
    near = f"slice(c, greatest(1, i + 1 - {2 * PARTS}), {4 * PARTS})"
    inside = f"exists({near}, q -> q.kind = s.kind and q.start <= s.start and q.end >= s.end and (q.start < s.start or q.end > s.end))"
    return chosen.select("doc_id", F.array_sort("base").alias("base"), F.expr(f"array_distinct(filter(c, (s, i) -> not {inside}))").alias("added"))


def redact(text: str = "text", base: str = "base", added: str = "added") -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans count as one."""
    spans = f"array_sort(transform(concat({base}, {added}), s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))"
    names = "array('EMAIL', 'IP', 'CARD', 'PHONE')"
    return F.expr(
        f"""aggregate({spans}, named_struct('at', 0, 'out', ''),
          (a, s) -> if(s.end <= a.at, a, named_struct('at', s.end, 'out', concat(a.out, substring({text}, a.at + 1, greatest(0, s.start - a.at)), if(s.start < a.at, '', concat('[', get({names}, s.kind), ']'))))),
          a -> concat(a.out, substring({text}, a.at + 1)))"""
    )


def _told(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir):
    from .common import table

    found = find(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(_told(F.col("base")).cast("binary"), 256).alias("base_sha256"), _told(F.array_sort(F.concat("base", "added"))).alias("spans")
    )
