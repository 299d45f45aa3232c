"""Operator 13: secrets in texts by patterns and a battery of randomness tests, in DataFrame expressions alone.

Patterns give the base spans. The method adds unbroken tokens that look random. A token's encoding is the smallest alphabet that explains it,
and as symbols of that alphabet it is tested three times: chi-squared of its counts against uniform ones, runs above and below the alphabet's middle, and serial
correlation of neighbours. A token that one of them rejects isn't random. What is left must also be unlike ordinary text of its length: the chances that text
has counts so even (from how often two letters of text agree) and turns so often from one class of characters to another are combined by Fisher's
rule. They fall with the length, so short tokens prove little. The chances of all tokens of the table go through one false-discovery control
(Benjamini and Hochberg), on a histogram whose size is fixed.

One pass over the texts stores spans and tests; the histogram and the verdicts read only what it stored. Nothing is shuffled but the histogram.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import common

# The kinds of spans in the order in which they are listed, with their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
#: Characters of an assigned value at least.
VALUE = 8
TOKEN = "[A-Za-z0-9+/_-]{20,}={0,2}"
#: Encodings by their first fit: pattern, alphabet, and for text: the chances that two and that three symbols are the same, and that the next one is of another class.
HEX_DIGITS, LOWER, UPPER, DIGITS = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
WORDS, NAMES = (0.066, 0.0055, 0.15), (0.055, 0.0042, 0.45)
ENCODINGS = {
    "base16": ("^([0-9a-f]+|[0-9A-F]+)$", HEX_DIGITS, (0.11, 0.0145, 0.15)),
    "base32": ("^[A-Z2-7]+$", UPPER + "234567", WORDS),
    "base36": ("^([0-9a-z]+|[0-9A-Z]+)$", DIGITS + LOWER, WORDS),
    "base62": ("^[0-9A-Za-z]+$", UPPER + LOWER + DIGITS, NAMES),
    "base64": ("^([0-9A-Za-z+/]+|[0-9A-Za-z_-]+)$", UPPER + LOWER + DIGITS + "+/", NAMES),
}
#: A battery under this chance rejects a random token; the share of false discoveries; bins of the histogram: STEP a power of ten, BINS in all.
REJECT, FALSE, STEP, BINS = 0.001, 0.01, 8, 2400


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is then evaluated once a row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running(lengths: str) -> str:
    """The running sums of an array of ints. Blocks of 256 keep the growing arrays short: work is linear but for a share of 1 / 65,536."""
    prefix = lambda a, start: f"slice(aggregate({a}, array({start}), (s, v) -> concat(s, array(element_at(s, -1) + v))), 2, size({a}))"
    blocks = f"transform(sequence(0, (size({lengths}) - 1) div 256), b -> slice({lengths}, b * 256 + 1, 256))"
    totals = "transform(bs, x -> aggregate(x, 0, (s, v) -> s + v))"
    whole = let("os", f"concat(array(0), {prefix('ts', '0')})", f"flatten(zip_with(bs, slice(os, 1, size(bs)), (x, o) -> {prefix('x', 'o')}))")
    return let("bs", blocks, let("ts", totals, whole))


def quoted(pattern: str) -> str:
    """A pattern as a SQL literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str, fits: str = "true") -> str:
    """(start, s) of the matches of ``pattern`` in ``text``, leftmost first and not overlapping, that ``fits`` (over ``m``, the match) keeps. Places are code points."""
    steps = "transform(ps, (x, i) -> char_length(x) + if(i = 0, 0, char_length(get(ms, i - 1))))"
    spans = let("at", running("ls"), f"filter(transform(ms, (x, i) -> struct(get(at, i) as start, x as s)), y -> {let('m', 'y.s', fits)})")
    found = let("ps", f"split({text}, {quoted(pattern)}, -1)", let("ls", steps, spans))
    return let("ms", f"regexp_extract_all({text}, {quoted(pattern)}, 0)", f"if(size(ms) = 0, cast(array() as array<struct<start: int, s: string>>), {found})")


def upper_tail(z: str) -> str:
    """The chance of a normal deviate over ``z`` >= 0 (Abramowitz and Stegun 26.2.17)."""
    t = f"(1 / (1 + 0.2316419 * {z}))"
    poly = f"{t} * (0.319381530D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D))))"
    return f"greatest(1e-300D, 0.3989422804014327D * exp(-{z} * {z} / 2) * {poly})"


def encoding(s: str) -> str:
    """The name of the smallest alphabet that explains a token of two classes (lower case, upper case, digits) or more; null: none."""
    classes = " + ".join(f"cast({s} rlike '[{c}]' as int)" for c in ("a-z", "A-Z", "0-9"))
    return f"if({classes} < 2, null, CASE " + " ".join(f"WHEN {s} rlike '{pattern}' THEN '{name}'" for name, (pattern, _, _) in ENCODINGS.items()) + " END)"


def by_encoding(column: str) -> str:
    """A value of the encoding named ``e``: its alphabet, size or chances."""
    value = {"alphabet": lambda a, _: f"'{a}'", "size": lambda a, _: f"{len(a)}", "two": lambda _, k: f"{k[0]}D", "three": lambda _, k: f"{k[1]}D", "turn": lambda _, k: f"{k[2]}D"}[column]
    return "CASE e " + " ".join(f"WHEN '{name}' THEN {value(a, k)}" for name, (_, a, k) in ENCODINGS.items()) + " END"


def tested(start: str, token: str) -> str:
    """The tests of a token that has the encoding ``e``: where it lies, symbols, the three deviates, and the chances as random and as text."""
    plain = f"translate(rtrim('=', {token}), '-_', '+/')"
    codes = f"transform(split(if(e IN ('base16', 'base36'), lower({plain}), {plain}), ''), x -> instr(a, x) - 1)"
    squares = "aggregate(array_sort(c), named_struct('last', -1, 'run', 0L, 'sum', 0L), (g, x) -> if(x = g.last, named_struct('last', x, 'run', g.run + 1, 'sum', g.sum + 2 * g.run + 1), named_struct('last', x, 'run', 1L, 'sum', g.sum + 1))).sum"
    pairs = "zip_with(slice(c, 1, n - 1), slice(c, 2, n - 1), (x, y) -> struct(x, y))"
    changes = f"size(filter({pairs}, p -> (2 * p.x < k) <> (2 * p.y < k)))"
    serial = f"aggregate({pairs}, 0D, (g, p) -> g + (p.x - (k - 1) / 2D) * (p.y - (k - 1) / 2D))"
    chi = "(k * sq / double(n) - n - (k - 1)) / sqrt(2D * (k - 1) * (n - 1) / n)"
    runs = f"({changes} - (n - 1) / 2D) / sqrt((n - 1) / 4D)"
    along = f"{serial} / ((k * k - 1) / 12D * sqrt(n - 1D))"
    random = let("z", "greatest(abs(chi), abs(runs), abs(serial))", f"least(1D, 6 * {upper_tail('z')})")
    expected = "(n + double(n) * (n - 1) * k2)"
    spread = "sqrt(2D * n * (n - 1) * (k2 - k2 * k2) + 4D * n * (n - 1) * (n - 2) * (k3 - k2 * k2))"
    tail = f"if(z >= 0, {upper_tail('z')}, 1 - {upper_tail('(-z)')})"
    classes = f"split(translate({plain}, '{LOWER + UPPER + DIGITS}', '{26 * 'a' + 26 * 'A' + 10 * '0'}'), '')"
    turns = let("h", classes, "size(filter(zip_with(slice(h, 1, n - 1), slice(h, 2, n - 1), (x, y) -> x <> y), x -> x))")
    even, turned = let("z", f"({expected} - sq) / {spread}", tail), let("z", f"({turns} - 0.5D - (n - 1) * r) / sqrt((n - 1) * r * (1 - r))", tail)
    text = let("q", f"greatest(1e-300D, {even} * {turned})", "q * (1 - ln(q))")
    whole = f"named_struct('start', {start}, 'end', {start} + char_length({token}), 'encoding', e, 'symbols', n, 'chi', chi, 'runs', runs, 'serial', serial, 'p_random', {random}, 'p_text', {text})"
    for name, value in (("serial", along), ("runs", runs), ("chi", chi), ("sq", squares), ("r", by_encoding("turn")), ("k3", by_encoding("three")), ("k2", by_encoding("two")), ("n", "size(c)"), ("c", codes), ("k", by_encoding("size")), ("a", by_encoding("alphabet"))):
        whole = let(name, value, whole)
    return whole


def scan(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, or the columns ``keep``, with ``base`` (start, kind, end) in order and ``tokens``, the tested ones. Null texts are empty; rows stay apart."""
    kind = lambda k, found: f"transform({found}, x -> struct(x.start as start, {k} as kind, x.start + char_length(x.s) as end))"
    assign = kind(0, matches("t", ASSIGN, f"char_length(regexp_extract(m, {quoted(ASSIGN)}, 2)) >= {VALUE}"))
    access = f"if(contains(t, 'AKIA'), {kind(1, matches('t', ACCESS))}, cast(array() as array<struct<start: int, kind: int, end: int>>))"
    inside = f"if(size(tokens) = 0, cast(array() as array<struct<start: int, kind: int, end: int>>), {kind(2, matches('t', HEX))})"  # a run of hex digits lies within a token
    named = f"filter(transform(tokens, x -> struct(x.start as start, x.s as s, {encoding('''rtrim('=', x.s)''')} as e)), x -> x.e IS NOT NULL)"
    tests = f"transform({named}, y -> {let('e', 'y.e', tested('y.start', 'y.s'))})"
    whole = let("tokens", matches("t", TOKEN), f"named_struct('base', array_sort(concat({assign}, {access}, {inside})), 'tokens', {tests})")
    own = [f"`{c}`" for c in keep] or ["cast(doc_id as long) doc_id"]
    found = docs.selectExpr(*own, f"{let('t', '''coalesce(text, '')''', whole)} found")
    return found.selectExpr(*(own if keep else ["doc_id"]), "found.base base", "found.tokens tokens")


#: The bin of a token's chance as text; a token that isn't random has the lowest.
BIN = f"if(p_random < {REJECT}, 0, cast(least({BINS}, floor(-log10(p_text) * {STEP})) as int))"


def threshold(scanned: DataFrame, share: float = FALSE) -> int:
    """The lowest bin whose tokens, with all above, hold at most ``share`` false discoveries (Benjamini and Hochberg; a bin counts with its largest chance)."""
    tokens = scanned.select(F.explode("tokens").alias("x")).select("x.*")
    counts = {r.b: r.n for r in tokens.groupBy(F.expr(BIN).alias("b")).agg(F.count("*").alias("n")).collect()}  # BINS rows at most
    total, above, least = sum(counts.values()), 0, BINS + 1
    for b in sorted(counts, reverse=True):
        above += counts[b]
        if b and total * 10 ** (-b / STEP) <= share * above:
            least = b
    return least


def verdicts(scanned: DataFrame, least: int, *keep: str) -> DataFrame:
    """doc_id, or ``keep``, then the counts, base_sha256, spans and n_random of scanned rows."""
    joined = lambda spans: f"array_join(transform({spans}, x -> concat(CASE x.kind {' '.join(f'WHEN {i} THEN {k!r}' for i, k in enumerate(KINDS))} END, ':', x.start, ':', x.end)), ',')"
    bins = BIN.replace("p_", "y.p_")
    random = f"transform(filter(tokens, y -> {bins} >= {least}), x -> struct(x.start as start, 3 as kind, x.end as end))"
    count = lambda k: f"cast(size(filter(base, x -> x.kind = {k})) as long)"
    own = [f"`{c}`" for c in keep] or ["doc_id"]
    added = scanned.selectExpr(*own, "base", f"{random} random")
    return added.selectExpr(*own, f"{count(0)} n_assign", f"{count(1)} n_access", f"{count(2)} n_hex", f"sha2({joined('base')}, 256) base_sha256", f"{joined('array_sort(concat(base, random))')} spans", "cast(size(random) as long) n_random")


def find(docs: DataFrame, share: float = FALSE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random: a row for each row of ``docs``.

    Null and empty texts have no spans; repeated rows and null ids stay rows of their own; an empty table gives none. Spans that are equal in place and kind can't
    occur; a token may also lie in a base span, and both are named. Only ``doc_id`` and ``text`` are read, so other columns play no part.
    """
    scanned = common.written(scan(docs), "secrets")
    return verdicts(scanned, threshold(scanned, share))


def _duck_oracle() -> str:
    """The same in DuckDB's SQL: matches and tokens are rows, their places sums over the pieces before them."""

    def found(kind: int, pattern: str, fits: str) -> str:
        own = pattern.replace("'", "''")
        lengths = lambda a: f"coalesce(list_sum(list_transform({a}, lambda x: length(x))), 0)"
        at = f"({lengths('ps[1:i]')} + {lengths('ms[1:i - 1]')})::INT"
        split = f"SELECT k, regexp_extract_all(t, '{own}', 0) AS ms, regexp_extract_all(t, '{own}', {2 if kind == 0 else 0}) AS vs, regexp_split_to_array(t, '{own}') AS ps FROM d"
        return f"SELECT k, {kind} AS kind, {at} AS a, {at} + length(ms[i]) AS b, ms[i] AS s FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM ({split})) WHERE {fits}"

    def tail(z: str) -> str:
        t = f"(1 / (1 + 0.2316419 * {z}))"
        return f"greatest(1e-300, 0.3989422804014327 * exp(-{z} * {z} / 2) * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"

    either = lambda z: f"CASE WHEN {z} >= 0 THEN {tail(z)} ELSE 1 - {tail(f'(-{z})')} END"
    cases = lambda value: "CASE e " + " ".join(f"WHEN '{n}' THEN {value(a, c)}" for n, (_, a, c) in ENCODINGS.items()) + " END"
    classes = " + ".join(f"regexp_matches(x, '[{c}]')::INT" for c in ("a-z", "A-Z", "0-9"))
    encoded = f"CASE WHEN {classes} < 2 THEN NULL " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{n}'" for n, (p, _, _) in ENCODINGS.items()) + " END"
    pairs = lambda a, test: f"len(list_filter(range(1, n), lambda i: {test.format(f'{a}[i]', f'{a}[i + 1]')}))"
    spans = lambda where: f"SELECT k, string_agg(CASE kind {' '.join(f'WHEN {i} THEN {n!r}' for i, n in enumerate(KINDS))} END || ':' || a || ':' || b, ',' ORDER BY a, kind) AS s FROM {where} GROUP BY k"
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({found(0, ASSIGN, f'length(vs[i]) >= {VALUE}')} UNION ALL {found(1, ACCESS, 'true')} UNION ALL {found(2, HEX, 'true')}),
tok AS (SELECT k, a, b, x, {encoded} AS e FROM (SELECT *, rtrim(s, '=') AS x FROM ({found(3, TOKEN, 'true')}))),
sym AS (SELECT *, {cases(lambda a, _: f"'{a}'")} AS alphabet, {cases(lambda a, _: len(a))} AS m, {cases(lambda _, c: c[0])}::DOUBLE AS k2, {cases(lambda _, c: c[1])}::DOUBLE AS k3, {cases(lambda _, c: c[2])}::DOUBLE AS r,
  length(x) AS n, string_split(CASE WHEN e IN ('base16', 'base36') THEN lower(translate(x, '-_', '+/')) ELSE translate(x, '-_', '+/') END, '') AS cs,
  string_split(translate(translate(x, '-_', '+/'), '{LOWER + UPPER + DIGITS}', '{26 * 'a' + 26 * 'A' + 10 * '0'}'), '') AS h FROM tok WHERE e IS NOT NULL),
cod AS (SELECT *, list_transform(cs, lambda y: (instr(alphabet, y) - 1)::DOUBLE) AS c FROM sym),
cnt AS (SELECT *, list_sum(list_transform(list_distinct(c), lambda v: power(len(list_filter(c, lambda w: w = v)), 2)))::DOUBLE AS sq, {pairs('c', '(2 * {0} < m) <> (2 * {1} < m)')} AS changes, {pairs('h', '{0} <> {1}')} AS turns,
  list_sum(list_transform(range(1, n), lambda i: (c[i] - (m - 1) / 2) * (c[i + 1] - (m - 1) / 2))) AS along FROM cod),
dev AS (SELECT *, greatest(abs((m * sq / n - n - (m - 1)) / sqrt(2.0 * (m - 1) * (n - 1) / n)), abs((changes - (n - 1) / 2) / sqrt((n - 1) / 4)), abs(along / ((m * m - 1) / 12 * sqrt(n - 1)))) AS z,
  (n + n::DOUBLE * (n - 1) * k2 - sq) / sqrt(2.0 * n * (n - 1) * (k2 - k2 * k2) + 4.0 * n * (n - 1) * (n - 2) * (k3 - k2 * k2)) AS even, (turns - 0.5 - (n - 1) * r) / sqrt((n - 1) * r * (1 - r)) AS turned FROM cnt),
p AS (SELECT k, 3 AS kind, a, b, least(1, 6 * {tail('z')}) AS random, greatest(1e-300, ({either('even')}) * ({either('turned')})) AS q FROM dev),
bins AS (SELECT *, CASE WHEN random < {REJECT} THEN 0 ELSE least({BINS}, floor(-log10(q * (1 - ln(q))) * {STEP}))::INT END AS bin FROM p),
cut AS (SELECT min(bin) AS least FROM (SELECT bin, sum(count(*)) OVER (ORDER BY bin DESC) AS above, sum(count(*)) OVER () AS total FROM bins GROUP BY bin) WHERE bin > 0 AND total * power(10, -bin / {STEP}) <= {FALSE} * above),
more AS (SELECT k, kind, a, b FROM bins, cut WHERE bin >= least),
every AS (SELECT k, kind, a, b FROM base UNION ALL FROM more)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, sha256(coalesce(any_value(bs.s), '')) AS base_sha256, coalesce(any_value(es.s), '') AS spans, count(*) FILTER (kind = 3) AS n_random
FROM d LEFT JOIN every USING (k) LEFT JOIN ({spans('base')}) AS bs USING (k) LEFT JOIN ({spans('every')}) AS es USING (k) GROUP BY k, doc_id"""


ORACLE = _duck_oracle()
