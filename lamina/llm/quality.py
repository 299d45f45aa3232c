"""Operator 3: a rule bitmask ledger, in DataFrame expressions alone.

Every rule is evaluated once a document. The ledger keeps the measurements and one bit a failed rule. A policy is a
versioned mask over those bits: applying one, or asking what a rule changes, is bit arithmetic on the ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import common

#: A Spark literal, which has no escape \f (it is the letter f there).
BLANKS = r"' \t\n\u000B\u000C\r'"
SYMBOLS = "#*$%&|<>"

#: name -> condition over the measurements under which a document fails; a rule's bit is its place here. Integer arithmetic only.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "shouting": "10 * n_bangs > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "word_length": "n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 10 * n_words)",
}
#: Version -> the rules that decide. Version 1 is the base.
POLICIES = {1: ("few_words", "repeated_words"), 2: tuple(RULES)}
CURRENT = 2


def mask(version: int) -> int:
    return sum(1 << k for k, name in enumerate(RULES) if name in POLICIES[version])


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is then evaluated once a row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeats() -> str:
    """Words in three-word windows found twice or more; ``w``: the words.

    Windows are compared by 64-bit hashes: of n windows in a text two different ones clash with a chance of n * n / 2 ** 65 (3e-8 for a million words),
    which would count three words too many. Most texts have as many distinct hashes as windows and are done. For the others, windows
    and places are sorted; each window with an equal neighbour covers three words, less what the next one covers.
    """
    pair = "zip_with(h, slice(h, 2, size(h)), (a, b) -> xxhash64(a, b))"
    triple = f"slice(zip_with({pair}, slice(h, 3, size(h)), (a, b) -> xxhash64(a, b)), 1, size(h) - 2)"
    ordered = "array_sort(transform(t, (x, i) -> struct(x, i)))"
    twice = "filter(s, (x, i) -> x.x = get(s, i - 1).x OR x.x = get(s, i + 1).x)"
    places = f"array_sort(transform({twice}, x -> x.i))"
    covered = "aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> least(3, coalesce(b - a, 3))), 0, (a, b) -> a + b)"
    found = _let("s", ordered, _let("p", places, covered))
    by_hash = _let("t", triple, f"if(size(array_distinct(t)) = size(t), 0, {found})")
    return f"if(size(w) < 4, 0, {_let('h', 'transform(w, x -> xxhash64(x))', by_hash)})"


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, or the columns ``keep``, with the measurements, all long. Null and blank texts have no words and measure 0 everywhere; rows stay apart."""
    text = "coalesce(text, '')"
    trimmed = f"btrim({text}, {BLANKS})"
    words = f"if({trimmed} = '', cast(array() as array<string>), split({trimmed}, '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+'))"
    by_word = _let("w", words, f"named_struct('n', size(w), 'chars', char_length(array_join(w, '')), 'repeats', {_repeats()})")
    lines = f"filter(split({text}, '\\\\n'), x -> btrim(x, {BLANKS}) <> '')"
    by_line = _let("l", lines, "named_struct('n', size(l), 'dups', size(l) - size(array_distinct(l)))")
    count = " + ".join(f"octet_length(t) - octet_length(replace(t, '{s}', ''))" for s in SYMBOLS)
    by_char = _let("t", text, f"named_struct('symbols', {count}, 'bangs', (octet_length(t) - octet_length(replace(t, '!!', ''))) div 2)")
    own = [f"`{c}`" for c in keep] or ["cast(doc_id as long) doc_id"]
    structs = docs.selectExpr(*own, f"{by_word} w", f"{by_line} l", f"{by_char} c")
    return structs.selectExpr(*(own if keep else ["doc_id"]), *(f"cast({x} as long) {name}" for x, name in (("w.n", "n_words"), ("w.chars", "word_chars"), ("c.symbols", "n_symbols"), ("l.dups", "n_dup_lines"), ("w.repeats", "n_repeat_words"), ("l.n", "n_lines"), ("c.bangs", "n_bangs"))))


def ledger(docs: DataFrame, *keep: str) -> DataFrame:
    """The measurements and ``failures``, the bits of the rules that a document fails. One pass, no shuffle."""
    bits = " | ".join(f"if({rule}, {1 << k}L, 0L)" for k, rule in enumerate(RULES.values()))
    return measure(docs, *keep).withColumn("failures", F.expr(bits))


def judge(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """Adds base_failed, kept and policy from the stored bits; no rule is evaluated again."""
    return entries.withColumns({
        "base_failed": F.col("failures").bitwiseAND(F.lit(mask(1))) != 0,
        "kept": F.col("failures").bitwiseAND(F.lit(mask(1) | mask(version))) == 0,
        "policy": F.lit(version),
    })


def ablations(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """rule, failed, alone (documents that the policy would keep without this rule), over all entries, by bitwise aggregation.

    Entries are first counted by their bits (at most 2 ** rules groups), so the rules work on those few rows.
    """
    groups = entries.groupBy(F.col("failures").bitwiseAND(F.lit(mask(version))).alias("f")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, name in enumerate(RULES) if name in POLICIES[version]))).alias("r")
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return groups.select("f", "n", rules).groupBy("r.rule").agg(total(F.col("f").bitwiseAND(F.col("r.bit")) != 0).alias("failed"), total(F.col("f") == F.col("r.bit")).alias("alone"))


def keep(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns."""
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}  # own columns may be called like a measurement
    entries = docs.select(*(F.col(c).alias(n) for c, n in names.items()), "text")
    return judge(ledger(entries, *names.values()), version).filter("kept").select(*(F.col(n).alias(c) for c, n in names.items()))


def store(docs: DataFrame, folder: str) -> DataFrame:
    """The ledger of ``docs`` written below ``folder`` and read again: policies and ablations work on it without the texts."""
    return common.written(ledger(docs), "ledger", folder)


def assess(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """The contract's columns, then the others of the ledger, from a stored ledger."""
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(store(docs, common.scratch(docs.sparkSession)), version).select(*first, "n_lines", "n_bangs", "failures", "policy")


def policy_report(docs: DataFrame) -> DataFrame:
    """policy, rule, failed, alone: the ablations of every policy version from one stored ledger."""
    entries, out = store(docs, common.scratch(docs.sparkSession)), None
    for version in POLICIES:
        own = ablations(entries, version).select(F.lit(version).alias("policy"), "rule", "failed", "alone")
        out = own if out is None else out.unionByName(own)
    return out


#: The same in DuckDB's SQL, by another way: windows are unnested and counted.
MEASURED = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
         ((length(text) - length(replace(text, '!!', ''))) // 2)::BIGINT AS n_bangs
  FROM t LEFT JOIN r USING (doc_id)),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
           + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_bangs > n_words THEN 8 ELSE 0 END
           + CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END
           + CASE WHEN n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 10 * n_words) THEN 32 ELSE 0 END)::BIGINT AS failures
  FROM m)
"""
ORACLE = (
    MEASURED
    + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept,
       n_lines, n_bangs, failures, 2 AS policy
FROM f
"""
)
REPORT_ORACLE = (
    MEASURED
    + """, p AS (
  SELECT * FROM (VALUES (1, 3), (2, 63)) AS x(policy, mask)),
names AS (
  SELECT * FROM (VALUES (1, 'few_words'), (2, 'repeated_words'), (4, 'symbols'), (8, 'shouting'), (16, 'repeated_lines'), (32, 'word_length')) AS x(bit, rule))
SELECT policy, rule, count(*) FILTER (WHERE failures & bit <> 0) AS failed, count(*) FILTER (WHERE failures & mask = bit) AS alone
FROM p JOIN names ON mask & bit <> 0 LEFT JOIN f ON true
GROUP BY ALL
"""
)
