"""Operator 6: line dedup by a log-template tree of fixed depth.

A line is its tokens, those with a digit replaced by a wildcard. The tree's first level is the number of tokens, the next DEPTH are the
leading tokens. The places behind those are cut into equal stretches. Two lines of a leaf have one template if they are equal but for FIELDS of
the stretches at most, which hold VARIABLE of the places at most: these are the variable fields that a template generalises. A template is all lines that
such pairs connect. A template recurs if its lines occur in two documents or more (short ones: SHORT_SUPPORT). The first document (least
doc_id) keeps its lines of a recurring template; all later ones drop theirs.

Equal masked lines are counted before they meet, so copies weigh nothing. Lines equal but for given stretches share the hash of all the others, so
each choice of stretches is a key, and a key's lines are a star round the least of them: no two lines are ever compared, a leaf or a template with a third of all
lines is summed up like any other, and the result is the same whatever a leaf's size and the order of its lines. Before that, lines that share none of
FIELDS + 1 parts of a leaf with any other line are set aside: two lines of a template share one.
Nodes and keys are 64-bit hashes: with n distinct lines that share a part, two clash with a chance of n * n / 2 ** 65.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import common
from lamina.llm.components import components

#: Leading tokens of a leaf, share of the places that may vary, stretches that may.
DEPTH, VARIABLE, FIELDS = 3, 0.2, 2
SALTS = 256
#: Lines of fewer tokens than SHORT drop only with a support of SHORT_SUPPORT documents; of fewer than LEAST, never.
SHORT, SHORT_SUPPORT, LEAST = 8, 10, 3
WILD = b"<*>"
#: Up to so many dropped lines (24 bytes each) are sent to all tasks; more meet their documents in a join.
BROADCAST_LINES = 500_000
DIGIT = re.compile(rb"[0-9]")


def keyed(text: str | None, at_most: int = 1 << 62) -> list[tuple[int, bytes, bytes]]:
    """(number, key, masked tokens) of the lines that could recur, of ``at_most`` tokens. bytes.split() knows ASCII white space only."""
    out = []
    for i, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        tokens = line.split()
        if LEAST <= len(tokens) <= at_most:
            if DIGIT.search(line):
                tokens = [WILD if DIGIT.search(t) else t for t in tokens]
                if tokens.count(WILD) == len(tokens):
                    continue
            joined = b" ".join(tokens)
            out.append((i, hashlib.md5(joined).digest(), joined))
    return out


def stretches(words: int) -> tuple[list[int], int]:
    """Edges of the stretches of a line of ``words`` tokens, and how many of them may vary."""
    vary = int(VARIABLE * words + 1e-9)
    rest = words - DEPTH
    if vary < 1 or rest < 1:
        return [DEPTH], 0
    fields = min(FIELDS, vary)
    parts = -(-rest // (vary // fields))
    return [DEPTH + k * rest // parts for k in range(parts + 1)], min(fields, parts - 1) or 1


def _hashes(tokens: str) -> str:
    """SQL: a hash for each stretch of the array ``tokens``, by the rule of ``stretches``."""
    rest, vary = f"(size({tokens}) - {DEPTH})", f"int(floor({VARIABLE} * size({tokens}) + 1e-9))"
    parts = f"int(ceil({rest} / floor({vary} / least({FIELDS}, {vary}))))"
    cut = f"slice({tokens}, int({DEPTH} + 1 + floor(k * {rest} / {parts})), int(floor((k + 1) * {rest} / {parts}) - floor(k * {rest} / {parts})))"
    return f"transform(sequence(0, {parts} - 1), k -> xxhash64('stretch', k, array_join({cut}, ' ')))"


def line_table(docs: DataFrame, at_most: int | None = None, *also: str) -> DataFrame:
    """(doc_id, key binary, line, then columns ``also``): the distinct masked lines of every row, of ``at_most`` tokens if given (then without their texts)."""

    def run(batches):
        for pdf in batches:
            at, keys, lines = [], [], []
            for i, text in enumerate(pdf.text):
                own = {key: line if at_most else line.decode("utf-8", "surrogatepass") for _, key, line in keyed(text, at_most or 1 << 62)}
                at += [i] * len(own)
                keys += own.keys()
                lines += own.values()
            if not keys:
                continue
            same = {c: [own[i] for i in at] for c in ("doc_id", *also) for own in [pdf[c].tolist()]}
            yield pd.DataFrame({"doc_id": same.pop("doc_id"), "key": keys, "line": [None] * len(keys) if at_most else lines} | same)

    extra = "".join(f", {c} {dict(docs.dtypes)[c]}" for c in also)
    return common.id_long(common.text_batches(docs).select(common.id_text(), "text", *also).mapInPandas(run, f"doc_id string, key binary, line string{extra}"))


def stars(keys: DataFrame) -> DataFrame:
    """(node, key) rows -> (u, v): edges that connect the nodes of each key. A key's nodes are dealt to SALTS salts, so no task holds a frequent key."""
    salted = keys.withColumn("salt", F.pmod(F.xxhash64("node", F.lit("salt")), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("key", "salt").agg(F.min("node").alias("v"), F.count("*").alias("n"))
    inner = salted.join(parts.filter("n > 1").select("key", "salt", "v"), ["key", "salt"]).filter("node <> v").select(F.col("node").alias("u"), "v")
    tops = parts.groupBy("key").agg(F.sort_array(F.collect_set("v")).alias("vs")).filter("size(vs) > 1")  # at most SALTS
    outer = tops.select(F.explode(F.expr("slice(vs, 2, size(vs))")).alias("u"), F.expr("vs[0]").alias("v"))
    return inner.unionByName(outer)


def templates(lines: DataFrame, folder: str) -> DataFrame:
    """(node, root): the lines (node long, line string, words; a written table) whose template has more than one, with the least node of the template."""
    leaves = lines.filter(f"floor({VARIABLE} * words + 1e-9) >= 1 AND words > {DEPTH}").selectExpr("node", "line", f"xxhash64('leaf', words, substring_index(line, ' ', {DEPTH})) leaf")
    many = leaves.groupBy("leaf").agg(F.count("*").alias("n")).filter("n > 1")
    shared = common.written(common.joined(leaves, many, ["leaf"], lines.count()).drop("n"), "shared", folder)
    # inline(array(struct)) keeps the optimizer from writing an expression out wherever its value is used
    tokens = shared.selectExpr("inline(array(struct(node, leaf, split(line, ' ') t)))")
    parts = tokens.selectExpr(f"inline(array(struct(node, leaf, {_hashes('t')} h, int(floor({VARIABLE} * size(t) + 1e-9)) vary)))")
    parts = common.written(parts.selectExpr("node", "leaf", "h", f"greatest(1, least({FIELDS}, vary, size(h) - 1)) fields"), "parts", folder)
    # of fields + 1 runs of stretches two lines of a template share one at least; with a single stretch, the leaf alone
    run = "slice(h, int(1 + floor(p * size(h) / (fields + 1))), int(floor((p + 1) * size(h) / (fields + 1)) - floor(p * size(h) / (fields + 1))))"
    part = parts.selectExpr("node", f"explode(if(size(h) > fields, transform(sequence(0, fields), p -> xxhash64(leaf, p, {run})), array(leaf))) part")
    often = part.groupBy("part").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).filter("low <> high").select("part", "n")
    near = common.joined(part, often, ["part"], (FIELDS + 1) * parts.count()).select("node").distinct()
    near = common.written(parts.join(near, "node"), "near", folder)
    rest = near.selectExpr("inline(array(struct(node, leaf, h, fields, aggregate(h, 0L, (a, x) -> a ^ x) e)))")
    one = "transform(h, (x, i) -> xxhash64(leaf, i, e ^ x))"
    two = "flatten(transform(h, (x, i) -> transform(slice(h, i + 2, size(h)), (y, j) -> xxhash64(leaf, i, i + 1 + j, e ^ x ^ y))))"
    keys = rest.selectExpr("node", f"explode(if(fields = 1, {one}, {two})) key")
    keys = common.written(keys, "keys", folder)
    often = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return components(common.written(stars(common.joined(keys, often, ["key"], keys.count()).select("node", "key")), "links", folder), folder)


def recurring(docs: DataFrame, folder: str) -> DataFrame:
    """(key, keeper, n): masked lines of templates that recur, with the document that keeps them and how many rows have them."""
    lines = line_table(docs).groupBy("key").agg(F.first("line").alias("line"), F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max(F.col("doc_id").isNull()).alias("nameless"))
    lines = common.written(lines.withColumns({"node": F.xxhash64("key"), "words": F.size(F.split("line", " "))}), "lines", folder)
    named = common.written(templates(lines.select("node", "line", "words"), folder), "templates", folder)
    own = ["key", "n", "low", "high", "nameless", "words"]
    several = common.written(lines.join(named, "node").select("root", *own), "several", folder)
    again = "(low < high OR (nameless AND low IS NOT NULL))"
    whole = several.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("nameless").alias("nameless"))
    whole = whole.filter(again).select("root", F.col("m").alias("n"), "rows", F.col("low").alias("keeper"))
    grown = common.joined(several.select("root", "key", F.col("n").alias("own"), "words"), whole, ["root"], several.count()).withColumnRenamed("n", "m")
    alone = lines.join(named, "node", "left_anti").filter(again).select(F.col("node").alias("root"), "key", F.col("n").alias("own"), "words", F.lit(1).cast("long").alias("m"), F.col("n").alias("rows"), F.col("low").alias("keeper"))
    found = common.written(grown.unionByName(alone), "candidates", folder)
    result = lambda df: df.select("key", "keeper", F.col("own").alias("n"))
    long, short = found.filter(F.col("words") >= SHORT), found.filter((F.col("words") < SHORT) & (F.col("rows") >= SHORT_SUPPORT))
    # rows of one document, and its lines of one template, count once: documents are told apart where the support decides
    pairs = common.written(line_table(docs, SHORT - 1).select("doc_id", "key"), "pairs", folder)
    met = common.joined(pairs, short.select("key", "root", "m", F.col("own").alias("n")), ["key"], pairs.count())
    support = met.select("root", "m", F.struct("doc_id").alias("d")).distinct().groupBy("root", F.col("m").alias("n")).agg(F.count("*").alias("documents")).filter(F.col("documents") >= SHORT_SUPPORT)
    kept = common.joined(short, support, ["root"], short.count())
    return common.written(result(long).unionByName(result(kept)), "recurring", folder)


def drop_lines(docs: DataFrame, *keep: str, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``keep`` columns, text without its dropped lines, n_lines and dropped (their numbers from 0) of each row.

    Null texts have no lines and stay null; empty texts have one, which stays. A document keeps the lines that it repeats within itself. Rows of equal
    doc_id count as one document, and so do all rows with a null doc_id, which is never the first while another document has the template. Kept columns pass untouched, whatever
    their names and nulls. A very long text is read whole, in memory of a few times its lines. An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = common.scratch(spark)
    rules = recurring(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), folder)
    carried = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)), F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
    named = [f"_c{i}" for i in range(len(keep))]

    def without(text: str | None, numbers: list[int]) -> tuple[str | None, int, list[int]]:
        if text is None:
            return None, 0, []
        own, gone = text.split("\n"), set(numbers)
        return ("\n".join([x for i, x in enumerate(own) if i not in gone]) if gone else text), len(own), numbers

    added = "text string, n_lines long, dropped array<int>"
    if rules.count() <= broadcast_lines:
        table = rules.toArrow()
        keys = np.frombuffer(b"".join(table.column("key").to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
        order = np.argsort(keys[:, 0], kind="stable")
        shared = spark.sparkContext.broadcast((keys[order, 0], keys[order, 1], table.column("keeper").to_numpy()[order]))

        def compute(ids, texts):
            first, second, keeper = shared.value
            out = []
            for doc_id, text in zip(ids, texts, strict=True):
                own, numbers = keyed(text), []
                if own and len(first):
                    wanted = np.frombuffer(b"".join([k for _, k, _ in own]), ">u8").astype(np.uint64).reshape(-1, 2)
                    lows, highs = np.searchsorted(first, wanted[:, 0]), np.searchsorted(first, wanted[:, 0], side="right")
                    for at in np.flatnonzero(lows < highs):
                        for j in range(lows[at], highs[at]):
                            if second[j] == wanted[at, 1] and (doc_id is None or doc_id > keeper[j]):
                                numbers.append(own[at][0])
                out.append(without(text, numbers))
            return [list(x) for x in zip(*out, strict=True)] if out else [[], [], []]

        packed, first = carried, "_id"
    else:
        # a row's lines depend on its id and text alone, so rows that are equal in both share what they drop
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("th", F.xxhash64("text"))
        pairs = common.written(line_table(texts.dropDuplicates(["doc_id", "th"]), None, "th").select("doc_id", "th", "key"), "all-pairs", folder)
        hits = common.joined(pairs, rules, ["key"], pairs.count()).filter(F.col("doc_id").isNull() | (F.col("doc_id") > F.col("keeper")))
        hits = hits.groupBy("doc_id", "th").agg(F.collect_set("key").alias("_keys"))
        own = carried.withColumn("_th", F.xxhash64("_text"))
        met = own.join(hits, own["_id"].eqNullSafe(hits.doc_id) & (own["_th"] == hits.th), "left")
        packed, first = met, "_keys"

        def compute(keys, texts):
            out = []
            for own, text in zip(keys, texts, strict=True):
                gone = set(own or ())
                out.append(without(text, [i for i, key, _ in keyed(text) if key in gone] if gone else []))
            return [list(x) for x in zip(*out, strict=True)] if out else [[], [], []]

    return common.beside(packed, named, [first, "_text"], compute, added).toDF(*keep, "text", "n_lines", "dropped")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (line numbers), kept_sha256 (of the text that stays, null for null)."""
    found = drop_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    return found.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
