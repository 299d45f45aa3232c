"""Operator 2: language-model scoring by prediction by partial matching over byte contexts.

A text is spelled as its words, A-Z in lower case, each closed by a blank, then a newline as its end. The model codes every byte of
that in the longest known context of up to ORDER bytes. It escapes to the next shorter one when the byte is unknown there, with the
mass that method C gives (a count for each distinct byte) plus the mass of what was pruned, and excludes there the bytes that the
longer context had offered. Below the empty context all bytes left are equally likely.

A byte's code length depends on its string alone, the byte and the ORDER bytes before it. So every distinct string of all texts is valued
once, with the counts of all training texts and nothing pruned. The strings are dealt out by the LOW last bytes of their contexts: a task has
every string of the orders from LOW that its own can escape to, and the strings of LOW bytes and a byte (those of the lower orders follow)
go to all tasks. A context's bytes are a subset of those of its suffix, so what is excluded after an escape depends on the longer context alone
and is worked out once for each. Texts are then scored by looking their strings up; what is not among the frequent ones meets its value in a join.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from math import log10

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import common

ORDER = 5
#: Orders below LOW are known to all tasks: at most 2 ** (8 * LOW) strings.
LOW = 3
#: Most strings whose values, and most words whose counts, are sent to all tasks.
NODES, WORDS = 1 << 21, 1 << 18
#: Bytes that are sorted at once, and strings or words that a task holds before it hands them on.
CHUNK, HELD = 1 << 23, 1 << 20
#: Strings that a task values, some more or fewer.
SHARD = 1 << 18
END = b"\n"


def spelled(words: list[bytes]) -> bytes:
    return b"".join([w + b" " for w in words]) + END


def strings(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every string of ORDER + 1 bytes in each piece as an integer (first byte highest), and the number of its piece."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    n = len(data) - ORDER
    grams = np.zeros(n, np.uint64)
    for k in range(ORDER + 1):
        grams <<= np.uint64(8)
        grams |= data[k : n + k]
    owner = np.repeat(np.arange(len(pieces)), sizes)
    whole = owner[:n] == owner[ORDER:]
    return grams[whole], owner[:n][whole]


def cut(texts: list[bytes]):
    """Lists of (number of the text, piece) of about CHUNK bytes; a piece starts with the ORDER bytes before it (newlines at first)."""
    held, size = [], 0
    for i, text in enumerate(texts):
        text = END * ORDER + text
        for at in range(0, len(text) - ORDER, CHUNK):
            held.append((i, text[at : at + CHUNK + ORDER]))
            size += len(held[-1][1])
            if size >= CHUNK or len(held) >= 1 << 15:
                yield held
                held, size = [], 0
    if held:
        yield held


class Model:
    """Looks strings up. ``tables``: for each order, (strings, counts, contexts, their totals), the integers sorted."""

    def __init__(self, tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.order, self.log_count, self.log_all, self.log_escape, self.log_all_after, self.log_escape_after = ORDER, {}, {}, {}, {}, {}
        self.grams, self.contexts = {}, {}
        seen: dict[int, tuple] = {}
        for j in range(ORDER + 1):
            grams, counts, contexts, totals = tables[j]
            self.grams[j], self.contexts[j] = pd.Index(grams), pd.Index(contexts)
            of = np.searchsorted(contexts, grams >> 8)
            q, kept = np.bincount(of, minlength=len(contexts)), np.bincount(of, counts, len(contexts))
            self.log_count[j] = np.log10(counts)
            self.log_all[j], self.log_escape[j] = self._logs(totals, kept, q)
            if j:  # the order below, after an escape from each of this order's contexts
                below, at = seen[j - 1], np.searchsorted(seen[j - 1][2], contexts & (1 << 8 * (j - 1)) - 1)
                here = np.searchsorted(below[0], grams & (1 << 8 * j) - 1)
                taken = np.bincount(of, below[1][here], len(contexts))
                self.log_all_after[j], self.log_escape_after[j] = self._logs(below[3][at] - taken, below[4][at] - taken, below[5][at] - q)
            seen[j] = (grams, counts, contexts, totals, kept, q)
        self.log_rest = -log10(max(1, 256 - len(tables[0][0])))

    @staticmethod
    def _logs(total, kept, q):
        everything = total + q
        with np.errstate(divide="ignore"):
            escape = np.where(everything > 0, (total - kept + q) / np.where(everything > 0, everything, 1), 1)
            return np.log10(np.maximum(everything, 1)), np.log10(escape)

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each string's last byte after the bytes before it."""
        out = np.zeros(len(grams))
        active, above = np.arange(len(grams)), np.full(len(grams), -1)
        for j in range(ORDER, -1, -1):
            own = (grams[active] & np.uint64((1 << 8 * (j + 1)) - 1)).astype(np.int64)
            context = self.contexts[j].get_indexer(own >> 8)
            known = context >= 0
            part, own, context, up = active[known], own[known], context[known], above[known]
            fresh = up < 0
            hit = self.grams[j].get_indexer(own)
            found = hit >= 0
            if j == ORDER:
                every, escape = self.log_all[j][context], self.log_escape[j][context]
            else:
                after = np.where(fresh, 0, up)
                none = not len(self.log_all_after[j + 1])
                every = self.log_all[j][context] if none else np.where(fresh, self.log_all[j][context], self.log_all_after[j + 1][after])
                escape = self.log_escape[j][context] if none else np.where(fresh, self.log_escape[j][context], self.log_escape_after[j + 1][after])
            out[part] += np.where(found, self.log_count[j][np.where(found, hit, 0)] - every, escape) if len(part) else 0
            go_on = np.ones(len(active), bool)
            go_on[np.flatnonzero(known)[found]] = False
            last = np.full(len(active), -1)
            last[known] = context
            active, above = active[go_on], last[go_on]
        out[active] += self.log_rest
        return out


def looked_up(texts: list[bytes], grams: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For each spelled text the sum of its strings' values, then the strings that ``grams`` (sorted) lacks and how often they occur."""
    total, rest = np.zeros(len(texts)), [(np.zeros(0, np.int64),) * 3]
    for held in cut(texts):
        own, owner = strings([p for _, p in held])
        mixed = own << np.uint64(16) | owner.astype(np.uint64)
        mixed.sort()
        new = np.flatnonzero(np.r_[True, mixed[1:] != mixed[:-1]]) if len(mixed) else np.zeros(0, np.int64)
        times, own = np.diff(np.r_[new, len(mixed)]), (mixed[new] >> np.uint64(16)).astype(np.int64)
        text = np.array([i for i, _ in held])[(mixed[new] & np.uint64(0xFFFF)).astype(np.int64)]
        at = np.searchsorted(grams, own)
        hit = at < len(grams)
        hit[hit] = grams[at[hit]] == own[hit]
        total += np.bincount(text[hit], values[at[hit]] * times[hit], len(texts))
        rest.append((text[~hit], own[~hit], times[~hit]))
    text, own, times = (np.concatenate(x) for x in zip(*rest, strict=True))
    order = np.argsort(text, kind="stable")
    ends = np.searchsorted(text[order], np.arange(1, len(texts)))
    return total, np.split(own[order], ends), np.split(times[order], ends)


def gather(docs: DataFrame, folder: str) -> DataFrame:
    """(word binary, gram long, n long, m long): the count of every word (END: texts) of the training texts and of every string, in them (n) and in all texts (m)."""

    def run(batches):
        words, grams, counts = Counter(), [], []

        def hand_on():
            if words:
                n = list(words.values())
                yield pd.DataFrame({"word": list(words), "gram": pd.array([None] * len(words), "Int64"), "n": n, "m": n})
            if grams:
                found, where = np.unique(np.concatenate(grams), return_inverse=True)
                n, m = (np.bincount(where, np.concatenate(x), len(found)).astype(np.int64) for x in zip(*counts, strict=True))
                yield pd.DataFrame({"word": None, "gram": pd.array(found.astype(np.int64), "Int64"), "n": n, "m": m})
            words.clear(), grams.clear(), counts.clear()

        for pdf in batches:
            texts: dict[bool, list[bytes]] = {True: [], False: []}
            for text, train in zip(pdf.text, pdf.train, strict=True):
                own = common.words_of(text)
                texts[bool(train)].append(spelled(own))
                if train:
                    words.update(own)
            if texts[True]:
                words[END] += len(texts[True])
            for train, own in texts.items():
                for held in cut(own):
                    found, m = np.unique(strings([p for _, p in held])[0], return_counts=True)
                    grams.append(found)
                    counts.append((m if train else np.zeros_like(m), m))
            if len(words) > HELD or sum(map(len, grams)) > 2 * HELD:
                yield from hand_on()
        yield from hand_on()

    counted = common.text_batches(docs.selectExpr("text", "coalesce(train, false) train")).mapInPandas(run, "word binary, gram long, n long, m long")
    return common.written(counted.groupBy("word", "gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "counts", folder)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(keys, return_inverse=True)
    return found, np.bincount(where, counts, len(found)).astype(np.int64)


def fit(grams: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray]) -> Model:
    """The model of trained strings that are all or none of those whose contexts end in the same LOW bytes; ``low``: all strings of LOW bytes, with their counts."""
    tables = {}
    for j in range(ORDER, -1, -1):
        if j == LOW - 1:
            grams, counts = low
        grams, counts = summed(grams & (1 << 8 * (j + 1)) - 1, counts)
        tables[j] = (grams, counts, *summed(grams >> 8, counts))
    return Model(tables)


def columns(df: DataFrame) -> list[np.ndarray]:
    """The columns of a bounded table on the driver, by way of Arrow: no row becomes a Python object."""
    return [c.to_numpy() for c in df.toArrow().columns]


def valued(counts: DataFrame, folder: str) -> DataFrame:
    """(gram, m, value): log10 probability of each distinct string's last byte, and how often it occurs in all texts."""
    grams = counts.filter("gram IS NOT NULL").select("gram", "n", "m")
    low = grams.filter("n > 0").groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * LOW) - 1)).alias("g")).agg(F.sum("n").alias("n"))
    shared = counts.sparkSession.sparkContext.broadcast(tuple(columns(low)))

    def run(batches):
        parts = [(p.gram.to_numpy(np.int64), p.n.to_numpy(np.int64), p.m.to_numpy(np.int64)) for p in batches]
        if not sum(len(p[0]) for p in parts):
            return
        own, n, m = (np.concatenate(x) for x in zip(*parts, strict=True))
        model = fit(own[n > 0], n[n > 0], shared.value)
        for at in range(0, len(own), SHARD):
            part = own[at : at + SHARD]
            yield pd.DataFrame({"gram": part, "m": m[at : at + SHARD], "value": model.log10(part.astype(np.uint64))})

    tasks = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-grams.count() // SHARD))
    ending = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * LOW) - 1))
    return common.written(grams.repartition(tasks, ending).mapInPandas(run, "gram long, m long, value double"), "values", folder)


def most(values: DataFrame, nodes: int) -> int:
    """The least count (of eight binary digits, then zeros) that at most ``nodes`` strings reach."""
    digits = values.selectExpr("m", "greatest(0, length(bin(m)) - 8) s").selectExpr("shiftleft(shiftright(m, s), s) m")
    least, sent = 1 << 62, 0
    for row in sorted(digits.groupBy("m").count().collect(), reverse=True):
        sent += row["count"]
        if sent > nodes:
            break
        least = row.m
    return least


def score(docs: DataFrame, training: F.Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes (spelled); ``training`` says which rows are learned from.

    Null and blank texts are the end alone. Rows of equal doc_id are scored each for itself. Without training rows every byte has
    1/256 and the base is 0 for each token (N and V are 0: one of one). Counts of frequent words (at most WORDS) go to all tasks; the others meet their
    words in a join. So do strings: the values of the most frequent ones (at most NODES) go to all tasks. The order of sums may differ in the last digits.
    """
    spark = docs.sparkSession
    folder = common.scratch(spark)
    docs = docs.select(common.id_text(), "text", training.alias("train"))
    counts = gather(docs, folder)
    values = valued(counts, folder)
    string_from = most(values, NODES)
    grams, logs = columns(values.filter(F.col("m") >= string_from).select("gram", "value"))
    order = np.argsort(grams)
    words = counts.filter("word IS NOT NULL").select("word", "n")
    n_all, n_distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent_from = max(1, -(-n_all // WORDS))
    frequent = {bytes(r.word): r.n for r in words.filter(F.col("n") >= frequent_from).collect()}
    shared = spark.sparkContext.broadcast((grams[order], logs[order], {w: log10(n + 1) for w, n in frequent.items()}))

    def run(batches):
        grams, logs = shared.value[:2], shared.value[2]
        for pdf in batches:
            rows, texts = [], []
            for text in pdf.text:
                own = common.words_of(text)
                texts.append(spelled(own))
                tally = Counter(own)
                tally[END] = 1
                total, known, rest, times = 0.0, 0, [], []
                for word, n in tally.items():
                    value = logs.get(word)
                    if value is None:
                        rest.append(word)
                        times.append(n)
                    else:
                        total += n * value
                        known += n
                rows.append((len(own) + 1, known, total, rest, times, len(texts[-1])))
            out = pd.DataFrame(rows, columns=["n_tokens", "known", "logs", "rest", "times", "n_bytes"])
            out.insert(0, "train", pdf.train.to_numpy())
            out.insert(0, "doc_id", pdf.doc_id.to_numpy())
            score, strange, often = looked_up(texts, *grams)
            yield out.assign(grams=strange, often=often, score=score)

    schema = "doc_id string, train boolean, n_tokens long, known long, logs double, rest array<binary>, times array<int>, n_bytes long, grams array<long>, often array<int>, score double"
    scored = common.written(common.id_long(common.text_batches(docs).mapInPandas(run, schema)).withColumn("rid", F.monotonically_increasing_id()), "scored", folder)
    rare = scored.select("rid", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("rid", F.col("x.rest").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(words.filter(F.col("n") < frequent_from), "word")
    rare = rare.select("rid", (F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.col("times").cast("long").alias("more_known"), F.lit(0.0).alias("more_score"))
    strange = scored.select("rid", F.explode(F.arrays_zip("grams", "often")).alias("x")).select("rid", F.col("x.grams").alias("gram"), F.col("x.often").alias("often"))
    strange = strange.join(values.filter(F.col("m") < string_from), "gram")
    rare = rare.unionByName(strange.select("rid", F.lit(0.0).alias("more"), F.lit(0).cast("long").alias("more_known"), (F.col("often") * F.col("value")).alias("more_score")))
    rare = rare.groupBy("rid").agg(*(F.sum(c).alias(c) for c in ("more", "more_known", "more_score")))
    none = lambda c: F.coalesce(c, F.lit(0))
    base = F.col("logs") + none("more") - F.col("n_tokens") * F.lit(log10(n_all + n_distinct + 1))
    return scored.join(rare, "rid", "left").select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("known") + none("more_known")).cast("long").alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + none("more_score")).alias("score"), "n_bytes",
    )


class Trie:
    """The same model byte by byte, and its adaptive form, which learns each byte after coding it. For single texts and as a check.

    ``score`` of a trained trie equals the tables' scores.
    """

    def __init__(self, order: int = ORDER):
        self.order, self.counts = order, defaultdict(Counter)

    def learn(self, before: bytes, byte: int) -> None:
        for j in range(self.order + 1):
            self.counts[before[len(before) - j :]][byte] += 1

    def log10(self, before: bytes, byte: int) -> float:
        out, excluded = 0.0, set()
        for j in range(self.order, -1, -1):
            offered = self.counts.get(before[len(before) - j :])
            if not offered:
                continue
            left = {b: n for b, n in offered.items() if b not in excluded}
            total, q = sum(left.values()), len(left)
            if byte in left:
                return out + log10(left[byte] / (total + q))
            if q:
                out += log10(q / (total + q))
            excluded |= set(offered)
        return out - log10(max(1, 256 - len(excluded)))

    def score(self, text: str | None, adapt: bool = False) -> float:
        data, total = END * self.order + spelled(common.words_of(text)), 0.0
        for i in range(self.order, len(data)):
            before = data[i - self.order : i]
            total += self.log10(before, data[i])
            if adapt:
                self.learn(before, data[i])
        return total


def adaptive_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id and the adaptive log10 code length of each text, every one from an empty trie; memory follows the longest text."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "score": [Trie(order).score(t, True) for t in pdf.text]})

    return common.id_long(common.text_batches(docs).select(common.id_text(), "text").mapInPandas(run, "doc_id string, score double"))
