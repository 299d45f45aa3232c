"""Operator 8: language identification by compression.

A bounded sample of whole labelled texts becomes one raw-content zstandard dictionary a language. Every whole text is cut into blocks,
each block is compressed with each dictionary, and the language whose blocks take the fewest bytes in sum is chosen. A text whose
best two languages lie too close together is rejected.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm import common

#: Bounds of the sample that the dictionaries are made of: rows a language, bytes of a text, bytes of a language's dictionary and of all together, and
#: languages (the most frequent). Predictions know no such bounds. Up to PREPARED languages the compressors' tables stay in memory.
SAMPLE_ROWS, TEXT_BYTES, DICTIONARY_BYTES, ALL_BYTES, LANGUAGES, PREPARED = 400, 1 << 15, 1 << 17, 1 << 25, 1024, 64
BLOCK_BYTES = 4096
#: A text is rejected if the second language takes less than this share of bytes more.
MARGIN = 0.002
#: Compression levels: the first is for all texts, the second adds its sizes where the first leaves less than DOUBT.
LEVELS, DOUBT = (6, 12), 0.02

#: ASCII characters that aren't letters become blanks.
BLANKED = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def letters_of(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(BLANKED).split())


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Classifier:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], levels: tuple[int, ...] = LEVELS):
        import zstandard

        self.languages, self.packers = sorted(dictionaries), {level: [] for level in levels}
        for level, packers in self.packers.items():
            for language in self.languages:
                content = zstandard.ZstdCompressionDict(dictionaries[language], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                if len(self.languages) <= PREPARED:
                    content.precompute_compress(level=level)
                packers.append(zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        data = letters_of(text)
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        total = np.zeros(len(self.languages), np.int64)
        for packers in self.packers.values():
            total += [sum(len(p.compress(b)) for b in blocks) for p in packers]
            best, second = np.sort(total)[:2]
            if second - best >= DOUBT * second:
                break
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and the share of bytes that it saves against the second (0 with one language: 1); `und`, 0 without a letter."""
        if not self.languages or not has_letter(text):
            return "und", 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0
        sizes = self.sizes(text)
        best, second = np.argsort(sizes, kind="stable")[:2]
        return self.languages[best], float((sizes[second] - sizes[best]) / sizes[second])


def fit(docs: DataFrame) -> dict[str, bytes]:
    """language -> dictionary from (doc_id, text, lang) rows with a language, in order of a hash of doc_id, equal texts once.

    Texts are taken whole: those of over TEXT_BYTES and those that no longer fit in the dictionary are left out. A language that has only longer texts is
    learned from TEXT_BYTES characters of each, cut at a blank. Rows without a text or a language, and texts without a letter, teach nothing; of more than LANGUAGES languages the most
    frequent are learned (ties: the least name), and many languages share ALL_BYTES. Without labelled rows: no dictionary. Two passes over the labelled rows, whatever the
    number of languages: one counts, one draws.
    """
    long = F.octet_length("text") > TEXT_BYTES
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")).withColumn("long", long)
    counts = labelled.groupBy("lang").agg(F.count("*").alias("all"), F.count_if(~F.col("long")).alias("short")).orderBy(F.desc("all"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return {}
    most = min(DICTIONARY_BYTES, ALL_BYTES // len(counts))
    spot = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.length("text")), F.lit(1 << 30))
    share = docs.sparkSession.createDataFrame([(r.lang, r.short == 0, int(min(1.0, 1.5 * SAMPLE_ROWS / (r.short or r["all"])) * (1 << 30))) for r in counts], "lang string, long boolean, least long")
    chosen = labelled.withColumn("spot", spot).join(F.broadcast(share), ["lang", "long"]).filter(F.col("spot") <= F.col("least"))  # a row a language
    text = F.when(F.col("long"), F.regexp_replace(F.left("text", F.lit(TEXT_BYTES)), r"\s\S*$", "")).otherwise(F.col("text"))
    order = Window.partitionBy("lang").orderBy("spot", "text")
    drawn = chosen.select("lang", "spot", text.alias("text")).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= SAMPLE_ROWS)
    drawn = drawn.withColumn("before", F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))).filter(F.coalesce("before", F.lit(0)) <= 4 * most)
    found: dict[str, list[bytes]] = {}
    seen: dict[str, set] = {}
    for r in sorted(drawn.select("lang", "r", "text").collect(), key=lambda r: (r.lang, r.r)):  # at most some 4 x ALL_BYTES and a text a language
        parts, known = found.setdefault(r.lang, []), seen.setdefault(r.lang, set())
        part = letters_of(r.text)
        part = part if parts or len(part) < most else part[:most].rpartition(b" ")[0] or part[:most]  # the first one always teaches something
        key = hashlib.md5(part).digest()
        if part and key not in known and sum(map(len, parts)) + len(parts) + len(part) <= most:
            known.add(key)
            parts.append(part)
    return {language: b" ".join(parts) for language, parts in found.items() if parts}


@lru_cache(maxsize=4)
def _classifier(items: tuple[tuple[str, bytes], ...]) -> Classifier:
    return Classifier(dict(items))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *keep: str) -> DataFrame:
    """Adds lang_pred, score and accepted to ``keep`` columns of each row; only the text is looked at.

    Null texts and texts without a letter are `und`, score 0, not accepted. If no language was learned, every row is `und`, score 0, and those with a
    letter are accepted: nothing speaks against them. Ties of sizes go to the language that sorts first and are not accepted. A very long text is compressed
    block by block, whole. Repeated rows stay rows; kept columns pass untouched, whatever their names and nulls; an empty table gives no rows.
    Rows stay where they are: nothing is shuffled. The dictionaries that go to all tasks hold at most ALL_BYTES.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(dictionaries.items())))

    def compute(texts):
        classifier = _classifier(shared.value)
        found = [classifier.predict(t) for t in texts]
        accepted = [x[1] >= MARGIN and x[0] != "und" if classifier.languages else has_letter(t) for x, t in zip(found, texts, strict=True)]
        return [[x[0] for x in found], [x[1] for x in found], accepted]

    return common.beside(docs, list(keep), ["text"], compute, "lang_pred string, score double, accepted boolean")


def held_out_identification(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted: learned from rows whose crc32 remainder by 3 isn't 1."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", common.held_remainder("doc_id", 3) == 1)
    return identify(docs, fit(docs.filter(~F.col("held_out"))), "doc_id", "held_out")

