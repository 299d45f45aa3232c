"""Exact ids, tie orders, brute-force comparisons of whole queries and of the pipeline's stages, and awkward tables."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lamina.llm import ann, bpe_dp, common, langid, line_templates, packing, ppm, quality, simhash, token_store
from lamina.llm.components import components

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LARGE = [2**53 + 1, 2**53 + 3, None, 2**62 + 1, -(2**53) - 1]
TEXT = "the house by the river was old and the garden round it had not been cut for many a long year when they came back to see what was left of it all and they sat down under one of the trees and talked until it was dark "
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(ids):
    """One clean text an id: 60 words or more, all different from one another."""
    return [(i, TEXT + " ".join(f"{chr(97 + k)}{chr(97 + j)}w" for j in range(26)), "en", None, 2**53 + 1 + k) for k, i in enumerate(ids)]


@pytest.fixture(scope="module")
def large(spark):
    return spark.createDataFrame(texts(LARGE), SCHEMA).coalesce(1)


def test_exact_ids(spark, large, tmp_path):
    want = Counter(LARGE)
    train = common.held_remainder("doc_id", 7) != 2
    manifest = token_store.write_store(large, f"file://{tmp_path}/a", BYTE, rows_per_file=2)
    for found in (
        ppm.score(large, train), ppm.adaptive_scores(large), bpe_dp.encode_and_decode(large, BYTE), token_store.read_store(manifest), line_templates.deduplicated(large),
        simhash.near_duplicates(large), langid.held_out_identification(large), packing.pack(large, WORD).select("doc_id").distinct(), quality.assess(large),
    ):
        assert Counter(r.doc_id for r in found.select("doc_id").collect()) == want
    held = {r.doc_id: r.held_out for r in ppm.score(large, train).collect()}
    assert held == {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i in LARGE}


def test_large_ids_order(spark):
    """Neighbouring ids over 2 ** 53 stay apart where they decide: the keeper of a line, the least of a component, the order of a store."""
    rows = [(i, TEXT) for i in (2**53 + 3, 2**53 + 1, None, 2**53 + 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.n_dropped for r in line_templates.deduplicated(df).collect()} == {i: int(i != 2**53 + 1) for i, _ in rows}
    assert {r.component_id for r in simhash.near_duplicates(df).collect()} == {2**53 + 1}
    manifest = token_store.write_store(df, f"{common.scratch(spark)}/a", BYTE)
    assert [r.doc_id for r in token_store.read_store(manifest).orderBy("start").collect()] == [None, 2**53 + 1, 2**53 + 2, 2**53 + 3]


def test_stages_keep_large_ids(spark, large):
    import corpus_pipeline

    now = large
    for name, stage in corpus_pipeline.STAGES:
        now = common.written(stage(spark, now, ""), name)
        if name == "near":
            break
        assert sorted(now.collect(), key=str) == sorted(large.collect(), key=str)
    assert {(r.doc_id, r.n_chars) for r in now.collect()} <= {(r.doc_id, r.n_chars) for r in large.collect()}


def test_store_spreads_one_hot_id(spark):
    rows = [(5, f"text {i}") for i in range(200)] + [(i, "x") for i in range(10)] + [(None, "y")] * 20
    manifest = token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), f"{common.scratch(spark)}/a", BYTE, rows_per_file=20)
    files = manifest.orderBy("file_no").collect()
    assert len(files) > 8 and max(r.n_docs for r in files) < 80 and sum(r.n_docs for r in files) == 230
    found = [r.doc_id for r in token_store.read_store(manifest).orderBy("start").collect()]
    assert found == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    few = token_store.write_store(spark.createDataFrame([(i, "word " * 1000) for i in range(40)], "doc_id long, text string"), f"{common.scratch(spark)}/a", BYTE, bytes_per_file=20_000)
    assert few.agg(F.max("n_docs")).first()[0] <= 12


def neighbours(rows, top=20):
    ids, v, out = np.array([i for i, _ in rows]), np.array([x for _, x in rows], float), []
    for i in np.flatnonzero(ids % 20 == 0):
        scores, other = (v * v[i]).sum(1), ids != ids[i]
        order = np.lexsort((ids[other], -scores[other]))[:top]
        out += [(int(ids[i]), r + 1, int(ids[other][j]), float(scores[other][j])) for r, j in enumerate(order)]
    return sorted(out)


def test_ann_ties_and_scores_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.integers(0, 2, 10)]) for i in rng.permutation(900)]
    rows = [(i, v) for i, v in rows if any(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert sorted(tuple(r) for r in ann.search(df).collect()) == neighbours(rows)
    monkeypatch.setattr(ann, "CELL", 64)  # groups cut into cells
    monkeypatch.setattr(ann, "GROUP", 128)
    assert sorted(tuple(r) for r in ann.search(df).collect()) == neighbours(rows)


def test_ann_copies_and_prunes(spark):
    rng = np.random.default_rng(3)
    vectors = np.concatenate([c + 0.25 * rng.normal(size=(100, 16)) for c in rng.normal(size=(60, 16))])
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    built = ann.index(df)
    figures = built.figures()
    assert figures["copies"] > 1.2 and figures["share"] < 0.4 and figures["lists"] > 200
    found = ann.found_by(built, 20, 20).toPandas()
    assert ann.recall(found, vectors, np.arange(6000)) >= 0.95
    assert all(r.score == (vectors[r.query_id] * vectors[r.vec_id]).sum() for r in found.itertuples())


def test_language_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = df.collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    letters = lambda t: b" ".join(bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in t.lower().encode()).split())
    learned = langid.fit(df.filter(common.held_remainder("doc_id", 3) != 1))
    own = {letters(r.text) for r in rows if r.text and r.lang and not held(r.doc_id)}
    assert all(len(d) <= langid.DICTIONARY_BYTES and any(d.startswith(t) for t in own if t) for d in learned.values())  # whole texts
    packers = {
        level: {k: zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for k, d in learned.items()}
        for level in langid.LEVELS
    }
    for r in langid.held_out_identification(df).collect():
        text = next(x.text for x in rows if x.doc_id == r.doc_id)
        assert r.held_out == held(r.doc_id)
        if not text or not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        data, sizes = letters(text), dict.fromkeys(sorted(learned), 0)
        for level in langid.LEVELS:
            for k in sizes:
                sizes[k] += sum(len(packers[level][k].compress(data[i : i + langid.BLOCK_BYTES])) for i in range(0, len(data), langid.BLOCK_BYTES))
            best, second = sorted(sizes.values())[:2]
            if second - best >= langid.DOUBT * second:
                break
        best, second = sorted(sizes, key=sizes.get)[:2]
        assert r.lang_pred == best and r.score == pytest.approx((sizes[second] - sizes[best]) / sizes[second])


def test_no_language_learned(spark):
    import corpus_pipeline

    df = spark.createDataFrame([(i, t, None, "s", n) for i, t, _, _, n in texts(range(20))] + [(50, None, None, None, None), (51, "123", None, None, 3)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.language_stage(spark, df, "").collect()) == list(range(20))
    assert {r.lang_pred for r in langid.held_out_identification(df).collect()} == {"und"}


def test_whole_pipeline_against_its_operators(spark, tmp_path):
    """Each stage's rows by plain Python on what it was given, on the smallest table with copies and templates."""
    import corpus_pipeline
    from tests.llm.test_operators import W, slow_components, slow_fingerprint, slow_templates

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(corpus_pipeline.COLUMNS)
    now = dict(corpus_pipeline.STAGES)["language"](spark, table, "")
    accepted = {r.doc_id for r in langid.identify(table, langid.fit(table), "doc_id").filter("accepted").collect()}
    assert {r.doc_id for r in now.collect()} == accepted
    now = common.written(now, "a")
    kept = common.written(dict(corpus_pipeline.STAGES)["quality"](spark, now, ""), "b")
    want = {r.doc_id for r in quality.assess(now).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == want and all(len(W.findall(r.text)) >= 50 for r in kept.collect())
    lines = common.written(dict(corpus_pipeline.STAGES)["lines"](spark, kept, ""), "c")
    drops = slow_templates([(r.doc_id, r.text) for r in kept.collect()])
    left = {r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in set(drops[r.doc_id])) for r in kept.collect()}
    assert {r.doc_id: r.text for r in lines.collect()} == {i: t for i, t in left.items() if not drops[i] or W.search(t)}
    assert all(r.n_chars == len(r.text) for r in lines.collect() if drops[r.doc_id])
    rows = sorted(lines.collect(), key=lambda r: r.doc_id)
    roots = slow_components([slow_fingerprint(r.text) for r in rows])
    near = common.written(dict(corpus_pipeline.STAGES)["near"](spark, lines, ""), "d")
    assert sorted(r.doc_id for r in near.collect()) == sorted(rows[k].doc_id for k in set(roots))
    pieces = dict(corpus_pipeline.STAGES)["packing"](spark, near, "").toPandas()
    library = Tokenizer.from_file(WORD)
    for r in near.collect():
        ids = np.array(library.encode(r.text, add_special_tokens=False).ids + [2], "<u4")
        own = pieces[pieces.doc_id == r.doc_id].sort_values("start")
        assert own.length.sum() == len(ids) and [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()


def test_ablations_from_the_ledger(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    entries = quality.assess(df).toPandas()
    for r in quality.policy_report(df).collect():
        bit, mask = 1 << list(quality.RULES).index(r.rule), quality.mask(r.policy)
        assert (r.failed, r.alone) == ((entries.failures & bit != 0).sum(), (entries.failures & mask == bit).sum())


def test_adaptive_scores_learn(spark):
    df = spark.createDataFrame([(1, "abc " * 50), (2, None), (3, "")], "doc_id long, text string")
    found = {r.doc_id: r.score for r in ppm.adaptive_scores(df).collect()}
    assert found[2] == found[3] == pytest.approx(ppm.Trie().score("", True)) and found[1] > 50 * ppm.Trie().score("abc", True)


def test_hot_star_and_unfinished_components(spark, monkeypatch):
    import lamina.llm.components as module

    edges = spark.createDataFrame([(i, 0) for i in range(1, 400)] + [(i, 10_000) for i in range(500, 900)] + [(900 + i, 901 + i) for i in range(40)], "u long, v long")
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    monkeypatch.setattr(common, "HOT_KEYS", 1 << 30)
    found = {r.node: r.root for r in components(edges, common.scratch(spark)).collect()}
    assert all(found[i] == 0 for i in range(400)) and all(found[i] == 500 for i in [*range(500, 900), 10_000]) and all(found[900 + i] == 900 for i in range(41))
    monkeypatch.setattr(module, "PASSES", 2)
    with pytest.raises(RuntimeError):
        components(edges, common.scratch(spark))


def test_very_long_texts(spark, tmp_path):
    """A text of some 3 MB between short ones goes through every operator whole."""
    rng = np.random.default_rng(1)
    words = np.array(["".join(chr(97 + x) for x in rng.integers(0, 26, 5)) for _ in range(3000)])
    text = "\n".join(" ".join(rng.choice(words, 12)) for _ in range(40_000))
    df = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, TEXT, "en", "s", 9), (3, None, None, None, None)], SCHEMA)
    library = Tokenizer.from_file(BYTE)
    ids = np.array(library.encode(text, add_special_tokens=False).ids, "<u4")
    row = bpe_dp.encode_and_decode(df, BYTE).filter("doc_id = 1").first()
    assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and row.round_trip
    stored = token_store.read_store(token_store.write_store(df, f"file://{tmp_path}/a", BYTE), [1]).first()
    assert stored.n_tokens == len(ids) + 1
    assert ppm.score(df, F.lit(True)).filter("doc_id = 1").first().n_tokens == 480_001
    assert quality.assess(df).filter("doc_id = 1").first().n_words == 480_000
    assert line_templates.deduplicated(df).filter("doc_id = 1").first().n_lines == 40_000
    assert langid.held_out_identification(df).count() == simhash.near_duplicates(df).count() == 3
    assert packing.pack(df, WORD).filter("doc_id = 1").agg(F.max("doc_tokens") == F.sum("length")).first()[0]


def test_store_splits_rows_without_id(spark):
    """2,000 rows without an id, half of them equal, make files of some 20 rows."""
    rows = [(None, "same text" if i % 2 else f"text {i}") for i in range(2000)] + [(i, "x") for i in range(50)]
    manifest = token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), f"{common.scratch(spark)}/nulls", BYTE, rows_per_file=20)
    sizes = [r.n_docs for r in manifest.collect()]
    assert sum(sizes) == 2050 and max(sizes) <= 60
    read = token_store.read_store(manifest).orderBy("start").collect()
    assert [r.doc_id for r in read] == [None] * 2000 + list(range(50))


def test_languages_of_long_texts_and_many_languages(spark):
    french = "le chat noir dort sur la chaise verte pendant que la pluie tombe doucement dans le jardin de la maison "
    english = "the black cat sleeps on the green chair while the rain falls softly in the garden of the house "
    rows = [(i, french * 400 + str(i), "fr") for i in range(30)] + [(100 + i, english + str(i), "en") for i in range(30)]
    found = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(found) == {"fr", "en"} and all(0 < len(d) <= langid.DICTIONARY_BYTES for d in found.values())
    classifier = langid.Classifier(found)
    assert classifier.predict("le jardin de la maison verte")[0] == "fr" and classifier.predict("the garden of the house")[0] == "en"
    letters = "abcdefghijklmnopqrst"
    words = lambda k: " ".join(letters[(k * 7 + i * (k % 13 + 1)) % 20] * 2 + letters[(k + i) % 20] + letters[k % 20] + letters[k // 20] for i in range(60))
    many = [(3 * k + j, words(k) + " " + letters[j], f"l{k:03}") for k in range(300) for j in range(2)]
    assert len(langid.fit(spark.createDataFrame(many, "doc_id long, text string, lang string"))) == 300


def test_packing_of_rows_without_id(spark):
    """All rows without an id: they are dealt to fillers and patterns by their texts, and no sequence is padded."""
    rows = [(None, "word " * (40 + 7 * i % 900)) for i in range(300)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), WORD).collect()
    filled = Counter()
    for r in out:
        filled[r.sequence_id] += r.length
    short = [n for n in filled.values() if n != packing.LENGTH]
    assert sum(filled.values()) == sum(r.length for r in out) and all(n & (n - 1) == 0 for n in short)


def test_search_bounds_lose_nothing(spark, monkeypatch):
    """Many small groups, so that most cells have a bound: the same rows as with all in one group."""
    rng = np.random.default_rng(8)
    x = np.round(rng.standard_normal((1500, 8)), 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, ann.search(df).collect()))
    monkeypatch.setattr(ann, "GROUP", 300)
    assert sorted(map(tuple, ann.search(df).collect())) == whole
