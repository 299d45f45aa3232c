"""The ten operators on small awkward tables, against brute force."""

from __future__ import annotations

import io
import re
import zlib
from collections import Counter
from math import log10

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lamina.llm import ann, bpe_dp, common, langid, line_templates, packing, ppm, quality, sharding, simhash, token_store

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
W = re.compile(r"[^\x20\x09-\x0d]+")
PASSAGE = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
ROWS = [
    (1, "The quick brown fox. " * 12 + "\nEnd.", "en"), (2, None, "en"), (3, "", None), (4, "   \n\t ", "en"), (5, "one two", "en"),
    (6, PASSAGE, "en"), (7, PASSAGE + " tail", "en"), (8, PASSAGE, "en"), (8, PASSAGE, "en"), (9, "Der schnelle Fuchs läuft. " * 20, "de"),
    (10, "héllo  wörld <|endoftext|> 日本語 don't\r\n\r\nx", "fr"), (11, "a " * 9000, "en"), (None, "no id here", "en"), (12, "Line one is here now ok\n" * 3 + PASSAGE, "en"),
    (13, "12345 67890 !!! ### $$$ " * 10, "en"), (14, "\x1c\x85\xa0 odd", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, "s", -1 if t is None else len(t), 1.5) for i, t, lang in ROWS], "doc_id long, text string, lang string, source string, n_chars long, n_words double").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def key(r):
    return (r.doc_id is None, r.doc_id or 0)


def test_ann_recall_ties_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(600, 8)).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000 + i, vectors[0]) for i in range(40)] + [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [None] * 8), (None, vectors[1]), (2080, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(df).toPandas()
    good = [(i, v) for i, v in rows if i is not None and i < 2000]
    assert ann.recall(found, np.array([v for _, v in good]), np.array([i for i, _ in good])) >= 0.9
    assert set(found.query_id) == {i for i, _ in good if i % 20 == 0}
    assert (found.groupby("query_id")["rank"].max() == 20).all() and not (found.query_id == found.vec_id).any()
    ordered = found.sort_values(["query_id", "rank"])
    assert ordered.equals(found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]))
    assert ann.search(df.filter("false")).count() == 0


def test_ann_small_lists(spark):
    rng = np.random.default_rng(2)
    vectors = np.zeros((201, 8))
    vectors[:190, 0], vectors[190:200, 1], vectors[200, 2] = 1, 1, 1
    vectors += rng.normal(size=vectors.shape) * 1e-3
    ids = np.arange(201) * 20
    found = ann.search(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")).toPandas()
    assert found.groupby("query_id").size().tolist() == [20] * 201
    assert ann.recall(found, vectors, ids) >= 0.9


def test_ppm_base_and_trie(docs, none):
    train = common.held_remainder("doc_id", 7) != 2
    found = sorted(ppm.score(docs, train).collect(), key=key)
    words = lambda t: W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts, trie = Counter(), ppm.Trie()
    for i, t, _ in ROWS:
        if not held(i):
            counts.update(words(t))
            data = ppm.END * ppm.ORDER + ppm.spelled(common.words_of(t))
            for k in range(ppm.ORDER, len(data)):
                trie.learn(data[k - ppm.ORDER : k], data[k])
    n, v = sum(counts.values()), len(counts)
    for r, (i, t, _) in zip(found, sorted(ROWS, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        own = words(t)
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, held(i), len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(log10((counts[w] + 1) / (n + v + 1)) for w in own))
        assert r.score == pytest.approx(trie.score(t), rel=1e-9)
    assert ppm.score(none, train).count() == 0


def test_ppm_keeps_rare_strings(spark, monkeypatch):
    # over 2 ** 21 positions of one passage, so a bound by the share of all positions would drop what occurs once
    common_text = " ".join(f"{PASSAGE[i:]} {PASSAGE[:i]}" for i in range(0, 300, 43))
    copies = -(-(1 << 21) // len(common_text)) + 1
    texts = [("Zürich quartz wordaa zebu", True, 1), ("quixotic wordba zebra 日本", True, 1), ("Zürich quartz wordaa xylophone", False, 1), ("日本 zephyr \x01\x02 wordca", False, 1), (common_text, True, copies)]
    rows = [(i, text, train) for i, (text, train, n) in enumerate((t for t in texts for _ in range(t[2])))]
    trie = ppm.Trie()
    for text, train, n in texts:
        if train:
            data = ppm.END * ppm.ORDER + ppm.spelled(common.words_of(text))
            for k in range(ppm.ORDER, len(data)):
                for j in range(ppm.ORDER + 1):
                    trie.counts[data[k - j : k]][data[k]] += n
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    for nodes in (ppm.NODES, 100, 0):  # all values sent, some, none
        monkeypatch.setattr(ppm, "NODES", nodes)
        found = {r.doc_id: r.score for r in ppm.score(df, F.col("train")).filter("doc_id < 5").collect()}
        assert found == {i: pytest.approx(trie.score(text), rel=1e-9) for i, (text, _, _) in enumerate(texts)}


def test_quality_against_sql(docs, none, tmp_path):
    found = quality.assess(docs).toPandas()
    con = duckdb.connect()
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841
    theirs = con.sql(quality.ORACLE).df()
    plain = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    documents = plain.select("doc_id", "text").toPandas()  # noqa: F841
    theirs = con.sql(quality.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    ours = quality.assess(plain).toPandas().sort_values("doc_id").reset_index(drop=True)
    for c in theirs.columns:
        assert ours[c].astype("int64").tolist() == theirs[c].astype("int64").tolist(), c
    assert len(found) == len(ROWS) and quality.assess(none).count() == 0
    assert quality.keep(docs).columns == docs.columns
    total = {r.rule: r.failed for r in quality.ablations(quality.ledger(docs)).collect()}
    assert total["few_words"] == (found.n_words < 50).sum()


def test_quality_of_f_and_form_feeds(spark):
    texts = ["foo of elf", "fff word fff", "ff\nff\nelf\nff", "\f" + PASSAGE + "\f", " ".join(["word"] * 49) + "\f", "f", "\f\n\f", "of\x0b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    documents = df.toPandas()  # noqa: F841
    theirs = duckdb.connect().sql(quality.ORACLE).df().sort_values("doc_id")
    ours = quality.assess(df).toPandas().sort_values("doc_id")
    for c in theirs.columns:
        assert ours[c].astype("int64").tolist() == theirs[c].astype("int64").tolist(), c


def test_token_store(docs, none, tmp_path):
    library = Tokenizer.from_file(BYTE)
    manifest = token_store.write_store(docs, f"file://{tmp_path}/a", BYTE, rows_per_file=4)
    found = sorted(token_store.read_store(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((i for i, _, _ in ROWS), key=lambda i: (i is not None, i))
    want = Counter((i, zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes())) for i, t, _ in ROWS)
    assert Counter((r.doc_id, r.ids_crc32) for r in found) == want
    assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found])[:-1].tolist()
    assert [r.doc_id for r in token_store.read_store(manifest, [9]).collect()] == [9]
    assert token_store.read_store(token_store.write_store(none, f"file://{tmp_path}/b", BYTE)).count() == 0


def test_store_reads_only_its_frames_and_finds_damage():
    sink = io.BytesIO()
    writer = token_store.StoreWriter(sink, frame_bytes=8)
    for i in range(6):
        writer.add(i, np.full(5, i, "<u2").tobytes())
    writer.close()
    reader = token_store.StoreReader(io.BytesIO(sink.getvalue()))
    assert [(d, ids.tolist()) for d, _, ids in reader.documents({3})] == [(3, [3] * 5)] and reader.frames_read == 1
    broken = bytearray(sink.getvalue())
    broken[-9 - 12 + 8] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(token_store.StoreReader(io.BytesIO(bytes(broken))).documents())


def test_bpe_dp_equals_library(docs, none):
    import hashlib

    library = Tokenizer.from_file(BYTE)
    found = bpe_dp.encode_and_decode(docs, BYTE).collect()
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t, _ in ROWS]
    want = Counter((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()) for (i, _, _), x in zip(ROWS, ids, strict=True))
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == want
    assert bpe_dp.encode_and_decode(none, BYTE).count() == 0


def test_line_templates(spark, docs, none):
    lines = [(1, "Request 17 from alpha took a long time to be done today\nunique text that nobody else has at all here"), (2, "Request 99 from alpha took a long time to be done today\nanother line which is quite different from all others"), (3, "short one"), (4, "short one"), (None, "Request 5 from alpha took a long time to be done today"), (5, None)]
    df = spark.createDataFrame(lines, "doc_id long, text string")
    for limit in (10, -1):
        found = {r.doc_id: (r.text, r.dropped) for r in line_templates.drop_lines(df, "doc_id", broadcast_lines=limit).collect()}
        assert found[1][1] == [] and found[2][1] == [0] and found[None][1] == [0] and found[3][1] == found[4][1] == [] and found[5][0] is None
        assert found[2][0] == "another line which is quite different from all others"
    found = {r.doc_id: r.n_dropped for r in line_templates.deduplicated(docs).collect()}
    assert found[6] == 0 and found[8] == 1 and found[12] == 1
    assert line_templates.deduplicated(none).count() == 0


def slow_templates(rows):
    """doc_id -> dropped line numbers, by comparing all pairs of masked lines."""
    own = {}
    for doc_id, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            tokens = tuple("<*>" if re.search("[0-9]", w) else w for w in W.findall(line))
            if len(tokens) >= 3 and set(tokens) != {"<*>"}:
                own.setdefault(tokens, []).append((doc_id, i))
    lines = sorted(own)
    label = {x: x for x in lines}

    def linked(a, b):
        if len(a) != len(b) or a[:3] != b[:3]:
            return False
        edges, vary = line_templates.stretches(len(a))
        return vary > 0 and sum(a[i:j] != b[i:j] for i, j in zip(edges, edges[1:])) <= vary

    pairs = [(a, b) for a in lines for b in lines if a < b and linked(a, b)]
    while any(label[a] != label[b] for a, b in pairs):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    found = {doc_id: [] for doc_id, _ in rows}
    for root in set(label.values()):
        places = [x for line in lines if label[line] == root for x in own[line]]
        ids = {i for i, _ in places}
        if len(ids) > 1 and (len(root) >= 8 or len(ids) >= 10):
            keeper = min(i for i in ids if i is not None)
            for doc_id, i in places:
                if doc_id != keeper:
                    found[doc_id].append(i)
    return {k: sorted(v) for k, v in found.items()}


@pytest.mark.parametrize("n", [10, 500, 513, 5000])
def test_a_template_of_any_size(spark, n):
    names = [f"{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}ma" for i in range(n)]
    df = spark.createDataFrame([(i, f"Thanks for contacting {name} about the order you placed") for i, name in enumerate(names)], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in line_templates.deduplicated(df).collect()} == {i: int(i > 0) for i in range(n)}


def test_templates_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    word = lambda k: chr(97 + int(rng.integers(0, k)))
    rows = []
    for i in range(160):
        lines = [" ".join([*"abc"[: 3 if rng.random() < 0.9 else 2], *(word(4) for _ in range(int(width) - 3))]) for width in rng.choice([3, 4, 5, 6, 8, 9, 11, 15, 21], 3)]
        rows.append((None if i % 40 == 7 else i // 2, "\n".join([*lines, "x 17 y", "12 13 14", "a b"])))
    rows += [(1000 + i, f"short line here number {'x' if i % 2 else 'y'}") for i in range(9)] + [(1000, "short line here number z\nshort line here number y")]
    rows += [(2000 + i, f"just ten documents have word{chr(97 + i)}") for i in range(10)]
    both: dict = {}
    for doc_id, text in rows:  # rows of one doc_id are one document; the brute force takes them as one text
        both.setdefault(doc_id, []).append(text)
    ids = [k for k in both if len(both[k]) == 1]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = slow_templates([(k, "\n".join(v)) for k, v in both.items()])
    for limit, hot in ((10**6, 4096), (-1, 4096), (10**6, 3)):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        monkeypatch.setattr(common, "HOT_KEYS", 1 << 30)
        found: dict = {}
        for r in line_templates.drop_lines(df, "doc_id", broadcast_lines=limit).collect():
            found.setdefault(r.doc_id, []).append(r.dropped)
        assert {k: found[k][0] for k in ids} == {k: want[k] for k in ids}
        assert {k: sum(map(len, v)) for k, v in found.items()} == {k: len(v) for k, v in want.items()}
    assert want[1000] == [] and want[2009] == [0] and sum(map(len, want.values())) > 50


def test_support_counts_documents(spark):
    lines = [f"Please call back mister {chr(97 + i)}x" for i in range(9)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, lines[0])], "doc_id long, text string")
    assert [r.n_dropped for r in line_templates.deduplicated(df).collect()] == [0, 0]


def slow_fingerprint(text):
    words = W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    labels = list(range(len(fps)))
    while True:
        new = [min(labels[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(fps))]
        if new == labels:
            return labels
        labels = new


def test_simhash(docs, none):
    found = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in found) == Counter((i, f"{slow_fingerprint(t):016x}") for i, t, _ in ROWS)
    fps = [slow_fingerprint(t) for _, t, _ in ROWS]
    roots = slow_components(fps)
    least = {}
    for (i, _, _), root in zip(ROWS, roots, strict=True):
        least[root] = min(least.get(root, 1 << 60), 1 << 60 if i is None else i)
    want = Counter((i, None if least[root] == 1 << 60 else least[root]) for (i, _, _), root in zip(ROWS, roots, strict=True))
    assert Counter((r.doc_id, r.component_id) for r in found) == want
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))
    assert simhash.near_duplicates(none).count() == 0 and simhash.representatives(none).count() == 0


def test_links_in_crowded_buckets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centers = rng.integers(-(1 << 63), 1 << 63, 40, dtype=np.int64)
    fps = {int(c) for c in centers}
    for c in centers[:3]:
        for _ in range(150):
            x = int(c)
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(b)
            fps.add(simhash.signed(x & (1 << 64) - 1))
    monkeypatch.setattr(simhash, "CROWDED", 32)
    from lamina.llm.components import components

    folder, values = common.scratch(spark), sorted(fps)
    found = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(x,) for x in values], "fp long"), folder), folder).collect()}
    roots = slow_components([x & (1 << 64) - 1 for x in values])
    assert [found.get(x, x) for x in values] == [values[r] for r in roots]


def test_language_id(docs, none):
    found = {r.doc_id: r for r in langid.held_out_identification(docs).collect() if r.doc_id != 8}
    assert found[2].lang_pred == found[3].lang_pred == found[4].lang_pred == "und" and not found[3].accepted
    assert all(0 <= r.score <= 1 for r in found.values())
    assert langid.held_out_identification(none).count() == 0
    classifier = langid.Classifier({"de": langid.letters_of("der schnelle fuchs läuft " * 30), "en": langid.letters_of("the quick brown fox runs " * 30)})
    assert classifier.predict("The brown fox runs quick")[0] == "en" and classifier.predict("Der Fuchs läuft")[0] == "de"


def test_language_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.held_out_identification(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.97


def test_sharding(spark, docs, none):
    path = f"{common.scratch(spark)}/map"
    sharding.start(spark, path, shards=3)
    found = sharding.shard(docs, path, shards=3).toPandas()
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter(zip([None if x != x else int(x) for x in found.doc_id], found["size"], found.text_crc32, strict=True)) == Counter((i, len((t or "").encode()) + 1, crc(t)) for i, t, _ in ROWS)
    assert Counter(found["size"]) == Counter(len((t or "").encode()) + 1 for _, t, _ in ROWS)
    assert all(sorted(g) == list(range(len(g))) for _, g in found.groupby("shard").slot)
    table, path = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), f"{common.scratch(spark)}/map"
    sharding.start(spark, path, shards=8)
    placed = sharding.shard(table, path).toPandas()
    sizes = placed.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() < 0.05 * sizes.mean() and placed.map_version.eq(2).all()
    # the stored map is what places the rows, and the slot is a function of the row alone
    stored = sharding.SlotMap.load(spark, path)
    assert len(stored.versions) == 2 and (stored.current[placed.vslot] == placed["shard"]).all()
    weights = np.bincount(placed.vslot, placed["size"], sharding.SLOTS)
    assert (sharding.SlotMap.initial(8).rebalance(weights).current == stored.current).all()
    again = sharding.shard(table, path).toPandas()
    assert again.map_version.eq(2).all() and again.sort_values("doc_id").reset_index(drop=True).equals(placed.sort_values("doc_id").reset_index(drop=True))
    more = sharding.shard(table, path, shards=9).toPandas().merge(placed, on="doc_id", suffixes=("", "_old"))
    grown = sharding.SlotMap.load(spark, path)
    assert len(grown.versions) >= 3 and grown.shards == 9 and more["shard"].nunique() == 9
    assert (more.vslot == more.vslot_old).all() and (more["shard"] == more.shard_old).mean() > 0.7
    assert sharding.shard(none, path, shards=9).count() == 0
    weights = np.random.default_rng(0).integers(1, 100, 4096).astype(float)
    old = sharding.SlotMap.initial(8).rebalance(weights)
    new = old.grow(weights, 9)
    moved = old.current != new.current
    assert (new.current[moved] == 8).all() and new.loads(weights).std() < 0.02 * weights.sum() / 9
    path = f"{common.scratch(spark)}/map"
    old.save(spark, path)
    assert (sharding.SlotMap.load(spark, path).current == old.current).all()


def check_packing(pieces, texts):
    library = Tokenizer.from_file(WORD)
    sequences = pieces.groupby("sequence_id").length.sum()
    assert all(n == 4096 or n & (n - 1) == 0 for n in sequences) and (sequences <= 4096).all()
    ordered = pieces.sort_values(["sequence_id", "offset"])
    assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all()
    for doc_id, text in texts:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        own = pieces[pieces.doc_id == doc_id].sort_values("start")
        assert own.start.tolist() == np.cumsum([0, *own.length])[:-1].tolist() and own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()


def test_packing(spark, docs, none):
    pieces = packing.pack(docs, WORD).toPandas()
    check_packing(pieces, [(i, t) for i, t, _ in ROWS if i not in (None, 8)])
    assert packing.pack(none, WORD).count() == 0
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_packing(packing.pack(table, WORD).toPandas(), table.select("doc_id", "text").limit(60).collect())


def test_column_generation_reaches_the_bound():
    demand = {45: 97, 36: 610, 31: 395, 14: 211}
    plan = packing.patterns(demand, 100)
    used = Counter()
    for pattern, times in plan:
        assert sum(s * n for s, n in pattern.items()) <= 100
        for s, n in pattern.items():
            used[s] += n * times
    assert dict(used) == demand and sum(t for _, t in plan) <= 455


def test_pipeline_stages(spark, docs, none):
    import corpus_pipeline

    for table in (docs, none, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            before = now
            now = common.written(stage(spark, now, ""), name)
            if name != "packing":
                assert now.columns == corpus_pipeline.COLUMNS and now.count() <= before.count()
        assert now.agg({"length": "sum"}).first()[0] == (before.count() and now.select("doc_id", "doc_tokens").distinct().agg({"doc_tokens": "sum"}).first()[0] or None)
