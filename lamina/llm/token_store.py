"""Operator 4: token ids in binary files of independent zstandard frames with a trailing seek table.

A file holds the documents of one range of ids, in ascending order:

    frame*          zstandard frames, each the ids of some whole documents as little-endian unsigned 16 or 32 bit
    index           a skippable frame: zstandard of JSON {"doc_ids", "n_tokens", "frames"} (a frame number for each document)
    seek table      a skippable frame as in the seekable format that zstandard's authors publish: for each frame its
                    compressed size, plain size and the low 32 bits of the XXH64 of its plain bytes; then the footer

A reader takes the footer and the two tables, then fetches and checks only the frames of the documents asked for.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import common
from lamina.llm.encoders import shared_encoder

#: Fixed values of the seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC, WITH_CHECKSUM = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

FRAME_BYTES = 1 << 18
#: Most rows and bytes of text of a file, unless one document has more.
ROWS_PER_FILE, BYTES_PER_FILE = 16_384, 64 << 20
MOST_FILES = 100_000
#: Stands for null ids where files are told apart.
LEAST_ID = -(1 << 63)


class StoreWriter:
    """Writes one file; keeps a frame's ids and the file's index in memory."""

    def __init__(self, sink, width: int = 2, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.sink, self.width, self.frame_bytes = sink, width, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.table, self.doc_ids, self.n_tokens, self.frames, self.parts, self.held = [], [], [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.n_tokens.append(len(ids) // self.width)
        self.frames.append(len(self.table))
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        import xxhash

        if self.parts:
            plain = b"".join(self.parts)
            packed = self.packer.compress(plain)
            self.sink.write(packed)
            self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            self.parts, self.held = [], 0

    def close(self) -> None:
        self.flush()
        index = self.packer.compress(json.dumps({"width": self.width, "doc_ids": self.doc_ids, "n_tokens": self.n_tokens, "frames": self.frames}).encode())
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        entries = b"".join(struct.pack("<III", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), WITH_CHECKSUM, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(entries) + len(footer)) + entries + footer)


class StoreReader:
    """Random access to one file. ``frames_read`` counts the frames that were decompressed."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpacker, self.frames_read = source, zstandard.ZstdDecompressor(), 0
        size = source.seek(0, 2)
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the end")
        self.table = list(struct.iter_unpack("<III", self._at(size - 9 - 12 * n, 12 * n)))
        self.starts = np.concatenate([[0], np.cumsum([x[0] for x in self.table], dtype=np.int64)]) if n else np.zeros(1, np.int64)
        at = int(self.starts[-1])
        kind, length = struct.unpack("<II", self._at(at, 8))
        if kind != SKIPPABLE_INDEX:
            raise ValueError("no index behind the frames")
        index = json.loads(self.unpacker.decompress(self._at(at + 8, length)))
        self.width, self.doc_ids, self.n_tokens, self.frames = (index[k] for k in ("width", "doc_ids", "n_tokens", "frames"))

    def _at(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        return self.source.read(length)

    def frame(self, k: int) -> bytes:
        import xxhash

        packed, plain, checksum = self.table[k]
        data = self.unpacker.decompress(self._at(int(self.starts[k]), packed), max_output_size=plain)
        self.frames_read += 1
        if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return data

    def documents(self, wanted: set | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the file, its ids) in file order; of ``wanted`` doc_ids only, if given."""
        before, current, data, offset = 0, -1, b"", 0
        dtype = f"<u{self.width}"
        for doc_id, n, k in zip(self.doc_ids, self.n_tokens, self.frames, strict=True):
            if k != current:
                current, data, offset = k, None, 0
            if wanted is None or doc_id in wanted:
                data = self.frame(k) if data is None else data
                yield doc_id, before, np.frombuffer(data, dtype, n, offset)
            offset += n * self.width
            before += n


def file_bounds(docs: DataFrame, rows_per_file: int, bytes_per_file: int) -> np.ndarray:
    """Ascending doc_ids at which a new file starts; one that occurs k times may be spread over k + 1 files.

    Fine quantiles of the ids are merged while rows and text bytes stay within a file's; at most MOST_FILES quantiles reach the driver.
    """
    n = docs.select("doc_id").count()
    fine = max(1, min(MOST_FILES, 8 * -(-n // rows_per_file)))
    ordered = docs.select(F.coalesce("doc_id", F.lit(LEAST_ID)).alias("doc_id"))  # nulls come first and may be many
    cuts = ordered.approxQuantile("doc_id", [i / fine for i in range(1, fine)], 1 / (8 * fine)) if fine > 1 else []
    cuts = np.sort(np.array(cuts, dtype=np.int64))
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    known = np.zeros((len(cuts) + 1, 2), np.int64)
    for r in docs.select(part_of("doc_id", "text", cuts).alias("part"), size.alias("size")).groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect():
        known[r.part] = r.n, r["size"]
    kept, held = [], np.zeros(2, np.int64)
    most = np.array([rows_per_file, bytes_per_file])
    for i, own in enumerate(known):
        if i and (held + own > most).any():
            kept.append(cuts[i - 1])
            held[:] = 0
        held += own
    return np.array(kept, np.int64)


def part_of(doc_id: str, text: str, cuts: np.ndarray) -> F.Column:
    """The number of the part between ``cuts`` that a row falls in; rows of an id (or without one) that is several cuts are spread over the parts around them, equal texts too."""

    @F.pandas_udf("int")
    def place(ids: pd.Series, salt: pd.Series) -> pd.Series:
        own = np.array([LEAST_ID if i is None else int(i) for i in ids], np.int64)
        low, high = np.searchsorted(cuts, own, side="left"), np.searchsorted(cuts, own, side="right")
        return pd.Series(np.where(high - low > 1, low + salt.to_numpy() % (high - low + 1), high).astype(np.int32))

    return place(F.col(doc_id).cast("string"), F.pmod(F.xxhash64(F.coalesce(text, F.lit("")), F.monotonically_increasing_id()), F.lit(1 << 30)))


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, rows_per_file: int = ROWS_PER_FILE, bytes_per_file: int = BYTES_PER_FILE) -> DataFrame:
    """Encodes whole texts (null: empty), appends ``end_id`` to each document and writes the files in ascending doc_id order.

    Returns the manifest: file_no int, path string, n_docs long, n_tokens long, start long (ids in all files before). It alone says which files count:
    each attempt of a task writes names of its own, and Spark commits the manifest rows of one attempt, so nothing is ever moved or overwritten.
    Null doc_ids come first; rows of equal doc_id follow each other, by their ids within a file (an id with more rows than a file takes several). A file
    holds at most some ``rows_per_file`` rows and ``bytes_per_file`` bytes of text, but always whole documents, so a longer text is a file's own. An empty table
    gives no file. Columns other than doc_id and text play no part. There are at most MOST_FILES files, so their bounds and the manifest fit the driver.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = file_bounds(docs, rows_per_file, bytes_per_file)
    files = len(cuts) + 1
    tail = np.array([end_id], "<u2").tobytes()

    def encode(batches):
        encoder = shared_encoder(tokenizer)
        for pdf in batches:
            yield pd.DataFrame({"file_no": pdf.file_no, "doc_id": pdf.doc_id, "ids": [encoder.encode(t) + tail for t in pdf.text]})

    def write(batches):
        current, fs, sink, writer, out = None, None, None, None, []

        def close():
            writer.close()
            sink.close()
            out.append((current, path, len(writer.doc_ids), sum(writer.n_tokens)))

        for pdf in batches:
            for file_no, doc_id, ids in zip(pdf.file_no.tolist(), pdf.doc_id, pdf.ids, strict=True):
                if file_no != current:
                    if writer is not None:
                        close()
                    fs, base = common.file_system(folder)
                    fs.create_dir(base, recursive=True)
                    name = f"tokens-{file_no:06d}-{uuid.uuid4().hex}.zst"
                    current, path, sink = file_no, f"{folder}/{name}", fs.open_output_stream(f"{base}/{name}", compression=None)
                    writer = StoreWriter(sink)
                writer.add(None if doc_id is None else int(doc_id), bytes(ids))
        if writer is not None:
            close()
        yield pd.DataFrame(out, columns=["file_no", "path", "n_docs", "n_tokens"])

    placed = common.text_batches(docs).select(part_of("doc_id", "text", cuts).alias("file_no"), common.id_text(), "text")
    encoded = common.id_long(placed.mapInPandas(encode, "file_no int, doc_id string, ids binary"))
    dealt = encoded.repartitionById(files, "file_no").sortWithinPartitions("file_no", F.col("doc_id").asc_nulls_first(), "ids").select("file_no", common.id_text(), "ids")
    manifest = common.written(dealt.mapInPandas(write, "file_no int, path string, n_docs long, n_tokens long"), "manifest", folder + "-index")
    rows, start, out = manifest.orderBy("file_no").collect(), 0, []
    for r in rows:
        out.append((*r, start))
        start += r.n_tokens
    return spark.createDataFrame(out, "file_no int, path string, n_docs long, n_tokens long, start long").repartition(max(1, len(out)))


def read_store(manifest: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """Reads a store back, or only the frames that hold ``doc_ids``.

    doc_id long, start long, n_tokens long, ids_crc32 long (of the ids as little-endian unsigned 32 bit), file string.
    """
    wanted = None if doc_ids is None else set(doc_ids)

    def read(batches):
        for pdf in batches:
            for path, start in zip(pdf.path, pdf.start, strict=True):
                fs, place = common.file_system(path)
                rows = []
                with fs.open_input_file(place) as source:
                    for doc_id, before, ids in StoreReader(source).documents(wanted):
                        rows.append((None if doc_id is None else str(doc_id), start + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), path.rpartition("/")[2]))
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", "file"])

    return common.id_long(manifest.select("path", "start").mapInPandas(read, "doc_id string, start long, n_tokens long, ids_crc32 long, file string"))
