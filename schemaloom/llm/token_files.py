"""Token ids as binary images: a concatenated id array with Elias-Fano coded document boundaries.

Documents are dealt out by ranges of ascending id (null ids last), encoded, and cut into images of about
``IMAGE_IDS`` ids. An image holds its ids as 16-bit numbers (32-bit where an id needs it) and two
Elias-Fano sequences, the ends of its documents and their ids: low bits packed, high bits as a unary bit
array with the place of every 64th set bit, so a boundary is found by select without a 64-bit table.
Images are written by Spark (with its commit of finished tasks) in the order (part, seq) and read back one
row at a time, so no image has to fit beside another.

Image format, little-endian: b"EFI1", id width in bytes, documents, null ids, ids, first id, byte length
of the ends and of the document ids; then these two sequences; then the ids. Sequence format: values,
low bits, byte length of low bits and high bits, samples; the low bits, the high bits, the samples (u32).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship
from .common import tasks
from .tokens import encoder, pieces_of, plain_ids, tokenizer_path

IMAGE_IDS = 2_000_000
EVERY = 64
_HEAD, _SEQ = struct.Struct("<4sBIIQqII"), struct.Struct("<QBIII")

IMAGE_SCHEMA = "part int, seq int, n_docs bigint, n_ids bigint, image binary"


class EliasFano:
    """A non-decreasing sequence of whole numbers from 0."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.count, self.low_bits, self.low, self.high, self.samples = count, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        width = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        lows = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        return cls(n, width, np.packbits(lows.ravel(), bitorder="little"), np.packbits(bits, bitorder="little"),
                   places[::EVERY].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return (_SEQ.pack(self.count, self.low_bits, len(self.low), len(self.high), len(self.samples))
                + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes())

    @classmethod
    def from_bytes(cls, data) -> EliasFano:
        n, width, low, high, samples = _SEQ.unpack_from(data)
        at = _SEQ.size
        return cls(n, width, np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low),
                   np.frombuffer(data, "<u4", samples, at + low + high))

    def _lows(self, first: int, last: int) -> np.ndarray:
        """Low parts of the values first to last - 1."""
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[a // 8:(b + 7) // 8], bitorder="little")[a % 8:a % 8 + b - a]
        return bits.reshape(-1, self.low_bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def select(self, i: int) -> int:
        """Value number i, reading from the sample before it."""
        place, missing = int(self.samples[i // EVERY]), i % EVERY
        at = place // 8
        skipped = place % 8
        while True:
            part = np.unpackbits(self.high[at:at + 64], bitorder="little")
            part[:skipped] = 0
            ones = np.flatnonzero(part)
            if missing < len(ones):
                return ((at * 8 + int(ones[missing]) - i) << self.low_bits) + int(self._lows(i, i + 1)[0])
            missing, at, skipped = missing - len(ones), at + 64, 0

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.count]
        return ((ones - np.arange(self.count)).astype(np.uint64) << np.uint64(self.low_bits)) + self._lows(0, self.count)


def build_image(doc_ids: list, docs: list[np.ndarray]) -> bytes:
    """Documents in ascending id order, null ids last."""
    known = [i for i in doc_ids if i is not None]
    first = known[0] if known else 0
    ends = EliasFano.encode(np.cumsum([len(d) for d in docs])).to_bytes()
    names = EliasFano.encode(np.array([i - first for i in known], np.uint64)).to_bytes()
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    kind = "<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4"
    head = _HEAD.pack(b"EFI1", int(kind[-1]), len(docs), len(docs) - len(known), len(ids), first, len(ends), len(names))
    return head + ends + names + ids.astype(kind).tobytes()


class Image:
    def __init__(self, data: bytes):
        magic, width, self.n_docs, self.nulls, self.n_ids, self.first, ends, names = _HEAD.unpack_from(data)
        if magic != b"EFI1":
            raise ValueError("not a token image")
        view, at = memoryview(data), _HEAD.size
        self.ends = EliasFano.from_bytes(view[at:at + ends])
        self.names = EliasFano.from_bytes(view[at + ends:at + ends + names])
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, at + ends + names)

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        a, b = self.span(i)
        return self.ids[a:b]

    def doc_ids(self) -> list:
        return [self.first + int(v) for v in self.names.decode()] + [None] * self.nulls


def images(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None,
           image_ids: int = IMAGE_IDS) -> DataFrame:
    """(part, seq, n_docs, n_ids, image) of all documents, ids ascending along (part, seq)."""
    ship(docs.sparkSession)
    path = path or tokenizer_path()
    order = F.col("id").asc_nulls_last()
    placed = (docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))
              .repartitionByRange(tasks(docs.sparkSession), order).withColumn("part", F.spark_partition_id())
              .sortWithinPartitions(order, F.col("text").asc_nulls_first()))

    def run(batches):
        encode = encoder(path).encode
        names, held, size, seq, part = [], [], 0, 0, 0

        def image():
            return pd.DataFrame({"part": [part], "seq": [seq], "n_docs": [len(held)], "n_ids": [size],
                                 "image": [build_image(names, held)]})

        for batch in batches:
            if not len(batch):
                continue
            part, texts = int(batch["part"].iloc[0]), batch["text"].tolist()
            own = plain_ids(batch["id"])
            for a, b in pieces_of(texts):
                for name, ids in zip(own[a:b], encode(texts[a:b]), strict=True):
                    names.append(name)
                    held.append(ids)
                    size += len(ids)
                    if size >= image_ids:
                        yield image()
                        names, held, size, seq = [], [], 0, seq + 1
        if held:
            yield image()

    return placed.mapInPandas(run, IMAGE_SCHEMA)


def write_images(docs: DataFrame, folder: str, **settings) -> None:
    images(docs, **settings).write.option("compression", "zstd").parquet(folder)


def read_documents(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents in the files; with ``ids`` the ids too."""
    ship(spark)
    files = spark.read.schema(IMAGE_SCHEMA).parquet(folder)
    sizes = files.groupBy("part", "seq").agg(F.sum("n_ids").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per task of the writer
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    bases = (sizes.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part")
             .select("part", "seq", (F.col("at") + F.col("base")).alias("base")))

    def run(batches):
        for batch in batches:
            for part, seq, data in zip(batch["part"], batch["seq"], batch["image"], strict=True):
                image = Image(data)
                ends = image.ends.decode().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                cut = [image.ids[a:b].astype("<u4").tobytes() for a, b in zip(starts, ends, strict=True)]
                frame = pd.DataFrame({"part": part, "seq": seq, "doc_id": pd.Series(image.doc_ids(), dtype=object),
                                      "start": starts, "n_tokens": ends - starts, "ids_crc32": [zlib.crc32(c) for c in cut]})
                if ids:
                    frame["ids"] = cut
                yield frame

    schema = "part int, seq int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if ids else "")
    rows = files.select("part", "seq", "image").mapInPandas(run, schema).join(bases, ["part", "seq"])
    return rows.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)
