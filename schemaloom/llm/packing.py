"""Packing examples into sequences: vector bin packing with the dot-product heuristic.

An example is a vector of shares of three limits: tokens, segments (pieces in one sequence) and
loss-bearing tokens (those after its prompt). The open sequence takes, of the examples that fit, the one
with the largest dot product with what is left; when none fits, the best one is cut so that a limit is
met exactly, and the rest of it waits. Examples longer than a sequence are cut into whole ones first.

Each task packs its own rows, a bounded number of waiting examples at a time, and leaves at most its last
sequence part-filled; nothing is shuffled. A sequence's id is the task's number and a count, so a task
that runs again gives the same ids. Defined results: null text is empty and has the end id only; repeated
rows are packed each; ids are null where doc_id is null; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import lean, ship
from .tokens import encoder, pieces_of, plain_ids, tokenizer_path

SEQUENCE, SEGMENTS, WAITING = 4096, 256, 1024
# Characters of text encoded at once (texts are never cut): a worker's memory follows this, not its rows.
CHARS = 2_000_000

SCHEMA = ("id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
          "loss_tokens bigint")


class Packer:
    """Packs the examples of one task; ``out`` collects (example, start, length, sequence, offset, loss)."""

    def __init__(self, first: int, tokens: int, segments: int, loss: int, waiting: int):
        self.limits = np.array([tokens, segments, loss], np.float64)
        self.most, self.last = waiting, first
        self.out: list[tuple] = []
        self.waiting: list[list] = []  # example, start, end, first loss-bearing position
        self._open()

    def _open(self) -> None:
        self.left, self.sequence, self.last = self.limits.copy(), self.last, self.last + 1

    def add(self, example, length: int, prompt: int = 0) -> None:
        at, whole = 0, int(self.limits[0])
        while length - at >= whole and at + whole - max(at, prompt) <= self.limits[2]:
            self.out.append((example, at, whole, self.last, 0, max(0, at + whole - max(at, prompt))))
            self.last, at = self.last + 1, at + whole
        if length > at:
            self.waiting.append([example, at, length, prompt])
        if len(self.waiting) >= self.most:
            self.pack(self.most // 2)

    def pack(self, until: int = 0) -> None:
        """Place waiting examples until only so many are left."""
        items, count = self.waiting, len(self.waiting)
        spans = np.array([[e - s, 1, max(0, e - max(s, p))] for _, s, e, p in items], np.float64).reshape(-1, 3)
        shares, alive = spans / self.limits, np.ones(len(items), bool)
        while count > until:
            if self.left[0] < 1 or self.left[1] < 1:
                self._open()
            score = shares @ (self.left / self.limits)
            fits = alive & (spans <= self.left).all(axis=1)
            if fits.any():
                best = int(np.where(fits, score, -1.0).argmax())
                self._place(items[best], items[best][2])
                alive[best] = False
                count -= 1
                continue
            best = int(np.where(alive, score, -1.0).argmax())
            _, s, e, p = items[best]
            # the longest head that keeps the limits; prompt tokens bear no loss
            head = int(min(self.left[0], max(0, p - s) + self.left[2], e - s))
            if head < 1:
                self._open()
                continue
            self._place(items[best], s + head)
            items[best][1] = s + head
            spans[best] = [e - s - head, 1, max(0, e - max(s + head, p))]
            shares[best] = spans[best] / self.limits
        self.waiting = [x for x, a in zip(items, alive, strict=True) if a]

    def _place(self, item: list, end: int) -> None:
        example, s, _, p = item
        loss = max(0, end - max(s, p))
        self.out.append((example, s, end - s, self.sequence, int(self.limits[0] - self.left[0]), loss))
        self.left -= [end - s, 1, loss]

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(examples: DataFrame, id_col: str = "doc_id", text: str = "text", prompt: str | None = None,
         tokens: int = SEQUENCE, segments: int = SEGMENTS, loss: int | None = None, waiting: int = WAITING,
         path: str | None = None, ids: bool = False) -> DataFrame:
    """One row per piece; with ``ids`` the piece's token ids too (little-endian unsigned 32 bit).

    ``prompt`` names a column whose tokens come before the text's and bear no loss.
    """
    ship(examples.sparkSession)
    path, most_loss = path or tokenizer_path(), loss or tokens
    kind = examples.schema[id_col].dataType.simpleString()
    schema = SCHEMA.format(id=kind) + (", ids binary" if ids else "")
    rows = examples.select(F.col(id_col).alias("id"), F.col(text).alias("text"),
                           (F.col(prompt) if prompt else F.lit(None).cast("string")).alias("prompt"),
                           F.spark_partition_id().cast("bigint").alias("task"))

    def run(batches):
        encode, packer = encoder(path).encode, None

        def drained():
            found = packer.taken()
            cut = [x[0][1][x[1]:x[1] + x[2]].astype("<u4").tobytes() for x in found]
            frame = pd.DataFrame({
                "id": pd.Series([x[0][0] for x in found], dtype=object),
                "start": [x[1] for x in found], "length": [x[2] for x in found],
                "ids_crc32": [zlib.crc32(b) for b in cut], "doc_tokens": [len(x[0][1]) for x in found],
                "sequence_id": [x[3] for x in found], "offset": [x[4] for x in found], "loss_tokens": [x[5] for x in found]})
            if ids:
                frame["ids"] = cut
            return frame

        for batch in batches:
            if packer is None and len(batch):
                packer = Packer(int(batch["task"].iloc[0]) << 32, tokens, segments, most_loss, waiting)
            texts, prompts, names = batch["text"].tolist(), batch["prompt"].tolist(), plain_ids(batch["id"])
            for a, b in pieces_of(texts, CHARS):
                heads = encode(prompts[a:b]) if prompt else [None] * (b - a)
                for name, head, own in zip(names[a:b], heads, encode(texts[a:b]), strict=True):
                    kept = own if head is None else np.concatenate([head[:-1], own])
                    packer.add((name, kept), len(kept), 0 if head is None else len(head) - 1)
                yield drained()
        if packer is not None:
            packer.pack()
            yield drained()

    return rows.mapInPandas(lean(run), schema).withColumnRenamed("id", id_col)
