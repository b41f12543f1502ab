"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood is the
sum over all ways to cut it into pieces, by a forward pass over its characters; a text's is the product
over its words (pieces never cross white space, a word starts with the word mark). Probabilities are learned
by expectation-maximisation: word counts of the training texts are a Spark table, each round is a pass that
adds up expected piece counts per language (languages x pieces numbers reach the driver).

Training reads the labelled texts of about ``SAMPLE`` documents a language, chosen by a hash of the id; that
bound is the only sample, every text is scored whole. Defined results: ``und`` with score 0 for null texts and
texts without a letter, and for all texts if nothing can be learned from; ties go to the smaller
language name; null languages are not learned from. Repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship
from .tokens import pieces_of, plain_ids, tokenizer_path

SAMPLE, ROUNDS, CHARS = 1000, 3, 2_000_000
# Share of the uniform distribution in a piece's probability, and the probability of a character outside the vocabulary.
SMOOTH, UNKNOWN = 0.01, 1e-7
_LETTER = re.compile(r"[^\W\d_]")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


class Pieces:
    """The vocabulary's text pieces, found in words by rolling hashes, for every length that pieces have."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.texts = list(map(model.id_to_piece, own))
        self.longest = max(map(len, self.texts))
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, _MULTIPLIER)]))
        hashes = np.array([self._hash(t) for t in self.texts], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.count = len(self.texts)

    @staticmethod
    def _hash(text: str) -> int:
        value = 0
        for c in text:
            value = (value * int(_MULTIPLIER) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return value

    def found(self, chars: np.ndarray) -> list[np.ndarray]:
        """For words of one length (a row each): per piece length, the piece number at every start, or ``count``."""
        words, n = chars.shape
        sums = np.zeros((words, n + 1), np.uint64)
        for i in range(n):
            sums[:, i + 1] = sums[:, i] * _MULTIPLIER + chars[:, i].astype(np.uint64) + np.uint64(1)
        out = []
        for size in range(1, min(self.longest, n) + 1):
            wanted = sums[:, size:] - sums[:, :n + 1 - size] * self.power[size]
            at = np.minimum(np.searchsorted(self.hashes, wanted), self.count - 1)
            out.append(np.where(self.hashes[at] == wanted, self.order[at], self.count))
        return out


def _prob(piece: np.ndarray, prob: np.ndarray, size: int) -> np.ndarray:
    """Probabilities of the pieces found; a character outside the vocabulary has a small one of its own."""
    p = prob[piece]
    return np.where((piece == len(prob) - 1)[:, None], UNKNOWN, p) if size == 1 else p


# From this length on a piece is rarely there, and only words that hold it are touched.
RARE = 6


def _forward(found: list[np.ndarray], prob: np.ndarray) -> np.ndarray:
    """Log likelihood (words x languages) over all segmentations."""
    words, n = found[0].shape
    alpha = np.zeros((n + 1, words, prob.shape[1]))
    alpha[0], scale = 1.0, np.zeros((words, prob.shape[1]))
    for j in range(1, n + 1):
        total = alpha[j]
        for size in range(1, min(len(found), j) + 1):
            piece = found[size - 1][:, j - size]
            if size < RARE:
                total += alpha[j - size] * _prob(piece, prob, size)
            else:
                some = np.flatnonzero(piece != len(prob) - 1)
                if len(some):
                    total[some] += alpha[j - size][some] * prob[piece[some]]
        if j % 16 == 0:
            top = total.copy()
            alpha[max(0, j - len(found)):j + 1] /= top
            scale += np.log(top)
    return np.log(alpha[n]) + scale


def _expected(found: list[np.ndarray], prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts (pieces x languages) of words with counts per language.

    The sums up to and from each place are kept as logarithms, so words of any length count.
    """
    (words, n), kinds = found[0].shape, prob.shape[1]
    ahead, behind = np.zeros((n + 1, words, kinds)), np.zeros((n + 1, words, kinds))

    def steps(place: int, start: int, size: int):
        """Words that hold a piece of this size at the start, with its probability and number."""
        piece = found[size - 1][:, start]
        some = np.arange(words) if size == 1 else np.flatnonzero(piece != len(prob) - 1)
        return some, _prob(piece[some], prob, size), piece[some]

    for j in range(1, n + 1):
        total = np.zeros((words, kinds))
        for size in range(1, min(len(found), j) + 1):
            some, p, _ = steps(j, j - size, size)
            total[some] += np.exp(ahead[j - size][some] - ahead[j - 1][some]) * p
        ahead[j] = ahead[j - 1] + np.log(total)
    out = np.zeros_like(prob)
    for i in range(n - 1, -1, -1):
        total, held = np.zeros((words, kinds)), []
        for size in range(1, min(len(found), n - i) + 1):
            some, p, piece = steps(i, i, size)
            step = np.exp(behind[i + size][some] - behind[i + 1][some]) * p
            total[some] += step
            held.append((some, step, piece))
        behind[i] = behind[i + 1] + np.log(total)
        share = np.exp(ahead[i] + behind[i + 1] - ahead[n]) * weight
        for some, step, piece in held:
            gained = share[some] * step
            for k in range(kinds):
                out[:, k] += np.bincount(piece, gained[:, k], len(prob))
    return out


def _by_length(words: list[str]):
    """(row numbers, code points) of marked words, those of one length together."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        for at in range(0, len(rows), max(1, 400_000 // int(size))):
            some = rows[at:at + max(1, 400_000 // int(size))]
            text = "".join(["▁" + words[i] for i in some])
            yield some, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), size)


def _words(texts: list[str | None]):
    """Distinct lower-case words of a batch, their numbers in a row, and where each text's words begin."""
    lists = pc.ascii_split_whitespace(pa.array([(t or "").lower() for t in texts], pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), edges


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of (lang, text) rows, written."""

    def run(batches):
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                texts = part["text"].tolist()
                for a, b in pieces_of(texts, CHARS):
                    distinct, index, _ = _words(texts[a:b])
                    yield pd.DataFrame({"lang": lang, "word": distinct, "n": np.bincount(index, minlength=len(distinct))})

    counted = docs.mapInPandas(run, "lang string, word string, n bigint").where("word <> ''")
    return cut_lineage(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE,
          rounds: int = ROUNDS, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages, and piece probabilities (pieces + 1 x languages, the last row 0) from (id, text, lang) rows."""
    ship(docs.sparkSession)
    path = path or tokenizer_path("piece_bpe_32k.model")
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    if not sizes:
        return [], np.zeros((1, 0))
    languages = sorted(sizes)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample / sizes[k]))])
    chosen = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share[F.col("lang")] * float(1 << 20)
    counts = word_counts(rows.where(chosen).select("lang", "text"))
    table = pieces(path)
    prob = np.full((table.count + 1, len(languages)), 1.0 / table.count)
    for _ in range(rounds):
        prob[-1] = 0.0
        now = docs.sparkSession.sparkContext.broadcast(prob)

        def gained(batches, now=now):
            own, total = pieces(path), np.zeros_like(now.value)
            number = {k: i for i, k in enumerate(languages)}
            for batch in batches:
                words = batch["word"].tolist()
                weight = np.zeros((len(words), len(languages)))
                weight[np.arange(len(words)), batch["lang"].map(number)] = batch["n"]
                for some, chars in _by_length(words):
                    total += _expected(own.found(chars), now.value, weight[some])
            piece, k = np.nonzero(total[:-1])
            yield pd.DataFrame({"piece": piece, "k": k, "n": total[piece, k]})

        sums = counts.mapInPandas(gained, "piece int, k int, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toPandas()
        fresh = np.zeros_like(prob)
        fresh[sums["piece"], sums["k"]] = sums["n"]
        fresh /= np.maximum(fresh.sum(axis=0), 1e-300)
        prob = (1 - SMOOTH) * fresh + SMOOTH / table.count
    prob[-1] = 0.0
    return languages, prob


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text: str = "text",
            path: str | None = None) -> DataFrame:
    """(id, lang_pred, score) of every whole text."""
    ship(docs.sparkSession)
    path = path or tokenizer_path("piece_bpe_32k.model")
    languages, prob = model
    shared = docs.sparkSession.sparkContext.broadcast(prob)

    def run(batches):
        own = pieces(path)
        for batch in batches:
            texts, ids = batch["text"].tolist(), plain_ids(batch["id"])
            for a, b in pieces_of(texts, CHARS):
                some = texts[a:b]
                distinct, index, edges = _words(some)
                scores = np.zeros((len(distinct), len(languages)))
                if languages:
                    for rows, chars in _by_length(distinct):
                        scores[rows] = _forward(own.found(chars), shared.value)
                sums = np.concatenate([np.zeros((1, len(languages))), np.cumsum(scores[index], axis=0)])
                total = sums[edges[1:]] - sums[edges[:-1]]
                known = [bool(languages) and bool(t) and _LETTER.search(t) is not None for t in some]
                if languages:
                    best = total.argmax(axis=1)
                    share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                yield pd.DataFrame({"id": pd.Series(ids[a:b], dtype=object),
                                    "lang_pred": [languages[best[i]] if k else "und" for i, k in enumerate(known)],
                                    "score": [float(share[i]) if k else 0.0 for i, k in enumerate(known)]})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
