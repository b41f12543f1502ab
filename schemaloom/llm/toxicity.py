"""Toxicity with a bidirectional gated recurrent network and attention pooling, trained in numpy.

A word's input is its own vector (words of the training vocabulary) beside the mean vector of its
character trigrams. Two gated recurrent layers read a window of words in either direction, attention weighs
their states, and a logistic unit scores the window. All overlapping windows of a text are scored (``STEP``
words apart, the last one at the end), and the text's score is its highest.

The network learns from at most ``SAMPLE`` labelled texts a class (by a hash of the id), of which at most
``SPANS`` evenly spread windows are kept; labels hold for texts, so each round learns from each text's
window with the highest score so far. Ids, sources, languages and labels are no inputs. Defined results:
null, empty and blank texts have the score of no words; without labels of both classes every score is the
share of toxic labels (0 without any). Labels count as toxic if any repeated row says so; null labels are
left out. Repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, lean, ship
from .tokens import pieces_of, plain_ids

WINDOW, STEP = 48, 24
SAMPLE, SPANS, ROUNDS, SEED = 1000, 16, 14, 11
# Chance that a word loses its word or character part while training, and weight decay times training texts.
DROPPED, DECAY = 0.3, 0.3
THRESHOLD = 0.3
WORDS, SEEN_IN, TRIGRAMS = 20_000, 4, 4096
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 12, 6, 8, 8
CHARS = 2_000_000


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


def _split(texts: list[str | None]):
    lists = pc.ascii_split_whitespace(pc.utf8_trim_whitespace(pa.array([(t or "").lower() for t in texts], pa.large_string())))
    coded = lists.flatten().dictionary_encode()
    edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return [w.strip(string.punctuation) for w in coded.dictionary.to_pylist()], coded.indices.to_numpy(zero_copy_only=False), edges


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers of all words (with a mark at either end) and where each word's begin."""
    coded = [f"^{w}$".encode() for w in words]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    data = np.frombuffer(b"".join(coded) + b"..", np.uint8).astype(np.uint64)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    each = ((data[:-2] << np.uint64(16)) | (data[1:-1] << np.uint64(8)) | data[2:]) * np.uint64(0x9E3779B97F4A7C15)
    own = np.maximum(sizes - 2, 1)
    starts = np.cumsum(sizes) - sizes
    at = np.repeat(starts - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
    return (each[at] >> np.uint64(64 - TRIGRAMS.bit_length() + 1)).astype(np.int64), np.cumsum(own) - own


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def init(words: int, seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    size, both = WORD_DIM + CHAR_DIM, 2 * HIDDEN
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    out = {"word": (0.1 * rng.standard_normal((words + 1, WORD_DIM))).astype(np.float32),
           "char": (0.1 * rng.standard_normal((TRIGRAMS, CHAR_DIM))).astype(np.float32),
           "attend": draw(both, ATTEND), "attend_b": np.zeros(ATTEND, np.float32), "query": draw(ATTEND, 1)[:, 0],
           "out": draw(both, 1)[:, 0], "out_b": np.zeros(1, np.float32)}
    out["word"][0] = 0
    for way in ("f", "b"):
        out |= {f"{way}_x": draw(size, 3 * HIDDEN), f"{way}_h": draw(HIDDEN, 3 * HIDDEN), f"{way}_c": np.zeros(3 * HIDDEN, np.float32)}
    return out


def _recur(p, way: str, projected: np.ndarray, mask: np.ndarray, keep: bool):
    """States of one direction from input projections (steps x windows x 3 gates): update, reset, new."""
    steps, count, n = *mask.shape, HIDDEN
    states, h = np.zeros((steps, count, n), np.float32), np.zeros((count, n), np.float32)
    kept = []
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        inner = h @ p[f"{way}_h"]
        gates = _sigmoid(projected[t, :, :2 * n] + inner[:, :2 * n])
        z, r = gates[:, :n], gates[:, n:]
        new = np.tanh(projected[t, :, 2 * n:] + r * inner[:, 2 * n:])
        m = mask[t][:, None]
        after = h + m * (1 - z) * (new - h)
        if keep:
            kept.append((t, h, z, r, new, inner[:, 2 * n:], m))
        states[t] = h = after
    return states, kept


def forward(p, tables: dict[str, np.ndarray], index: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows; index and mask are steps x windows, tables hold each distinct word's projection."""
    sides = [_recur(p, way, tables[way][index], mask, keep) for way in ("f", "b")]
    states = np.concatenate([s for s, _ in sides], axis=2)
    seen = np.tanh(states @ p["attend"] + p["attend_b"])
    score = np.where(mask > 0, seen @ p["query"], np.float32(-1e9))
    weight = np.exp(score - score.max(axis=0)) * mask
    weight /= np.maximum(weight.sum(axis=0), np.float32(1e-9))
    pooled = np.einsum("tbh,tb->bh", states, weight)
    logit = pooled @ p["out"] + p["out_b"][0]
    return (logit, (sides, states, seen, weight, pooled)) if keep else logit


def backward(p, tables, index, mask, cache, slope):
    """Gradients of sum(slope * logit): of the parameters, and of the tables of projections."""
    sides, states, seen, weight, pooled = cache
    g = {"out": pooled.T @ slope, "out_b": np.array([slope.sum()], np.float32)}
    d_pooled = slope[:, None] * p["out"]
    d_states = weight[:, :, None] * d_pooled
    d_weight = np.einsum("tbh,bh->tb", states, d_pooled)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["query"] = np.einsum("tba,tb->a", seen, d_score)
    d_seen = d_score[:, :, None] * p["query"] * (1 - seen ** 2)
    g["attend"] = np.einsum("tbh,tba->ha", states, d_seen)
    g["attend_b"] = d_seen.sum(axis=(0, 1))
    d_states = d_states + d_seen @ p["attend"].T
    n, d_tables = HIDDEN, {}
    for k, way in enumerate(("f", "b")):
        d_own, d_h = d_states[:, :, k * n:(k + 1) * n], np.zeros((mask.shape[1], n), np.float32)
        d_proj, d_u = np.zeros((*mask.shape, 3 * n), np.float32), np.zeros_like(p[f"{way}_h"])
        for t, h, z, r, new, inner, m in reversed(sides[k][1]):
            d_h = d_h + d_own[t]
            d_new = d_h * m * (1 - z) * (1 - new ** 2)
            d_z = d_h * m * (h - new) * z * (1 - z)
            d_r = d_new * inner * r * (1 - r)
            d_inner = np.concatenate([d_z, d_r, d_new * r], axis=1)
            d_proj[t] = np.concatenate([d_z, d_r, d_new], axis=1)
            d_u += h.T @ d_inner
            d_h = d_h * (1 - m * (1 - z)) + d_inner @ p[f"{way}_h"].T
        g[f"{way}_h"] = d_u
        table = np.zeros_like(tables[way])
        np.add.at(table, index.ravel(), d_proj.reshape(-1, 3 * n))
        d_tables[way] = table
    return g, d_tables


class Network:
    def __init__(self, p: dict[str, np.ndarray], vocabulary: list[str]):
        self.p, self.vocabulary = p, vocabulary
        self.number = {w: i for i, w in enumerate(vocabulary, 1)}

    def inputs(self, words: list[str]):
        numbers = np.fromiter((self.number.get(w, 0) for w in words), np.int64, len(words))
        grams, starts = trigrams(words)
        return numbers, grams, starts, np.diff(np.append(starts, len(grams)))

    def embed(self, numbers, grams, starts, sizes) -> np.ndarray:
        chars = np.add.reduceat(self.p["char"][grams], starts) / sizes[:, None] if len(starts) else np.zeros((0, CHAR_DIM))
        return np.concatenate([self.p["word"][numbers], chars], axis=1).astype(np.float32)

    def tables(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Projections of distinct words, with one more row for places behind a text's end."""
        return {w: np.concatenate([x @ self.p[f"{w}_x"] + self.p[f"{w}_c"], np.zeros((1, 3 * HIDDEN), np.float32)]) for w in ("f", "b")}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The highest window score of each text."""
        words, index, edges = _split(texts)
        tables = self.tables(self.embed(*self.inputs(words)))
        starts, owner = windows(np.diff(edges))
        best = np.full(len(texts), -np.inf)
        best[np.diff(edges) == 0] = self.p["out_b"][0]
        index = np.append(index, len(words))
        for at in range(0, len(starts), 2048):
            own = owner[at:at + 2048]
            place = np.arange(WINDOW)[:, None] + (starts[at:at + 2048] + edges[own])
            inside = place < edges[own + 1]
            logits = forward(self.p, tables, index[np.where(inside, place, len(index) - 1)], inside.astype(np.float32))
            np.maximum.at(best, own, logits)
        return _sigmoid(best)


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all overlapping windows of texts of so many words, and the text of each."""
    count = np.where(sizes > 0, 1 + -(-np.maximum(sizes - WINDOW, 0) // STEP), 0)
    owner = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return np.minimum(k * STEP, np.maximum(sizes[owner] - WINDOW, 0)), owner


def train(spans: list[list[str]], toxic: np.ndarray, rounds: int = ROUNDS, seed: int = SEED) -> Network:
    """Learn from texts given as lists of windows (blank-separated words)."""
    flat = [s for text in spans for s in text]
    owner = np.repeat(np.arange(len(spans)), [len(t) for t in spans])
    words, index, edges = _split(flat)
    text_of = np.repeat(owner, np.diff(edges))
    pairs = np.unique(index.astype(np.int64) * (len(spans) + 1) + text_of)
    seen = np.bincount(pairs // (len(spans) + 1), minlength=len(words))
    bad = np.bincount(pairs // (len(spans) + 1), toxic[pairs % (len(spans) + 1)], len(words))
    total, ill = {}, {}
    for w, n, b in zip(words, seen, bad, strict=True):
        total[w], ill[w] = total.get(w, 0) + int(n), ill.get(w, 0) + float(b)
    common = sorted((w for w, n in total.items() if n >= SEEN_IN and w), key=lambda w: (-total[w], w))[:WORDS]
    net, rng = Network(init(len(common), seed), common), np.random.default_rng(seed)
    # a word's first coordinate starts from how much more often toxic texts have it
    sums = np.array([float((toxic == 1).sum()), float((toxic == 0).sum())])
    odds = [np.log((ill[w] + 0.5) / (sums[0] + 1)) - np.log((total[w] - ill[w] + 0.5) / (sums[1] + 1)) for w in common]
    net.p["word"][1:, 0] = np.array(odds, np.float32)
    numbers, grams, starts, sizes = net.inputs(words)
    gram_of = np.repeat(np.arange(len(words)), sizes)
    index = np.append(index, len(words))
    place = np.arange(WINDOW)[:, None] + edges[:-1]
    inside = place < edges[1:]
    index, mask = index[np.where(inside, place, len(index) - 1)], inside.astype(np.float32)
    p, m1, m2, step = net.p, {}, {}, 0
    share = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum())) * len(toxic)
    for turn in range(rounds):
        tables = net.tables(net.embed(numbers, grams, starts, sizes))
        if turn:
            logit = np.concatenate([forward(p, tables, index[:, a:a + 4096], mask[:, a:a + 4096]) for a in range(0, len(flat), 4096)])
        else:
            logit = rng.random(len(flat))
        order = np.lexsort((-logit, owner))
        top = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
        clean = np.flatnonzero(toxic[owner] == 0)
        extra = rng.choice(clean, min(len(clean), len(top)), replace=False) if turn and len(clean) else clean[:0]
        chosen = rng.permutation(np.concatenate([top, extra]))
        for a in range(0, len(chosen), 64):
            some = chosen[a:a + 64]
            used, local = np.unique(index[:, some], return_inverse=True)
            used = used[used < len(words)]
            local = np.where(mask[:, some] > 0, local.reshape(WINDOW, -1), len(used))
            picked = np.isin(gram_of, used) if len(used) < len(words) else np.ones(len(grams), bool)
            own_sizes = sizes[used]
            own_starts = np.cumsum(own_sizes) - own_sizes
            own = (numbers[used], grams[picked], own_starts, own_sizes)
            x = net.embed(*own)
            # now without characters, now without words: neither may learn the texts by heart
            kept = np.repeat(rng.random((len(x), 2)) >= DROPPED, [WORD_DIM, CHAR_DIM], axis=1).astype(np.float32)
            kept[:, 0] = 1
            x = x * kept
            tables = net.tables(x)
            logit, cache = forward(p, tables, local, mask[:, some], keep=True)
            slope = ((_sigmoid(logit) - toxic[owner[some]]) * share[owner[some]] / len(some)).astype(np.float32)
            g, d_tables = backward(p, tables, local, mask[:, some], cache, slope)
            d_x = np.zeros_like(x)
            for way in ("f", "b"):
                d = d_tables[way][:-1]
                g[f"{way}_x"], g[f"{way}_c"] = x.T @ d, d.sum(axis=0)
                d_x += d @ p[f"{way}_x"].T
            d_x *= kept
            g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
            np.add.at(g["word"], own[0], d_x[:, :WORD_DIM])
            np.add.at(g["char"], own[1], np.repeat(d_x[:, WORD_DIM:] / own_sizes[:, None], own_sizes, axis=0))
            g["word"][0] = 0
            step += 1
            for k in p:
                grad = g[k] + DECAY / len(spans) * p[k]
                m1[k] = 0.9 * m1.get(k, 0) + 0.1 * grad
                m2[k] = 0.98 * m2.get(k, 0) + 0.02 * grad ** 2
                p[k] -= (0.01 * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.98 ** step)) + 1e-6)).astype(np.float32)
    return net


def spans_of(text: str | None) -> list[str]:
    """At most ``SPANS`` evenly spread windows of a text."""
    words = (text or "").split()
    starts, _ = windows(np.array([len(words)]))
    if len(starts) > SPANS:
        starts = starts[np.linspace(0, len(starts) - 1, SPANS).astype(int)]
    return [" ".join(words[s:s + WINDOW]) for s in starts]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
          sample: int = SAMPLE, rounds: int = ROUNDS) -> Network | float:
    """A network from labelled documents, or the share of toxic labels if they are not of both classes."""
    ship(docs.sparkSession)
    marks = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    marks = cut_lineage(marks.agg(F.max(F.col(label).cast("int")).alias("toxic")))
    sizes = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return float(sizes.get(1, 0) > 0)
    share = F.when(F.col("toxic") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    chosen = cut_lineage(marks.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * float(1 << 20)))

    def run(batches):
        for batch in batches:
            kept = [spans_of(t) for t in batch["text"]]
            yield pd.DataFrame({"id": plain_ids(batch["id"]), "toxic": batch["toxic"], "spans": kept})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")  # about 2 x sample ids
    kind = docs.schema[id_col].dataType.simpleString()
    got = rows.mapInPandas(lean(run), f"id {kind}, toxic int, spans array<string>").where("size(spans) > 0").collect()
    got.sort(key=lambda r: (str(r["id"]), r["spans"]))
    toxic = np.array([r["toxic"] for r in got], np.float32)
    if not 0 < toxic.sum() < len(toxic):
        return float(toxic.sum() > 0)
    return train([list(r["spans"]) for r in got], toxic, rounds)


def score(docs: DataFrame, model: Network | float, id_col: str = "doc_id", text: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted) of every whole text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model if isinstance(model, float) else (model.p, model.vocabulary))

    def run(batches):
        net = shared.value if isinstance(shared.value, float) else Network(*shared.value)
        for batch in batches:
            texts, ids = batch["text"].tolist(), plain_ids(batch["id"])
            for a, b in pieces_of(texts, CHARS):
                found = np.full(b - a, net) if isinstance(net, float) else net.scores(texts[a:b])
                yield pd.DataFrame({"id": pd.Series(ids[a:b], dtype=object), "score": found.astype(float),
                                    "predicted": (found >= threshold).astype(np.int32)})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(lean(run), f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def clean_rows(docs: DataFrame, model: Network | float, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, all columns as they are; nothing is shuffled."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model if isinstance(model, float) else (model.p, model.vocabulary))

    def run(batches):
        net = shared.value if isinstance(shared.value, float) else Network(*shared.value)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for a, b in pieces_of(texts, CHARS):
                found = np.full(b - a, net) if isinstance(net, float) else net.scores(texts[a:b])
                yield batch.slice(a, b - a).filter(pa.array(found < threshold))

    return docs.mapInArrow(lean(run), docs.schema)
