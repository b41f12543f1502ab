"""Token ids of whole texts with a public tokenizer, a word at a time.

The word-end BPE drops white space and never merges across it, so a text's ids are those of its words in
a row. Arrow splits a batch at ASCII white space and numbers its words in one pass behind a bounded table of
those already met, and only new ones are taken apart and encoded. A word whose end is punctuation behind a letter
is two units, since the tokenizer parts them there before it merges, and ASCII words are met in lower
case; words that hold the text of a special token are left as they are.
"""

from __future__ import annotations

import string
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
# Distinct words a worker remembers before it drops the rarer ones; workers live on beside the heap from stage to stage.
REMEMBERED = 150_000
_MARKS = string.punctuation


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _steady(text: str) -> bool:
    """Whether lower case and NFC leave a letter at the end (not a mark, which would join what follows)."""
    return text.isascii() or (text[-1].lower().isalpha() and is_normalized("NFC", text))


class Remembered:
    """Distinct texts, their ids one after the other with the places between them, and how often each was looked for."""

    def __init__(self):
        self.texts, self.ids = pa.array([], pa.large_string()), np.zeros(0, np.uint32)
        self.bounds, self.often = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.texts)

    def find(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The number of each text, and the new ones among them, which are numbered on and must be added next."""
        coded = pa.concat_arrays([self.texts, texts]).dictionary_encode()
        numbers = coded.indices.to_numpy(zero_copy_only=False)[len(self):]
        often = np.bincount(numbers, minlength=len(coded.dictionary))
        often[:len(self)] += self.often
        self.often = often
        return numbers, coded.dictionary[len(self):]

    def add(self, texts: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> None:
        self.texts, self.ids = pa.concat_arrays([self.texts, texts]), np.concatenate([self.ids, ids])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + bounds[1:]])

    def trim(self, most: int) -> None:
        """Of more texts than so many, keep half as many, those looked for most often; older searches count half."""
        if len(self) > most:
            kept = np.sort(np.argpartition(-self.often[:len(self)], most // 2)[:most // 2])
            self.ids, self.bounds = _gathered(self.ids, self.bounds, kept)
            self.texts, self.often = self.texts.take(pa.array(kept)), self.often[kept] // 2


class WordEncoder:
    def __init__(self, path: str | None = None, remembered: int = REMEMBERED):
        import os

        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path or tokenizer_path())
        # for units of lower-case letters in NFC: nothing to normalise or to part, many in one call
        self.plain = Tokenizer.from_file(path or tokenizer_path())
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = [i for token, i in self.plain.get_vocab().items() if token.endswith("</w>")]
        self.ends_unit = np.zeros(self.plain.get_vocab_size() + 1, bool)
        self.ends_unit[ends] = True
        self.remembered = remembered
        self.words, self.units = Remembered(), Remembered()

    @staticmethod
    def _parted(words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """First and second unit of each word (the second may be empty): ASCII words by column, the others one by one."""
        special = pc.match_substring(words, "<|")
        easy = pc.and_not(pc.string_is_ascii(words), special)
        own = pc.if_else(easy, pc.ascii_lower(words), words)
        stems = pc.ascii_rtrim(own, characters=_MARKS)
        cut = pc.and_(easy, pc.and_(pc.not_equal(stems, own), pc.match_substring_regex(stems, "[a-z]$"))).to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(pc.and_not(pc.invert(easy), special).to_numpy(zero_copy_only=False))
        for k, whole in zip(rest, _listed(own.take(pa.array(rest))), strict=True):
            stem = whole.rstrip(_MARKS)
            cut[k] = bool(stem) and len(stem) < len(whole) and stem[-1].isalpha() and _steady(stem)
        heads = pc.if_else(pa.array(cut), stems, own)
        tails = np.full(len(words), "", object)
        where = np.flatnonzero(cut)
        if len(where):
            taken = pa.array(where)
            tails[where] = [o[len(h):] for o, h in zip(_listed(own.take(taken)), _listed(heads.take(taken)), strict=True)]
        return heads, pa.array(tails, pa.large_string())

    def _learn(self, words: pa.Array) -> None:
        heads, tails = self._parted(words)
        self.units.trim(self.remembered)
        numbers, fresh = self.units.find(pa.concat_arrays([heads, tails]))
        self.units.add(fresh, *self._encoded(_listed(fresh)))
        ids, bounds = _gathered(self.units.ids, self.units.bounds, numbers.reshape(2, -1).T.ravel())
        self.words.add(words, ids, bounds[::2])

    def _encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units and the places between them; the plain ones are encoded together."""
        plain = np.fromiter((u.isalpha() and (u.isascii() or u == u.lower() and is_normalized("NFC", u)) for u in units), bool, len(units))
        where, parts, sizes = np.flatnonzero(plain), [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(where), 500):
            text = " ".join([units[i] for i in where[at:at + 500]])
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            parts.append(ids)
            sizes.append(np.diff(np.flatnonzero(self.ends_unit[ids]), prepend=-1))
        rest = np.flatnonzero(~plain)
        if len(rest):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([units[i] for i in rest], add_special_tokens=False)]
            parts.append(np.fromiter(chain.from_iterable(found), np.uint32))
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        place = np.empty(len(units), np.int64)
        place[np.concatenate([where, rest])] = np.arange(len(units))
        return _gathered(np.concatenate(parts), bounds, place)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, the end id last; null counts as empty."""
        self.words.trim(self.remembered)
        lists = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
        numbers, fresh = self.words.find(lists.flatten())
        if len(fresh):
            self._learn(fresh)
        found = pa.LargeListArray.from_arrays(self.words.bounds, self.words.ids).take(pa.array(numbers))
        edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat, ends = found.values.to_numpy(), found.offsets.to_numpy()[edges]
        return [np.append(flat[a:b], np.uint32(END_ID)) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _listed(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist


def _gathered(ids: np.ndarray, bounds: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the numbered runs one after the other, and the places between them."""
    starts = bounds[numbers]
    sizes = bounds[numbers + 1] - starts
    places = np.concatenate([[0], np.cumsum(sizes)])
    return ids[np.repeat(starts - places[:-1], sizes) + np.arange(places[-1])], places


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder, kept between batches and tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def plain_ids(column) -> list:
    """A batch's ids as Python values, nulls as None (pandas turns a column with nulls to floats)."""
    return [None if i is None or i != i else (int(i) if isinstance(i, float) else i) for i in column.tolist()]


def pieces_of(texts, most_chars: int = 8_000_000):
    """(from, to) spans of a batch that hold about ``most_chars`` characters, at least one text each."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if i > start and held + size > most_chars:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)
