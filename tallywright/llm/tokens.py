"""Token ids of whole texts by the tokenizers library, with a memo of the words that a Python worker has met."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged

#: Strings that a Python worker remembers before it starts anew (some 60 MB), and bytes of text that are cut into words at a time.
MEMO, RUN = 300_000, 8_000_000
#: Normalizers that never look across white space, and the first cut of a tokenizer whose tokens hold no white space. Fixed values.
_WORDWISE = ("NFC", "Lowercase")
_SPACES = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
_CUT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
#: Letters whose lower case is one letter that composes with nothing before it, then marks: the tokenizer cuts between them.
_STEM = "^(?P<stem>[A-Za-zÀ-ÖØ-öø-įı-ſ]*)(?P<tail>[!-/:-@\\[-`{-~“”„«»…–—‘’]*)$"
_LETTERS = re.compile("[a-zß-öø-įı-ſ]+")
_PIECE = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")
_PLAIN = re.compile(r"[\x21-\x26\x28-\x7e]+")


@lru_cache(1)
def word_memo(path: str) -> WordMemo:
    """The memo of this Python worker: Spark hands several tasks to a worker, and they share it."""
    return WordMemo(path)


class WordMemo:
    """Encodes texts with the tokenizer of a file.

    Where the file's rules show that no token spans white space, a text is cut at ASCII white space and only strings that
    are not in the memo go to the library: of a word that is letters and then marks, both by themselves, else the word.
    Texts that hold the start of a special token, and all texts of other tokenizers, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        normal = rules["normalizer"] or {}
        steps = normal.get("normalizers", [normal])
        cuts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_word = all(s == _SPACES or s.get("type") in _WORDWISE for s in steps) and cuts[0] == _CUT and [c["type"] for c in cuts[1:]] == ["ByteLevel"] and rules["model"]["type"] == "BPE" and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
        self.starts = "|".join(sorted({re.escape(a["content"][:2]) for a in rules["added_tokens"]}))
        in_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.in_bytes = {i: in_bytes(chr(i))[0][0] for i in range(0x80, 0x180) if _LETTERS.fullmatch(chr(i))}
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.length = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _ids(self, key: str) -> list[int]:
        """Of a string of lower-case letters, of marks, or of a word."""
        if key.isascii():
            if key.isalpha() and key.islower():
                return [t.id for t in self.tok.model.tokenize(key)]
            low = key.lower()
            if _PLAIN.fullmatch(low):
                return [t.id for p in _PIECE.findall(low) for t in self.tok.model.tokenize(p)]
        elif _LETTERS.fullmatch(key):
            return [t.id for t in self.tok.model.tokenize(key.translate(self.in_bytes))]
        return self._whole(key)

    def _places(self, keys: pa.Array) -> np.ndarray:
        keys = keys.to_numpy(zero_copy_only=False)
        at = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(at < 0)
        if len(new):
            words = keys[new]
            ids = list(map(self._ids, words))
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            at[new] = np.arange(len(self.start), len(self.start) + len(new))
            self.known.update(zip(words, at[new].tolist(), strict=True))
            self.start = np.concatenate([self.start, np.cumsum(n) - n + len(self.flat)])
            self.length = np.concatenate([self.length, n])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))])
        return at

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each). The words are distinct."""
        if len(self.known) > MEMO:
            self._reset()
        cut = pc.extract_regex(words, _STEM)
        stem, tail = (pc.struct_field(cut, i) for i in (0, 1))
        stem = pc.coalesce(pc.utf8_lower(stem), words)  # what is not letters and marks is one string
        stem, tail = stem.dictionary_encode(), pc.fill_null(tail, "").dictionary_encode()
        at = np.stack([self._places(x.dictionary)[x.indices.to_numpy()] for x in (stem, tail)], 1)
        n = self.length[at]
        return self.flat[ragged(self.start[at].ravel(), n.ravel())], n.sum(1)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids of the texts one after another, number of ids of each), for runs of the texts in order."""
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(np.diff(size // RUN, prepend=0)) + 1 if len(texts) else []
        edges = np.unique(np.r_[0, cuts, len(texts)]).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield a, *self._run(texts.slice(a, b - a))

    def _run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            return self._each(texts.to_pylist())
        special = pc.match_substring_regex(texts, self.starts).to_numpy(zero_copy_only=False) if self.starts else np.zeros(len(texts), bool)
        if special.any():
            return self._mixed(texts, special)
        cut = pc.ascii_split_whitespace(texts)
        words = cut.flatten().dictionary_encode()
        ids, n = self._words(words.dictionary)
        first, at = np.cumsum(n) - n, words.indices.to_numpy()
        n = n[at]
        total = np.r_[0, np.cumsum(n)]
        return ids[ragged(first[at], n)], np.diff(total[cut.offsets.to_numpy()])

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(self._whole(t), np.int32) for t in texts]
        return np.concatenate([np.empty(0, np.int32), *ids]), np.array([len(x) for x in ids], np.int64)

    def _mixed(self, texts: pa.Array, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [(np.flatnonzero(~special), self._run(texts.filter(pa.array(~special)))), (np.flatnonzero(special), self._each(texts.filter(pa.array(special)).to_pylist()))]
        n, start, shift = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), 0
        for at, (ids, own) in parts:
            n[at], start[at] = own, np.cumsum(own) - own + shift
            shift += len(ids)
        return np.concatenate([p[1][0] for p in parts])[ragged(start, n)], n


def ended(ids: np.ndarray, n: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids with the end id behind them, as little-endian unsigned 32-bit integers, and their new numbers."""
    return np.insert(ids, np.cumsum(n), end_id).astype("<u4"), n + 1


def crcs(ids: np.ndarray, edges: np.ndarray) -> list[int]:
    """Unsigned CRC-32 of ids[edges[i] : edges[i + 1]] for each i; ids are little-endian unsigned 32-bit integers."""
    raw, at = memoryview(ids.tobytes()), (4 * edges).tolist()
    return [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
