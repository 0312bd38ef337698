"""Token ids of whole texts, by the `tokenizers` library.

A tokenizer that drops white space and never looks across it gives the ids of a
text piece by piece: those between ASCII white space. Each distinct piece is encoded
by the library once and kept in a bounded table; texts are then put together from it.
`Encoder` uses that path only for tokenizers that say they work so, and encodes
whole texts with the library otherwise.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from casewatch.llm.buffers import Texts, ragged

KEPT_PIECES = 1 << 18
ENCODED_BYTES = 1 << 20  # of texts that are put together at a time
MARKS = b".,;:!?"


def default_path() -> str:
    """The word-end vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=None)
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes that end a Latin letter, bytes that only such letters are made of, closing marks."""
    ascii_letters = [*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]
    second = [b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]  # after 0xC3; those two are signs
    ends, letters, marks = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
    ends[ascii_letters + second] = True
    letters[ascii_letters + second + [0xC3]] = True
    marks[list(MARKS)] = True
    return ends, letters, marks


@lru_cache(maxsize=None)
def _byte_level() -> np.ndarray:
    """Code points that stand for the bytes of lower-cased Latin letters in byte-level vocabularies."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    table = np.arange(256, dtype=np.uint16)
    for b in range(0x80, 0xC0):
        small = b + 0x20 if b < 0x9F else b  # the second byte of a capital lies 0x20 below that of its small letter
        table[b] = small if small in printable else 256 + others.index(small)
    table[ord("A") : ord("Z") + 1] += 0x20
    return table


class Encoder:
    """Ids of texts; one per Python worker."""

    _loaded: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        size = max(max(said["model"]["vocab"].values()) + 1, self.tokenizer.get_vocab_size())
        self.width = 2 if size <= 1 << 16 else 4
        suffix = said["model"].get("end_of_word_suffix")
        self.by_piece = bool(suffix) and _drops_white_space(said)
        if self.by_piece:
            self.ends = np.zeros(size + 1, bool)
            self.ends[[i for token, i in said["model"]["vocab"].items() if token.endswith(suffix)]] = True
            # The same model for words that are already lower-case letters in byte-level form.
            self.letters = Tokenizer(self.tokenizer.model)
            self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.first, self.count, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each text start and end."""
        if not self.by_piece:
            said = self.tokenizer.encode_batch_fast(
                [texts.text(i).decode("utf-8", "replace") for i in range(len(texts))], add_special_tokens=False
            )
            counts = np.array([len(e.ids) for e in said], np.int64)
            ids = np.fromiter((i for e in said for i in e.ids), np.uint32, int(counts.sum()))
            return ids, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        start, end, single = self._pieces(texts)
        key = np.empty(len(start), np.uint64)
        # A word of Latin letters has the same ids in either case, so it is looked up in lower case.
        key[single] = texts.hashes(start[single], end[single], lower=True)
        length = (end - start)[~single]
        rest = Texts(texts.data[ragged(start[~single], length)], np.concatenate([[0], np.cumsum(length)]))
        key[~single] = rest.hashes(rest.offsets[:-1], rest.offsets[1:])
        distinct, seen, where = np.unique(key, return_index=True, return_inverse=True)
        slot = self._slots(texts, distinct, start[seen], end[seen], single[seen])[where]
        length = self.count[slot]
        ids = self.ids[ragged(self.first[slot], length)]
        ends = np.concatenate([[0], np.cumsum(length)])
        return ids, ends[np.searchsorted(start, texts.offsets)].astype(np.int64)

    def _pieces(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, closing marks after a Latin letter apart; and which are such letters only."""
        ends_letter, letters, marks = _classes()
        start, end, _ = texts.words()
        data = texts.data
        last = np.maximum.accumulate(np.where(marks[data], 0, np.arange(len(data))))[end - 1]
        before = data[np.maximum(last - 1, 0)]
        letter = ends_letter[data[last]] & ((data[last] < 0x80) | (before == 0xC3)) & (last >= start)
        cut = letter & (last + 1 < end)
        starts, ends = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        starts[start] = starts[last[cut] + 1] = True
        ends[end] = ends[last[cut] + 1] = True
        start, end = np.flatnonzero(starts), np.flatnonzero(ends)
        others = np.concatenate([[0], np.cumsum(~letters[data])])
        return start, end, others[end] == others[start]

    def _slots(self, texts: Texts, key, start, end, single) -> np.ndarray:
        """Where the table has each piece; pieces that it lacks are encoded first."""
        if len(self.keys) > KEPT_PIECES:
            self._clear()
        place = np.searchsorted(self.keys, key)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == key[known]
        for kind, encode in ((single, self._letters), (~single, self._others)):
            new = np.flatnonzero(~known & kind)
            if len(new):
                ids, counts = encode([texts.data[s:e].tobytes() for s, e in zip(start[new], end[new])])
                place = np.searchsorted(self.keys, key[new])
                self.keys = np.insert(self.keys, place, key[new])
                self.at = np.insert(self.at, place, len(self.count) + np.arange(len(new)))
                self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(counts) - counts])
                self.count = np.concatenate([self.count, counts])
                self.ids = np.concatenate([self.ids, ids])
        return self.at[np.searchsorted(self.keys, key)]

    def _letters(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of Latin letters, a few hundred in one call; a word ends with a token that ends words."""
        runs = [
            _byte_level()[np.frombuffer(b" ".join(words[at : at + 256]), np.uint8)].tobytes().decode("utf-16-le")
            for at in range(0, len(words), 256)
        ]
        said = self.letters.encode_batch_fast(runs, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in said])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return self._others(words)
        return ids, np.diff(ends, prepend=0)

    def _others(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        said = self.tokenizer.encode_batch_fast(
            [w.decode("utf-8", "replace") for w in words], add_special_tokens=False
        )
        counts = np.array([len(e.ids) for e in said], np.int64)
        return np.fromiter((i for e in said for i in e.ids), np.uint32, int(counts.sum())), counts


def _drops_white_space(said: dict) -> bool:
    """Whether white space only separates: each match of the splitting pattern lies within a piece.

    Holds where a pattern whose classes exclude white space picks the words, and the
    normalizers before it are those known to work on each piece by itself.
    """

    def steps(part, name):
        return part.get(name, [part]) if part else []

    splits = [s for s in steps(said.get("pre_tokenizer"), "pretokenizers") if s["type"] == "Split"]
    kept = [s for s in splits if s.get("invert") and s.get("behavior") == "Removed"]
    patterns = [s["pattern"].get("Regex", "") for s in kept]
    names = [s["type"] for s in steps(said.get("normalizer"), "normalizers")]
    split_to_bytes = [s["type"] for s in steps(said.get("pre_tokenizer"), "pretokenizers")] == ["Split", "ByteLevel"]
    own = {"NFC", "Lowercase", "Replace"}
    normal = all(
        s["type"] in own and (s["type"] != "Replace" or s["pattern"].get("Regex") == r"\s+" and s["content"] == " ")
        for s in steps(said.get("normalizer"), "normalizers")
    )
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in said.get("added_tokens", []))
    letters = all(r"[\p{L}]+" in p and r"[^\s" in p and " " not in p for p in patterns)
    return bool(patterns) and letters and normal and added and "Lowercase" in names and split_to_bytes
