"""Token ids of whole texts by an existing tokenizer file of the ``tokenizers`` library.

A text is cut into pieces at blanks and the different pieces of a block of texts into words by
the pattern in the tokenizer's own file; no token crosses either. Strings of added tokens, as
``<|endoftext|>``, are cut out first and have their own ids, as in the library by default. Each
task keeps the ids of the words that it meets, so the library sees a frequent word once. Pieces,
words and ids are Arrow arrays: what happens to every piece happens in one call for a block, and
Python handles only pieces that are more than letters and a mark. The ids are those of the whole
text.
"""

from __future__ import annotations

import gc
import json
import os
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from stockflow.llm.common import give_back

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

KEPT = 250_000  # words kept in one generation of the memory, some 40 bytes each
BLOCK = 1 << 22  # bytes of texts that are best given at once
_AT_ONCE = 4096  # words that the library gets at once

# White space that a blank or a line feed begins; each is found fast by its first character.
_ODD = re.compile(r" \s").search, re.compile(r"\n\s").search
_INNER = re.compile(r"(?= \S)")

#: The pattern of byte-level pre-tokenizers, a fixed value of that format.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


_MARKS = ".,;:!?"
_IS_MARK = np.isin(np.arange(256), np.frombuffer(_MARKS.encode(), np.uint8))
_MARK_AT = np.array([max(0, _MARKS.find(chr(c))) for c in range(256)])
_FIRST = "\n"  # before a piece that no blank precedes; after a blank, no piece begins with white space

_TEXT, _IDS = pa.large_string(), pa.large_binary()


def _parts(array: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """The offsets of a large string or binary array, and its bytes."""
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(1, np.int64), pa.py_buffer(b"")
    return np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1], data or pa.py_buffer(b"")


def _of_parts(offsets: np.ndarray, data: pa.Buffer) -> pa.Array:
    offsets = np.ascontiguousarray(offsets, np.int64)
    return pa.LargeBinaryArray.from_buffers(_IDS, len(offsets) - 1, [None, pa.py_buffer(offsets), data])


class Memory:
    """Ids by word, in two generations: what is not met again goes, so memory is bounded."""

    def __init__(self, learn: Callable[[pa.Array], pa.Array]):
        self.learn = learn
        self.new, self.old = pa.array([], _TEXT), pa.array([], _TEXT)
        self.new_ids, self.old_ids = pa.array([], _IDS), pa.array([], _IDS)

    def of(self, words: pa.Array) -> pa.Array:
        """The ids of each of ``words``, which are different."""
        if len(self.new) > KEPT:
            self.old, self.old_ids = self.new, self.new_ids
            self.new, self.new_ids = self.new[:0], self.new_ids[:0]
        at = pc.index_in(words, value_set=pa.concat_arrays([self.new, self.old]))
        at = pc.fill_null(at, -1).to_numpy()
        young = len(self.new)
        missing = words.take(np.flatnonzero(at < 0))
        learned = self.learn(missing)
        again = at[at >= young] - young
        parts = [self.new_ids, self.old_ids, learned]
        place = at.astype(np.int64)
        place[at < 0] = young + len(self.old) + np.arange(len(missing))
        ids = pa.concat_arrays(parts).take(pa.array(place))
        self.new = pa.concat_arrays([self.new, self.old.take(again), missing])
        self.new_ids = pa.concat_arrays([self.new_ids, self.old_ids.take(again), learned])
        return ids


class Encoder:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same for words that are normal, cut and free of added tokens already.
        self.of_words = Tokenizer.from_file(path)
        self.of_words.encode_special_tokens = True
        self.of_words.normalizer = normalizers.Sequence([])
        self.of_words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in config["added_tokens"]):
            raise ValueError(f"{path}: no rule is known for its added tokens")
        self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in config["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.at_added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split
        steps = config["pre_tokenizer"].get("pretokenizers", [config["pre_tokenizer"]])
        normal = [s["type"] for s in (config["normalizer"] or {}).get("normalizers", [])]
        if steps[0]["type"] == "ByteLevel" and steps[0]["use_regex"] and not steps[0]["add_prefix_space"] and not normal:
            self.lower, pattern = False, _BYTE_LEVEL
        elif steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and normal == ["NFC", "Replace", "Lowercase"]:
            self.lower, pattern = True, steps[0]["pattern"]["Regex"]
        else:
            raise ValueError(f"{path}: no rule is known for where its texts can be cut")
        self.words_of = regex.compile(pattern).findall
        # The library's tables of characters are not the ones of ``regex`` and Python.
        self.split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        # In a byte-level vocabulary each character of a token stands for one byte of the text.
        suffix = config["model"].get("end_of_word_suffix") or ""
        vocabulary = config["model"]["vocab"]
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token.removesuffix(suffix))
        self.pieces = Memory(self._word_ids)

    def _cut(self, texts: list[str]) -> pa.Array:
        """Lists of pieces between which no token reaches: at blanks, if those are dropped, else
        before a blank that a character other than white space follows. In that case a piece is
        named without its blank, and a piece that has none, as the first, has a mark instead."""
        if self.lower:
            # Each character on its own, so no final sigma.
            normal = (t if t.isascii() else unicodedata.normalize("NFC", t).replace("\u03a3", "\u03c3") for t in texts)
            return pc.split_pattern(pa.array([t.lower().replace("\n", " ") for t in normal], _TEXT), " ")
        odd = np.array([t[-1:].isspace() or any(found(t) for found in _ODD) for t in texts], bool)
        # A line feed that a character other than white space follows is a word alone.
        plain = [_FIRST + t.replace("\n", f" {_FIRST}\n {_FIRST}") for t, o in zip(texts, odd, strict=True) if not o]
        cut = pc.split_pattern(pa.array(plain, _TEXT), " ")
        if not odd.any():
            return cut
        split = [_INNER.split(texts[i]) for i in np.flatnonzero(odd)]
        named = [[p[1:] if p[0] == " " and (k or p[1:2].strip()) else _FIRST + p for k, p in enumerate(s) if p] for s in split]
        place = np.empty(len(texts), np.int64)
        place[np.flatnonzero(~odd)] = np.arange(len(cut))
        place[np.flatnonzero(odd)] = np.arange(len(cut), len(texts))
        return pa.concat_arrays([cut, pa.array(named, cut.type)]).take(pa.array(place))

    def _words(self, piece: str) -> list[str]:
        """What the pattern finds."""
        whole = piece if self.lower else piece[1:] if piece[:1] == _FIRST else " " + piece
        if piece.isascii():
            return self.words_of(whole)
        if self.lower:
            whole = self.tokenizer.normalizer.normalize_str(whole)
        return [word for word, _ in self.split.pre_tokenize_str(whole)]

    def _piece_ids(self, pieces: pa.Array) -> pa.Array:
        """The ids of each of some different pieces. Most are letters, perhaps with a mark after them."""
        offsets, data = _parts(pieces)
        flat = np.frombuffer(data, np.uint8)
        full = np.diff(offsets) > 0
        first, last = np.zeros((2, len(pieces)), np.uint8)
        first[full], last[full] = flat[offsets[:-1][full]], flat[offsets[1:][full] - 1]
        marked, starts = _IS_MARK[last], first == ord(_FIRST)
        core = pc.if_else(pa.array(marked), pc.utf8_slice_codeunits(pieces, 0, -1), pieces)
        if not self.lower:
            core = pc.if_else(pa.array(starts), pc.utf8_slice_codeunits(core, 1), core)
        letters = pc.utf8_is_alpha(core)
        if self.lower:  # else of a character whose lower case Python does not know
            letters = pc.and_(letters, pc.equal(pc.utf8_lower(core), core))
        letters = letters.to_numpy(zero_copy_only=False)
        alone, ahead, other = (np.flatnonzero(x) for x in (letters & ~marked, letters & marked, ~letters))
        words = core
        if not self.lower:
            words = pc.binary_join_element_wise(pc.if_else(pa.array(starts), "", " ").cast(_TEXT), core, pa.scalar("", _TEXT))
        n = len(words)
        pairs = np.stack([ahead, n + _MARK_AT[last[ahead]]], axis=1).ravel()
        found = [self._words(p) for p in pieces.take(other).to_pylist()]
        rest = pa.array([w for some in found for w in some], _TEXT)
        words = pa.concat_arrays([words, pa.array(list(_MARKS), _TEXT), rest])
        words = words.take(np.concatenate([alone, pairs, np.arange(n + len(_MARKS), len(words))])).dictionary_encode()
        made = self.pieces.of(words.dictionary).take(words.indices)
        # The words of a piece stand side by side, so their ids do.
        counts = np.concatenate([np.full(len(alone), 1), np.full(len(ahead), 2), np.array([len(x) for x in found], np.int64)])
        ends, data = _parts(made)
        made = _of_parts(ends[np.concatenate([[0], np.cumsum(counts)])], data)
        place = np.empty(n, np.int64)
        place[np.concatenate([alone, ahead, other])] = np.arange(n)
        return made.take(pa.array(place))

    def _word_ids(self, words: pa.Array) -> pa.Array:
        """By the library; a word's ids are those that make up its number of bytes."""
        asked, found = words.to_pylist(), []
        for start in range(0, len(asked), _AT_ONCE):
            some = asked[start : start + _AT_ONCE]
            found.append(np.array(self.of_words.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4"))
        ids = np.concatenate([np.zeros(0, "<u4"), *found])
        made = np.concatenate([[0], np.cumsum(self.n_bytes[ids])])
        offsets, _ = _parts(words)
        ends = np.searchsorted(made, offsets - offsets[0])
        if made[-1] != offsets[-1] - offsets[0] or (made[ends] != offsets - offsets[0]).any():
            raise ValueError("the tokens of a word do not have its number of bytes")
        return _of_parts(4 * ends, pa.py_buffer(ids.tobytes()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; give texts of ``BLOCK`` bytes at once, and of a few times as many at most.

        The arrays of a block go back to the system before the next one, and before other stages.
        """
        try:
            return self._encode(texts)
        finally:
            give_back()

    def _encode(self, texts: list[str]) -> list[bytes]:
        # Added tokens stand at the odd places.
        parts = [self.at_added(text) if any(t in text for t in self.added) else [text] for text in texts]
        cut = self._cut([stretch for found in parts for stretch in found[::2]])
        pieces = cut.flatten().dictionary_encode()
        ends, data = _parts(self._piece_ids(pieces.dictionary).take(pieces.indices))
        at = np.asarray(cut.offsets) - cut.offsets[0].as_py()
        ends, data = ends[at].tolist(), memoryview(data)
        out, row = [], 0
        for found in parts:
            n = len(found[::2])
            made = [data[ends[i] : ends[i + 1]] for i in range(row, row + n)]
            marks = [*(self.added[t] for t in found[1::2]), b""]
            out.append(b"".join(x for both in zip(made, marks, strict=True) for x in both))
            row += n
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def forget() -> None:
    """Drop the encoders of this worker with all they have met, and give freed pages back."""
    encoder.cache_clear()
    gc.collect()
    give_back()


def tokenizer_path(name: str) -> str:
    """Where the box keeps a public tokenizer; on a cluster, the path is the same on all executors."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
