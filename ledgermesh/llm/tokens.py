"""Token ids of whole texts, from a tokenizers JSON file, at the speed of rank-based merging."""

from __future__ import annotations

import json
import os
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The split of byte-level vocabularies before merging (a fixed value).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_END, _MARK = "\x01", "\x02"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TextEncoder:
    """Ids equal to ``Tokenizer.encode(text, add_special_tokens=False).ids`` of the file at ``path``.

    Merging is done by tiktoken, which merges by the rank of the joined bytes.
    A vocabulary with word ends is expressed there with one more byte behind
    each word, which its first ranks join to the last character.  A word that
    holds that byte, a text that holds the string of an added token (in any case,
    where words are lowered), and every text of a tokenizer of another kind go
    through the tokenizers library itself.
    """

    def __init__(self, path: str, limit: int = 800_000):
        """limit: the number of distinct words that a worker remembers at most."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        size = len(self._tokens(spec["model"]["vocab"]).union(t["content"] for t in spec["added_tokens"]))
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.added_lower = pc.ascii_lower(pa.array(self.added, pa.string())).to_pylist()
        self.fast, self.words = self._ranks(spec)
        self.limit, self.cache = limit, {}
        if self.words is not None:
            mark = self._library(_MARK)
            self.mark = int(mark[0]) if len(mark) == 1 else -1

    @staticmethod
    def _tokens(vocab: dict | list) -> set[str]:
        return set(vocab) if isinstance(vocab, dict) else {token for token, _ in vocab}

    @cached_property
    def tok(self):
        """The library's own tokenizer, loaded by the first text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ranks(self, spec: dict):
        import tiktoken

        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        suffix = model.get("end_of_word_suffix")
        steps = pre.get("pretokenizers", [pre])
        byte, added = _byte_of(), {t["content"] for t in spec["added_tokens"]}
        if model["type"] != "BPE" or steps[-1].get("type") != "ByteLevel" or steps[-1].get("add_prefix_space"):
            return None, None
        words = None
        if suffix:
            if len(steps) != 2 or steps[0].get("behavior") != "Removed" or not steps[0].get("invert"):
                return None, None
            words = regex.compile(steps[0]["pattern"]["Regex"])
        elif len(steps) != 1 or not pre.get("use_regex") or spec["normalizer"]:
            return None, None
        ranks: dict[bytes, int] = {}
        for token, rank in model["vocab"].items():
            if token in added:
                continue
            end = bool(suffix) and token.endswith(suffix)
            raw = bytes(byte[c] for c in (token[: -len(suffix)] if end else token)) + (b"\x01" if end else b"")
            if raw in ranks:
                return None, None
            ranks[raw] = rank
        split = rf"[^{_END}\s]+{_END}" if suffix else BYTE_LEVEL
        return tiktoken.Encoding("ranks", pat_str=split, mergeable_ranks=ranks, special_tokens={}), words

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _ranked(self, text: str) -> np.ndarray:
        if self.words is not None:
            text = text.lower() if text.isascii() else self.tok.normalizer.normalize_str(text)
            text = self.words.sub(r"\g<0>" + _END, text)
        return self._merged(text)

    def _merged(self, text: str) -> np.ndarray:
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.dtype)

    def _learn(self, new: list[str]) -> None:
        """Encode words with a mark after each; what is ASCII apart, as it needs no normalisation, and letters alone need no split."""
        joined = "\n".join(new)
        if any(a in joined for a in (_END, _MARK, *self.added)):
            odd = [w for w in new if _END in w or _MARK in w or any(a in w for a in self.added)]
            new = list(set(new).difference(odd))
            self.cache.update((w, self._library(w).tobytes()) for w in odd)
        size = self.dtype.itemsize
        ascii_, other = [], []
        for w in new:
            (ascii_ if w.isascii() else other).append(w)
        letters, mixed = [], []
        for w in ascii_:
            (letters if w.isalpha() else mixed).append(w)
        for part in (letters, mixed, other):
            if part is letters:
                ids = self._merged(f"{_END} {_MARK}{_END} ".join([*part, ""]).lower())
            else:
                ids = self._ranked(f" {_MARK} ".join([*part, ""]))
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(part):
                self.cache.update((w, self._library(w).tobytes()) for w in part)
                continue
            raw, ends = ids.tobytes(), (ends * size).tolist()
            starts = [0, *[e + size for e in ends]]
            self.cache.update(zip(part, map(raw.__getitem__, map(slice, starts, ends))))

    def _encode_words(self, texts: list[str | None]) -> list[np.ndarray]:
        """White space separates words for good, so each distinct word is encoded once per worker."""
        flat = pc.ascii_lower(pa.array([t or "" for t in texts], pa.string()))
        # an added token counts in its own case only, which lowering hides: such texts go whole to the library
        whole: set[int] = set()
        for a in self.added_lower:
            whole.update(np.flatnonzero(pc.match_substring(flat, a).to_numpy(zero_copy_only=False)).tolist())
        if whole:
            rest = self._encode_words(["" if i in whole else t for i, t in enumerate(texts)])
            return [self._library(texts[i]) if i in whole else x for i, x in enumerate(rest)]
        flat = pc.replace_substring(flat, "\n", " ")
        cut = pc.split_pattern(flat, " ")
        coded = cut.flatten().dictionary_encode()
        seen = coded.dictionary.to_pylist()
        new = set(seen).difference(self.cache)
        if len(self.cache) + len(new) > self.limit:
            self.cache.clear()
            new = seen
        if new:
            self._learn(list(new))
        # the ids of the words in their order in the texts, as one run of bytes
        words = pa.array(list(map(self.cache.__getitem__, seen)), pa.large_binary()).take(coded.indices)
        _, offsets, data = words.buffers()
        ends = np.frombuffer(offsets, np.int64, len(words) + 1) // self.dtype.itemsize
        ids = np.frombuffer(data, self.dtype, int(ends[-1])) if ends[-1] else np.zeros(0, self.dtype)
        return np.split(ids, ends[cut.offsets.to_numpy()[1:-1]])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text (None: no ids), in ``dtype``."""
        if self.words is not None:
            return [x for i in range(0, len(texts), 2048) for x in self._encode_words(texts[i : i + 2048])]
        return [self._encode_bytes(t) for t in texts]

    def _encode_bytes(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, self.dtype)
        if self.fast is None or any(a in text for a in self.added):
            return self._library(text)
        return self._ranked(text)
