"""Token ids of many texts by the tokenizers library, each distinct word encoded once.

A byte-level BPE vocabulary splits a text by a pattern before it merges, and a space after a character that is not
white space always starts a new match. So a text without white space before a space can be cut at its spaces,
and each part encoded on its own gives the same ids. Other texts, and vocabularies that normalise their input or
split otherwise, are encoded whole. Arrow's dictionary encoding finds the distinct parts, so the library sees each
once a batch, many in one call.

The ids are what the library gives for the file as it is: a special token's string in a text, such as ``<|endoftext|>``, becomes that
token's id (``add_special_tokens=False`` only adds none). Such texts are encoded whole. With ``plain`` its string is ordinary text.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that are encoded as one text, and characters that one call of the library encodes, unless one text is longer.
JOINED, CALL = 500, 1 << 18

#: White space before a space, or any white space that Arrow and the pattern may see differently.
UNSAFE = "[\t\n\x0b\x0c\r\x1c-\x1f ] |[\x1c-\x1f\u0085   -     　]"

_ENCODERS: dict[tuple[str, bool], Encoder] = {}


class Encoder:
    """Encodes arrays of texts with a tokenizer file, as the library does; ``plain``: special tokens' strings are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executors' cores are dealt out by Spark
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in spec.get("added_tokens") or []]  # found in a text before it is split
        self.by_parts = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.starts_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.starts_word[[i for token, i in self.tokenizer.get_vocab().items() if token[:1] == "\u0120"]] = True  # how byte-level vocabularies write a space

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; the library's own results, far larger than ids, live for ``CALL`` characters at a time."""
        out, start, size = [], 0, 0
        for k, text in enumerate(texts, 1):
            size += len(text)
            if size >= CALL or k == len(texts):
                out += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts[start:k], add_special_tokens=False)]
                start, size = k, 0
        return out

    def _spaced(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word with a space before it: all ids, and where each word's ids begin.

        Words without white space at their end are encoded many at a time, joined by spaces; an id whose token starts
        with a space then starts a word. The others are encoded one by one.
        """
        n = len(words)
        odd = pc.fill_null(pc.match_substring_regex(words, "[\t-\r ]$|^$"), False).to_numpy(zero_copy_only=False)
        plain = words.filter(pa.array(~odd)) if odd.any() else words
        cuts = np.unique(np.append(np.arange(0, len(plain), JOINED), len(plain))).astype(np.int32)
        texts = [" " + t for t in pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), plain), " ").to_pylist()] if len(plain) else []
        ids = np.concatenate([np.empty(0, np.uint32), *self._whole(texts)])
        begins = np.flatnonzero(self.starts_word[ids])
        if len(begins) != len(plain):
            raise ValueError("the vocabulary does not keep words apart")
        if not odd.any():
            return ids, begins
        rest = self._whole([" " + w for w in words.filter(pa.array(odd)).to_pylist()])
        where = np.empty(n, np.int64)
        sizes = np.empty(n, np.int64)
        where[~odd], sizes[~odd] = begins, np.diff(np.append(begins, len(ids)))
        sizes[odd] = [len(r) for r in rest]
        where[odd] = len(ids) + np.cumsum(sizes[odd]) - sizes[odd]
        ids = np.concatenate([ids, *rest])
        order = np.repeat(where - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return ids[order], np.cumsum(sizes) - sizes

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers; texts hold no nulls."""
        n = len(texts)
        safe = ~pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False) if self.by_parts and n else np.zeros(n, bool)
        for token in self.added if n else ():
            safe &= ~pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        out: list[np.ndarray | None] = [None] * n
        rest = np.flatnonzero(~safe)
        if len(rest):
            for i, ids in zip(rest, self._whole(texts.take(pa.array(rest)).to_pylist()), strict=True):
                out[i] = ids
        rows = np.flatnonzero(safe)
        if len(rows):
            lists = pc.split_pattern(texts if len(rows) == n else texts.take(pa.array(rows)), " ")
            ends = np.asarray(lists.offsets)
            ends = (ends[1:] - ends[0]).astype(np.int64)
            words = lists.flatten().dictionary_encode()
            codes = words.indices.to_numpy().astype(np.int64)
            firsts = np.concatenate([[0], ends[:-1]])
            opening = self._whole(words.dictionary.take(pa.array(codes[firsts])).to_pylist())
            flat, begins = self._spaced(words.dictionary)
            sizes = np.append(np.diff(np.append(begins, len(flat))), [len(o) for o in opening])
            begins = np.append(begins, len(flat) + np.cumsum(sizes[len(begins) :]) - sizes[len(begins) :])
            flat = np.concatenate([flat, *opening])
            codes[firsts] = len(words.dictionary) + np.arange(len(rows))
            taken = sizes[codes]
            upto = np.cumsum(taken)
            ids = flat[np.repeat(begins[codes] - (upto - taken), taken) + np.arange(upto[-1])]
            bounds = upto[ends - 1]
            for i, a, b in zip(rows, np.concatenate([[0], bounds[:-1]]), bounds, strict=True):
                out[i] = ids[a:b]
        return out


def encoder(path: str, plain: bool = False) -> Encoder:
    """The encoder of a tokenizer file, kept for the life of the process."""
    if (path, plain) not in _ENCODERS:
        _ENCODERS[path, plain] = Encoder(path, plain)
    return _ENCODERS[path, plain]
