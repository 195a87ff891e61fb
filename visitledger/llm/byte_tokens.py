"""Ids and token bytes by public tokenizer files, one coder for each file and Python worker.

A byte-level file gives its ids through `tiktoken`, built from the file's own vocabulary and its fixed split pattern; texts
that hold one of its special tokens go to the `tokenizers` library itself. Both give the same ids (tests compare them over
all of Unicode's planes in use); the first takes a quarter of the time.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from visitledger.llm.tokens import listed, strings

#: Fixed value: the split pattern of byte-level BPE files of this kind.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same without its look-ahead, which only matters where white space follows white space; it runs in a faster engine.
EVEN_SPLIT = SPLIT.replace(r"|\s+(?!\S)", "")
#: A text without any of these has single spaces and line ends only: other white space, or two of those in a row.
UNEVEN = ("  ", " \n", "\n ", "\n\n", *map(chr, (
    9, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Stands between the units of a text, which `rows` encodes once a column; texts that hold it are encoded whole.
UNIT_END = "\x01"
SPACE_MARK = "▁"


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from
    U+0100 on in their order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteCoder:
    """Byte-level BPE ids; `token_bytes[i]` are the bytes of id `i`."""

    def __init__(self, path: str):
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        if parts["normalizer"] or parts["pre_tokenizer"]["type"] != "ByteLevel" or parts["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level file without normalizer and prefix space is needed")
        self.path, self.special = path, [t["content"] for t in parts["added_tokens"]]
        as_byte = _byte_characters()
        vocabulary = {t: i for t, i in parts["model"]["vocab"].items() if t not in self.special}
        ranks = {bytes(as_byte[c] for c in t): i for t, i in vocabulary.items()}
        self.size = 1 + max([*ranks.values(), *(t["id"] for t in parts["added_tokens"])])
        self.token_bytes = [b""] * self.size
        for raw, i in ranks.items():
            self.token_bytes[i] = raw
        for t in parts["added_tokens"]:
            self.token_bytes[t["id"]] = t["content"].encode()
        self._lengths = lengths(self.token_bytes)
        self._uneven = "|".join(map(re.escape, (*UNEVEN, *self.special, UNIT_END)))
        self._any, self._even = (
            tiktoken.Encoding("byte-level", pat_str=split, mergeable_ranks=ranks, special_tokens={}) for split in (SPLIT, EVEN_SPLIT))

    @functools.cached_property
    def _library(self):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def plain(self, text: str) -> np.ndarray:
        """Ids with the strings of special tokens taken as ordinary text."""
        coder = self._any if any(u in text for u in UNEVEN) else self._even
        return coder.encode_to_numpy(text, disallowed_special=())

    def ids(self, text: str) -> np.ndarray:
        """Ids as the library gives them, special tokens recognised and none added."""
        if any(s in text for s in self.special):
            return np.array(self._library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        return self.plain(text)

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """`ids` of a column of UTF-8 texts, one row after the other, and where each row ends.

        Where white space is single, no match of the pattern reaches over the place before it: what lies between two such
        places is a unit, and each distinct unit is encoded once.
        """
        texts = strings(texts)
        whole = pc.match_substring_regex(texts, self._uneven).to_numpy(zero_copy_only=False)
        marked = texts.filter(pa.array(~whole))
        for blank in (" ", "\n"):
            marked = pc.replace_substring(marked, blank, UNIT_END + blank)
        ids, ends = listed(pc.split_pattern(marked, UNIT_END), self._unit_ids)
        if not whole.any():
            return ids, ends
        own = np.empty(len(texts), object)
        own[~whole] = [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        own[whole] = [self.ids(t) for t in texts.filter(pa.array(whole)).to_pylist()]
        return np.concatenate(own.tolist()), np.cumsum([len(o) for o in own])

    def _unit_ids(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each unit where its own begin and how many they are."""
        # Units that stay units beside others are encoded as one text, and told apart by their bytes.
        beside = pc.match_substring_regex(units, "(?s)^[ \n].").to_numpy(zero_copy_only=False)
        some = units.filter(pa.array(beside))
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), "")[0].as_py()
        parts = [self._even.encode_to_numpy(text, disallowed_special=())]
        bytes_at = np.cumsum(pc.binary_length(some).to_numpy(zero_copy_only=False).astype(np.int64))
        ends = np.searchsorted(np.cumsum(self._lengths[parts[0]]), bytes_at) + 1
        parts += [self._even.encode_to_numpy(u, disallowed_special=()) for u in units.filter(pa.array(~beside)).to_pylist()]
        size, begin = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        size[beside], size[~beside] = np.diff(ends, prepend=0), [len(p) for p in parts[1:]]
        begin[beside] = ends - size[beside]
        begin[~beside] = len(parts[0]) + np.cumsum(size[~beside]) - size[~beside]
        return np.concatenate(parts), begin, size


class PieceCoder:
    """Ids of a sentencepiece file; `token_bytes[i]` are the bytes of id `i`, a marked space as a space."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.token_bytes = [self._bytes(i) for i in range(self.size)]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace(SPACE_MARK, " ").encode()

    def batch(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@functools.cache
def byte_coder(path: str) -> ByteCoder:
    return ByteCoder(path)


@functools.cache
def piece_coder(path: str) -> PieceCoder:
    return PieceCoder(path)


def lengths(token_bytes: list[bytes]) -> np.ndarray:
    return np.array([len(t) for t in token_bytes], np.int64)
