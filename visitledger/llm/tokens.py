"""Token ids of words by a public tokenizer file, with a bounded memory of words in each Python worker.

The tokenizer used here splits at white space before anything else and drops it, so a text's ids are those of its
white-space separated words, one after the other (tests compare with the library on whole texts).

A word of letters that neither compose nor change their length in lower case is normalised and split here, by the file's own
pattern; its pieces are remembered too, and the library merges the bytes of unknown ones only. All other words, and files with
other rules, go to the library whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BREAK = "<|endoftext|>"
ID = np.dtype("<u2")
#: The rules that `PIECES` stands for.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
SUFFIX = "</w>"
#: Words that normalisation may change beyond lower case: with others than ASCII, Latin-1 letters and some punctuation; also
#: those that may hold a special token.
ODD = r"[^\x00-\x7f\x{a1}\x{a7}\x{ab}\x{bb}\x{bf}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}\x{2010}-\x{2027}]|<\|"
#: The file's pattern on the others, lower-cased.
PIECE = r"('s|'t|'re|'ve|'m|'ll|'d|[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+|[0-9]|[^ \t-\ra-z0-9\x{df}-\x{f6}\x{f8}-\x{ff}]+)"



def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of words as little-endian unsigned 16-bit integers. Unknown words are encoded together."""

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.cut = self.tokenizer.token_to_id(BREAK)
        self.limit = limit
        self.known: dict[bytes, bytes] = {}
        self.merger = self._merger(path)
        self.pieces: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}

    def _merger(self, path: str):
        """A tokenizer that merges the bytes of pieces with spaces between; None for a file with other rules."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        vocabulary, alphabet = parts["model"]["vocab"], pre_tokenizers.ByteLevel.alphabet()
        if (any(parts[k] != v for k, v in RULES.items()) or parts["post_processor"] is not None
                or parts["model"].get("end_of_word_suffix") != SUFFIX
                or not all(c in vocabulary and c + SUFFIX in vocabulary for c in alphabet)):
            return None
        self.closes = np.zeros(1 << 16, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith(SUFFIX)]] = True
        merger = Tokenizer.from_file(path)
        merger.no_truncation()
        merger.no_padding()
        merger.normalizer = normalizers.Sequence([])
        merger.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return merger

    def learn(self, words: set[bytes]) -> None:
        """Make `known` hold all of `words`; what it held before may go."""
        fresh = words.difference(self.known)
        if len(self.known) + len(fresh) > self.limit:
            self.known = {}
            fresh = set(words)
        some = list(fresh)
        ids, begin, size = self._word_ids(strings(some))
        raw, begin = ids.tobytes(), begin.tolist()
        for word, at, n in zip(some, begin, size.tolist()):
            self.known[word] = raw[2 * at:2 * (at + n)]

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of UTF-8 texts, one row after the other, and where each row ends."""
        return listed(pc.ascii_split_whitespace(strings(texts)), self._word_ids)

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each word where its own begin and how many they are."""
        odd = np.ones(len(words), bool)
        if self.merger:
            odd = pc.match_substring_regex(words, ODD).to_numpy(zero_copy_only=False)
        plain = pc.replace_substring_regex(pc.utf8_lower(words.filter(pa.array(~odd))), PIECE, r" \1")
        ids, ends = listed(pc.ascii_split_whitespace(plain), self._piece_ids)
        others, more = self._odd_ids(words.filter(pa.array(odd)).to_pylist())
        begin, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        size[~odd], size[odd] = np.diff(ends, prepend=0), more
        begin[~odd], begin[odd] = ends - size[~odd], len(ids) + np.cumsum(more) - more
        return np.concatenate([ids, others]), begin, size

    def _piece_ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        distinct = pieces.to_numpy(zero_copy_only=False).tolist()
        fresh = [p for p in distinct if p not in self.pieces]
        if len(self.pieces) + len(fresh) > self.limit:
            self.pieces, fresh = {}, distinct
        self.pieces[""] = b""
        fresh = [p for p in fresh if p]
        for start in range(0, len(fresh), 64):
            some = fresh[start:start + 64]
            ids = np.array(self.merger.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, ID)
            raw, at = ids.tobytes(), 0
            # A piece ends with the only id of it that has the suffix.
            for piece, end in zip(some, (2 * np.flatnonzero(self.closes[ids]) + 2).tolist(), strict=True):
                self.pieces[piece] = raw[at:end]
                at = end
        return joined(list(map(self.pieces.__getitem__, distinct)))

    def _odd_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids by the library on whole words, and how many each has."""
        fresh = [w for w in words if w not in self.odd]
        if len(self.odd) + len(fresh) > self.limit:
            self.odd, fresh = {}, words
        self.odd |= {w: self.encode(w.encode()) for w in fresh if "<|" in w}
        rest = [w for w in fresh if "<|" not in w]
        for start in range(0, len(rest), 256):
            some = rest[start:start + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([BREAK.join(some)], add_special_tokens=False)[0].ids, ID)
            raw, at = ids.tobytes(), 0
            for word, end in zip(some, np.append(np.flatnonzero(ids == self.cut), len(ids)).tolist(), strict=True):
                self.odd[word] = raw[2 * at:2 * end]
                at = end + 1
        ids, _, size = joined(list(map(self.odd.__getitem__, words)))
        return ids, size

    def encode(self, text: bytes) -> bytes:
        """Ids of one text straight from the library."""
        got = self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids
        return np.array(got, ID).tobytes()


def strings(texts: pa.Array | list[bytes]) -> pa.Array:
    """Texts of bytes, with replacement characters where those are not UTF-8."""
    raw = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace") for t in raw.to_pylist()], pa.string())


def joined(found: list[bytes], dtype: np.dtype = ID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids one after the other, where those of each item begin and how many they are."""
    size = np.fromiter(map(len, found), np.int64, len(found)) // dtype.itemsize
    return np.frombuffer(b"".join(found), dtype), np.cumsum(size) - size, size


def listed(lists: pa.Array, ids_of) -> tuple[np.ndarray, np.ndarray]:
    """The ids of lists of strings, and where each list's end; `ids_of` sees each string once."""
    coded = lists.flatten().dictionary_encode()
    ids, begin, size = ids_of(coded.dictionary)
    at = coded.indices.to_numpy()
    own = size[at]
    ends = np.cumsum(own)
    spread = ids[np.repeat(begin[at] - ends + own, own) + np.arange(int(own.sum()))]
    return spread, np.append(0, ends)[pc.list_value_length(lists).to_numpy().cumsum()]


_encoders: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One encoder for each file and Python worker; its memory of words lasts over tasks."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]
