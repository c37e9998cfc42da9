"""Word-wise encoding with a given vocabulary file: the ids of the ``tokenizers`` library, with words cached."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD_VOCABULARY = "word_bpe_49k.json"
#: Fixed values of the vocabulary file: how it splits a lower-cased text, for code points to U+017F.
LETTER = "a-z\\u00aa\\u00b5\\u00ba\\u00df-\\u00f6\\u00f8-\\u017f"
NUMBER = "0-9\\u00b2\\u00b3\\u00b9\\u00bc-\\u00be"
SPACE = "\\t-\\r \\u0085\\u00a0"
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
#: How its tokens that end a word end.
WORD_END = "</w>"
#: Later code points, letters whose case is not one to one, and special tokens are left to the library.
ODD = re.compile("[^\\u0000-\\u012f\\u0131-\\u017e]|<\\|")


class WordEncoder:
    """``encode`` gives a text's ids as little-endian 32-bit numbers; at most ``cached`` words are held."""

    def __init__(self, path: str, cached: int = 500_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.cached, self.words = Tokenizer.from_file(path), cached, {}
        self.merger = Tokenizer.from_file(path)  # for words that are lower-cased and split already
        self.merger.normalizer = normalizers.Sequence([])
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def _whole(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _codes(self, new: list[str]) -> list[bytes]:
        """Ids of each of ``new``, encoded as one text and cut after the tokens that end a word."""
        ids = np.array(self.merger.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.uint32)
        ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
        if len(ends) != len(new) or ends[-1] != 4 * len(ids):
            return [self._whole(w) for w in new]
        raw = ids.astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if ODD.search(text):
            return self._whole(text)
        pieces, words = PIECES.findall(text.lower()), self.words
        try:
            return b"".join(map(words.__getitem__, pieces))
        except KeyError:
            if len(words) > self.cached:
                words.clear()
            new = sorted(set(pieces).difference(words))
            words.update(zip(new, self._codes(new), strict=True))
            return b"".join(map(words.__getitem__, pieces))


_encoders: dict[str, WordEncoder] = {}


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_VOCABULARY)


def encoder(path: str | None = None) -> WordEncoder:
    """One encoder a process and vocabulary file; by default the public word vocabulary of the place where it runs."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    path = path or word_vocabulary()
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def lengths(batches: Iterator[pa.RecordBatch], path: str | None, text: str = "text") -> Iterator[pa.RecordBatch]:
    code = encoder(path).encode
    for b in batches:
        yield pa.record_batch({"n_tokens": pa.array([len(code(t.as_py())) // 4 for t in b[text]], pa.int64())})
