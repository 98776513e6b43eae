"""Token ids of a public word BPE tokenizer, with a cache by pre-token.

The tokenizer puts a text into NFC and lower case, drops white space, cuts it into pre-tokens and merges bytes within each
of them, so that the ids of a text are those of its pre-tokens in order. Texts of the characters below U+0180 are cut here
by the same pattern, and each new pre-token goes to the tokenizer once; all other texts, and those that hold a special
token's string, go to it whole. Long texts are cut at blanks first, so that memory does not follow the longest text.
"""

from __future__ import annotations

import os
import re

import numpy as np

# The tokenizer's own pre-token pattern is 's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+ and these are
# its letters, numbers and blanks below U+0180, in lower case.
_LETTERS, _NUMBERS, _BLANKS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
PRETOKEN = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^{_LETTERS}{_NUMBERS}{_BLANKS}]+")
#: A text with other characters is not cut here.
FOREIGN = re.compile("[^\x00-\u017f]")
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: Pre-tokens kept by a worker, and characters of a text that are looked at together.
CACHE, CHUNK = 300_000, 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _new(self, words: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens, all from one call: blanks between them are dropped, and each is a word of its own again."""
        found = self.tok.encode(" ".join(words), add_special_tokens=False)
        ids, of = np.array(found.ids, "<u4").tobytes(), np.array(found.word_ids, np.int64)
        ends = (4 * np.searchsorted(of, np.arange(len(words)), side="right")).tolist()
        return {w: ids[a:b] for w, a, b in zip(words, [0, *ends], ends, strict=False)}

    def _part(self, text: str) -> bytes:
        if (not text.isascii() and FOREIGN.search(text)) or any(x in text for x in SPECIAL):
            return self._ids([text])[0]
        words, known = PRETOKEN.findall(text.lower()), self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        made = self._new(list({w for w in words if w not in known}))
        if len(known) + len(made) > CACHE:
            out = b"".join([known[w] if w in known else made[w] for w in words])
            known.clear()
            known.update(made)
            return out
        known.update(made)
        return b"".join([known[w] for w in words])

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if len(text) <= CHUNK:
            return self._part(text)
        out, at = [], 0
        while at < len(text):
            end = min(len(text), at + CHUNK)
            while end < len(text) and text[end] not in " \n\t\r":
                end += 1
            out.append(self._part(text[at:end]))
            at = end
        return b"".join(out)


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
