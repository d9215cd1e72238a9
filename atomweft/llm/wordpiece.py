"""Exact, fast encoding with a tokenizer file through the tokenizers library.

Where the file's normaliser and pre-tokeniser are those of `WORDS`, they never join
characters across ASCII white space, so a text's ids are the ids of its words in a row. Words
repeat, hence a bounded cache from word to id bytes; a new Latin word goes through the
library's BPE model by pre-token, any other word through the library's whole encode(). With
any other file each whole text goes through encode().
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex

END_ID = 1
CACHE_WORDS = 700_000

#: Printable code points below U+0250 are unaffected by NFC and lower-cased alike everywhere.
_PLAIN = re.compile("[!-~\xa1-ɏ]+")
_PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


#: What a file must say for words to be encoded one by one: a fixed value.
WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": _PRE.pattern}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def by_words(path: str) -> bool:
    """Whether a tokenizer file encodes each word by itself, and its model has nothing random."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    return all(made.get(k) == v for k, v in WORDS.items()) and made["model"]["type"] == "BPE" and not made["model"].get("dropout") and all(t["special"] for t in made.get("added_tokens", []))


def _byte_letters() -> dict[int, str]:
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder(dict):
    """word (bytes) -> its ids as little-endian unsigned 16-bit (32-bit beyond 65,536 ids)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4")
        self.end = np.array([END_ID], self.kind).tobytes()
        self.packed = [np.array([i], self.kind).tobytes() for i in range(self.tokenizer.get_vocab_size())]
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}
        self.words = by_words(path)

    def part(self, s: str) -> bytes:
        if (found := self.parts.get(s)) is None:
            mapped = s if s.isascii() else "".join(map(self.letters.__getitem__, s.encode()))
            found = self.parts[s] = b"".join([self.packed[t.id] for t in self.model.tokenize(mapped)])
        return found

    def __missing__(self, word: bytes) -> bytes:
        s = word.decode("utf-8", "replace")
        low = s.lower()
        if not _PLAIN.fullmatch(s):
            ids = self.tokenizer.encode(s, add_special_tokens=False).ids
            out = b"".join([self.packed[i] for i in ids])
        elif low.isalpha():
            out = self.part(low)
        elif low[:-1].isalpha():  # a last sign or digit is a pre-token of its own
            out = self.part(low[:-1]) + self.part(low[-1])
        else:
            out = b"".join(map(self.part, _PRE.findall(low)))
        self[word] = out
        return out

    def encode(self, text: bytes | None) -> bytes:
        """The ids of a whole UTF-8 text (null: empty) and the end id."""
        if not self.words:
            ids = self.tokenizer.encode((text or b"").decode("utf-8", "replace"), add_special_tokens=False).ids
            return np.array(ids, self.kind).tobytes() + self.end
        if len(self) > CACHE_WORDS:
            self.clear()
        if len(self.parts) > CACHE_WORDS:
            self.parts.clear()
        return b"".join(map(self.__getitem__, (text or b"").split())) + self.end


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
