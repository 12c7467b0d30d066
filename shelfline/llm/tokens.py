"""Token ids from public vocabularies, remembered by word so that repeated words are encoded once.

Both encoders cut a text where the tokenizer's own pre-tokenizer is sure to cut, ask the tokenizers library for
each distinct part and join the ids; a text where the cut isn't sure goes to the library whole.
"""

from __future__ import annotations

import base64
import json
import os
import re

import numpy as np

from shelfline.llm.common import REMEMBERED_BY_WORKER

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Most parts that an encoder remembers, in some 50 MB.
REMEMBERED = 250_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


# The normalizer and the pre-tokenizer for which words can be encoded one by one.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


class WordEncoder(dict):
    """Ids of a word BPE, as little-endian unsigned 32-bit bytes; keys are words (UTF-8) without ASCII white space.

    Texts are cut into words only if the file has the normalizer and the pre-tokenizer above, which drop white space and
    lower the case; with any other one each text goes to the library whole."""

    #: One run of Latin letters, then at most one run of ASCII signs: both pre-tokenize alone.
    SIMPLE = re.compile("([a-zà-öø-ÿ]*)([!-&(-/:-@\\[-`{-~]*)")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        parts = (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)  # not the file, whose vocabulary would be parsed again
        normalizer, pre_tokenizer = (None if x is None else json.loads(x.__getstate__()) for x in parts)
        split = {"type": "Sequence", "pretokenizers": [WORD_SPLIT, BYTE_LEVEL]}
        self.by_word = normalizer == WORD_NORMALIZER and pre_tokenizer == split and self.tokenizer.post_processor is None
        self.chars = byte_chars()
        self.parts: dict[str, bytes] = {"": b""}

    def part(self, text: str) -> bytes:
        got = self.parts.get(text)
        if got is None:
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            mapped = "".join([self.chars[b] for b in text.encode()])
            got = self.parts[text] = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
        return got

    def __missing__(self, key: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        word = key.decode()
        if m := self.SIMPLE.fullmatch(word.lower()):
            # parts of the empty text stay empty even after a clear
            ids = b"".join([self.part(x) for x in m.groups() if x])
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[key] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.encode().split()))


class ByteEncoder(dict):
    """Ids of a byte-level BPE given as ranks; keys are parts such as a space and the word after it, values decimal ids joined by commas."""

    #: Between a character that is no white space and an ASCII space every match of the pattern ends.
    CUT = re.compile("[\x09-\x0d\x20]*[^\x09-\x0d\x20]+|[\x09-\x0d\x20]+")
    #: White space beyond ASCII, beside which the cut isn't sure.
    ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff]")
    #: A run of Latin letters with the space before it, then at most one run of ASCII signs: one match each.
    SIMPLE = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")

    def __init__(self, path: str, pattern: str) -> None:
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.chars = chars = byte_chars()
        name = lambda token: "".join([chars[b] for b in token])
        self.vocabulary: dict[int, bytes] = {rank: token for token, rank in ranks.items()}
        merges = []
        for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
            merges += [(name(token[:i]), name(token[i:])) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        self.model = models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.tokenizer = Tokenizer(self.model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def __missing__(self, part: str) -> str:
        if len(self) >= REMEMBERED:
            self.clear()
        if m := self.SIMPLE.fullmatch(part):
            ids = [t.id for x in m.groups() if x for t in self.model.tokenize("".join([self.chars[b] for b in x.encode()]))]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        got = self[part] = ",".join(map(str, ids))
        return got

    def encode(self, text: str) -> str:
        """Decimal ids joined by commas."""
        if self.ODD.search(text):
            return ",".join(map(str, self.tokenizer.encode(text, add_special_tokens=False).ids))
        return ",".join(map(self.__getitem__, self.CUT.findall(text)))

    def pieces(self, ids: list[int]) -> list[bytes]:
        """The bytes of each id; a character may be split between two of them."""
        return list(map(self.vocabulary.__getitem__, ids))


def encoder(kind: type, *args: str):
    """One encoder a worker process, so that what it remembers lasts over tasks."""
    if (kind, args) not in REMEMBERED_BY_WORKER:
        REMEMBERED_BY_WORKER[kind, args] = kind(*args)
    return REMEMBERED_BY_WORKER[kind, args]
