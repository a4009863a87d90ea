"""Token ids of the ``tokenizers`` library's files, faster than by its own encoder.

The library takes three to four times what the check tool allows for the whole of packing or writing an archive, so two kinds of
byte-level BPE, whose merges stand in the order of their ids, are run by a rank-based merge engine (``tiktoken``'s public encoder)
over the same vocabulary: one that splits texts by the well-known pattern of byte-level pre-tokenizers, and one that
lower-cases, drops white space and marks the ends of words. There, equal words are merged once and kept in a bounded
memory. Texts with a special token, or with a character that is, or is
lower-cased to, one outside those whose classes are fixed here, and every other kind of file, go through the library
itself; so does everything, if a probe of the fast way gives other ids than the library. Tests hold the ids of every
document of two sizes of the test data against the library's.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Words remembered per worker before the memory is emptied.
MEMORY = 400_000
#: Code points whose classes agree in all Unicode versions in use.
_PLAIN = [*range(0x250), *range(0x2010, 0x2028)]
_ODD = re.compile("[^" + "".join(re.escape(chr(a)) + "-" + re.escape(chr(b)) for a, b in ((0, 0x24F), (0x2010, 0x2027))) + "]")
#: Those whose lower-case form is not among them.
_LEAVING = "".join(chr(c) for c in _PLAIN if _ODD.search(chr(c).lower()))
_ODD_LOWER = re.compile("[^" + "".join(re.escape(chr(c)) for c in _PLAIN if c and chr(c) not in _LEAVING) + "]")
_BLANK = {*range(9, 14), 0x20, 0x85, 0xA0}
# The splitting patterns of the two kinds of files.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_ENDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Marks a word's end for the engine; texts that hold it go through the library.
_END = "\0"


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in _PLAIN if unicodedata.category(chr(c))[0] == kind)


def _byte_letters() -> dict[str, int]:
    """Letters that byte-level vocabularies write for bytes."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def _ranks(model: dict, suffix: str) -> dict[bytes, int] | None:
    """The vocabulary by bytes, if its ids rank the merges."""
    letters, ranks = _byte_letters(), {}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    last = -1
    for a, b in merges:
        joined = a + b
        rank = model["vocab"].get(joined, -1)
        if rank <= last:
            return None
        last = rank
    reached = {a + b for a, b in merges}
    for token, i in model["vocab"].items():
        bare = token.removesuffix(suffix) if suffix and token.endswith(suffix) and len(token) > len(suffix) else token
        if any(c not in letters for c in bare):
            continue
        if token in reached or len(bare) == 1:
            word = bytes(letters[c] for c in bare) + (_END.encode() if bare != token else b"")
            if word in ranks:
                return None
            ranks[word] = i
    return ranks if len({r[:1] for r in ranks if len(r) == 1}) == 256 else None


class Encoder:
    """Ids of whole texts, without added special tokens, as little-endian bytes of ``width``."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.width = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.odd = _ODD
        self.memory: dict[str, bytes] = {}
        self.kind = self._kind(spec)
        probe = "It's  naïve; we'll pay 3,50€?\n\n\tThe QUICK brown\xa0fox's ½ été, 'tis—an über-test \x1c of IDs  \n x_y #1 \n"
        probes = [probe, probe * 3, *(f"{c}aya a{c}b {c}." for c in _LEAVING)]
        if self.kind and any(self.encode(p) != self._library(p) for p in probes):
            self.kind = None

    def _kind(self, spec: dict) -> str | None:
        model, pre, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) and not spec.get("truncation")
        if not plain:
            return None
        if not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not model.get("end_of_word_suffix"):
            ranks = _ranks(model, "")
            if ranks:
                self.engine = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
                return "text"
        kinds = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        parts = pre.get("pretokenizers", [])
        if kinds == ["NFC", "Replace", "Lowercase"] and len(parts) == 2 and (parts[0].get("pattern") or {}).get("Regex") == WORD_ENDS and parts[0].get("behavior") == "Removed" and model.get("end_of_word_suffix"):
            ranks = _ranks(model, model["end_of_word_suffix"])
            if ranks:
                self.odd = _ODD_LOWER
                self.engine = tiktoken.Encoding("word-ends", pat_str=rf"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})
                blank = "".join(re.escape(chr(c)) for c in sorted(_BLANK))
                self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{blank}{_class('L')}{_class('N')}]+").findall
                return "words"
        return None

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.width).tobytes()

    def _engine(self, text: str) -> bytes:
        return self.engine.encode_to_numpy(text, disallowed_special=()).astype(self.width).tobytes()

    def _word(self, word: str) -> bytes:
        got = np.array(self.engine.encode_ordinary(word + _END), dtype=self.width).tobytes()
        if len(self.memory) >= MEMORY:
            self.memory.clear()
        if len(word) <= 64:
            self.memory[word] = got
        return got

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.kind or self.odd.search(text) or any(s in text for s in self.special):
            return self._library(text)
        if self.kind == "text":
            return self._engine(text)
        get, word = self.memory.get, self._word
        return b"".join([get(w) or word(w) for w in self.split(text.lower())])

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode(text), dtype=self.width)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
