"""Ids of byte-level BPE as the tokenizers library gives them.

The library's own encoder is exact but slow. Where a text has only characters that both libraries
class alike, tiktoken with ranks derived from the same file gives the same ids several times faster;
any other text goes to the tokenizers library. Special strings in texts become their ids (the default).
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed value: the pattern by which byte-level pre-tokenisation splits texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose class (letter, number, space, other) no Unicode version disputes.
_DISPUTED = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e¡-ɏ‐-‧]")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


class ByteBpe:
    def __init__(self, path: str):
        self.hf = load_tokenizer(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._fast = self._ranked(spec)
        self.dtype = np.dtype("<u2") if self.hf.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")

    def _ranked(self, spec: dict):
        """tiktoken's encoder if the file is plain byte-level BPE whose ids are its merge ranks, else None."""
        import tiktoken

        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor")
        plain = plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        plain = plain and not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized"))
        if not plain:
            return None
        vocab, alphabet = model["vocab"], byte_alphabet()
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)) or len(vocab) != 256 + len(model["merges"]):
            return None
        ranks = {bytes(alphabet[c] for c in token): rank for token, rank in vocab.items() if token not in self.special}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a whole text; none for a null or empty one."""
        if not text:
            return np.empty(0, self.dtype)
        if self._fast is None or _DISPUTED.search(text):
            return np.array(self.hf.encode(text, add_special_tokens=False).ids, self.dtype)
        parts = self._special.split(text) if self._special and self._special.search(text) else [text]
        made = [np.array([self.special[p]] if i % 2 else self._fast.encode_ordinary(p), self.dtype) for i, p in enumerate(parts)]
        return made[0] if len(made) == 1 else np.concatenate(made)


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder for each file and Python worker."""
    return ByteBpe(path)
