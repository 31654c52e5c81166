"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token is never merged, so no token spans it: a text may be cut
there, provided the pre-tokeniser ends a pre-token there too (else a fragment's last symbol would get
the word-end mark, or a pattern would match differently). The table of such pairs is derived from the vocabulary; white space
occurs in no token, so texts fall apart into words at the least, and words into letters, digits and signs. Fragments are encoded independently,
remembered by each worker within a bounded memory, and concatenated; decoding joins the fragments' decoded tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .byte_bpe import byte_alphabet, load_tokenizer
from .shared import arrow_map, batch_of, column_type

SPACES = " \t\n\x0b\x0c\r"
#: Fragments that a worker remembers, and the longest that it does.
MEMORY, LONGEST = 600_000, 64
#: Letters that every Unicode version lower-cases alike, one by one and without recomposing; or ASCII signs but the apostrophe.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ňŊ-ſ]+|[!-&(-/:-@\\[-`{-~]+")


class ForcedBpe:
    """Exact for files whose normaliser keeps or lower-cases ASCII and whose pre-tokeniser separates white space, letters, digits and signs."""

    def __init__(self, path: str):
        self.hf = load_tokenizer(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix, alphabet = spec["model"].get("end_of_word_suffix") or "", byte_alphabet()
        inside = np.zeros((256, 256), bool)
        tokens = [t.removesuffix(suffix) if suffix else t for t in spec["model"]["vocab"]]
        raw = [bytes(alphabet[c] for c in t) for t in tokens if all(c in alphabet for c in t)]
        raw += [t["content"].encode() for t in spec.get("added_tokens", [])]
        for t in raw:
            b = np.frombuffer(t, np.uint8)
            inside[b[:-1], b[1:]] = True
        lower = np.arange(256)
        lower[65:91] += 32
        never = ~inside[lower][:, lower]
        #: 1 white space, 2 letters, 3 digits, 4 signs; 0: bytes beyond ASCII, controls, and the apostrophe of contractions.
        kind = np.zeros(256, np.uint8)
        for c in range(128):
            kind[c] = 1 if chr(c) in SPACES else 2 if chr(c).isalpha() else 3 if chr(c).isdigit() else 4 if 32 < c < 127 and c != 39 else 0
        apart = (kind[:, None] != kind[None, :]) & (kind[:, None] > 0) & (kind[None, :] > 0) | (kind[:, None] == 1) ^ (kind[None, :] == 1)
        self.cut = never & apart
        spaces = [ord(c) for c in SPACES]
        rest = np.flatnonzero(kind != 1)
        #: Whether any run of white space may be cut out of a text.
        self.words = bool(self.cut[np.ix_(spaces, rest)].all() and self.cut[np.ix_(rest, spaces)].all()) and len(self.hf.encode(SPACES, add_special_tokens=False).ids) == 0
        self.joined = self.hf.decoder is None  # then the library's decode() puts a space between tokens
        self.alphabet = {b: c for c, b in alphabet.items()}
        self.tokens = [(self.hf.id_to_token(i) or "").encode() for i in range(self.hf.get_vocab_size(with_added_tokens=True))]
        self.known: dict[str, tuple[bytes, bytes]] = {"": (b"", b"")}

    def fragments(self, text: str) -> list[str]:
        """text between its forced boundaries."""
        raw = text.encode()
        b = np.frombuffer(raw, np.uint8)
        at = [0, *(np.flatnonzero(self.cut[b[:-1], b[1:]]) + 1).tolist(), len(raw)]
        return [raw[i:j].decode() for i, j in zip(at, at[1:])]

    def _encode(self, parts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids as little-endian unsigned 32-bit numbers, and their decoded text. A run of plain letters or of signs is one pre-token, so it goes to the BPE model at once."""
        model, ids, rest = self.hf.model, [], []
        for i, p in enumerate(parts):
            if self.words and _PLAIN.fullmatch(p):
                low = p.lower()
                low = low if low.isascii() else low.encode().decode("latin-1").translate(self.alphabet)
                ids.append([t.id for t in model.tokenize(low)])
            else:
                ids.append(None)
                rest.append(i)
        for i, e in zip(rest, self.hf.encode_batch_fast([parts[i] for i in rest], add_special_tokens=False)):
            ids[i] = e.ids
        texts = [b" ".join([self.tokens[i] for i in x]) for x in ids] if self.joined else [t.encode() for t in self.hf.decode_batch(ids, skip_special_tokens=False)]
        return [(struct.pack(f"<{len(x)}I", *x), t) for x, t in zip(ids, texts)]

    def _learn(self, words: list[str]) -> None:
        """Encodes words that are not yet known, by their fragments. Words are cut together: the spaces between them are boundaries too."""
        split: list[list[str]] = [[]]
        for p in self.fragments(" ".join(words)):
            if p == " ":
                split.append([])
            else:
                split[-1].append(p)
        parts = [p for p in {p for ps in split for p in ps} if p not in self.known]
        known = dict(zip(parts, self._encode(parts)))
        for w, ps in zip(words, split):
            if len(ps) > 1:
                made = [known.get(p) or self.known[p] for p in ps]
                known[w] = (b"".join([m[0] for m in made]), b" ".join([m[1] for m in made if m[0]]))
        self.known |= known

    def run(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """For each text its ids, as little-endian unsigned 32-bit numbers, and their decoded text in UTF-8."""
        if not (self.words and self.joined):
            return self._encode([t or "" for t in texts])
        split = []
        for t in texts:
            t = t or ""
            for c in SPACES[1:]:
                if c in t:
                    t = t.replace(c, " ")
            split.append(t.split(" "))
        if new := [*set().union(*split).difference(self.known)]:
            self._learn(new)
        get, out = self.known.__getitem__, []
        for ws in split:
            made = [get(w) for w in ws if w]
            out.append((b"".join([m[0] for m in made]), b" ".join([m[1] for m in made if m[0]])))
        if len(self.known) > MEMORY:
            self.known = {"": (b"", b"")}
        else:
            for w in [w for w in new if len(w) > LONGEST]:
                self.known.pop(w, None)
        return out


@lru_cache(maxsize=4)
def _forced(path: str) -> ForcedBpe:
    return ForcedBpe(path)


def bpe_round_trip(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", texts: bool = False) -> DataFrame:
    """For each row: key, n_tokens, ids_sha256, decoded_sha256 (lowercase hex; of the ids as little-endian unsigned
    32-bit numbers, and of their decoded text in UTF-8); with texts also ids (array<int>) and decoded.

    A null text counts as empty. Rows are independent: repeated rows repeat, a null key stays null, an empty table gives none, other columns are not read.
    """
    fields = [T.StructField(key, column_type(df, key)), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())] if texts else []
    schema = T.StructType(fields)

    def run(batches):
        bpe = _forced(tokenizer)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                made = bpe.run(b.column(1).to_pylist())
                columns = [b.column(0), [len(i) // 4 for i, _ in made], [hashlib.sha256(i).hexdigest() for i, _ in made], [hashlib.sha256(t).hexdigest() for _, t in made]]
                columns += [[np.frombuffer(i, "<u4").tolist() for i, _ in made], [t.decode() for _, t in made]] if texts else []
                yield batch_of(columns, schema)

    return arrow_map(df.select(key, text), run, schema)
