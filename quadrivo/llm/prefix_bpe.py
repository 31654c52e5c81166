"""Byte-level BPE by prefix dynamic programming.

For each prefix of a pre-token's bytes there is exactly one token that its encoding can end with: the token t at its end which may stand behind the last token
of what is before t. Two tokens may stand side by side if no merge over their border comes before the merges that made them. The table of
last tokens is all that is needed: walking back from a prefix's end gives the ids of that prefix, more bytes only add entries, and behind an edit the
entries are the old ones again as soon as as many in a row are equal as the longest token has bytes. Candidates come from an Aho-Corasick automaton of the vocabulary.
"""

from __future__ import annotations

import base64
import struct
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_map, batch_of, column_type

#: Pre-tokens and pairs that a worker remembers, the longest pre-token that it does, and characters of texts that are encoded together.
MEMORY, PAIRS, LONGEST, TOGETHER = 800_000, 400_000, 64, 1 << 20
#: For each class of characters one that every Unicode version puts there: letters, numbers, spaces, the rest.
_STANDS_FOR = ("ß", "²", " ", "…")
_BEYOND = regex.compile(r"[^\x00-\x7f]")


class Classes:
    """Characters that Python's regex and tiktoken, of other Unicode versions, class differently."""

    def __init__(self):
        import tiktoken

        ranks = {bytes([b]): b for b in range(256)}
        for head in b"a1\t!":
            for b in range(128, 256):
                ranks[bytes([head, b])] = len(ranks)
        kinds = r"\p{L}+|\p{N}+|\s+|[^\s\p{L}\p{N}]+"
        self.theirs = tiktoken.Encoding("classes", pat_str=kinds, mergeable_ranks=ranks, special_tokens={})
        self.ours, self.known = regex.compile(kinds), set()
        self.table: dict[int, str] = {}

    def as_theirs(self, text: str) -> str:
        """text, in which a character of another class is replaced by one of tiktoken's class for it; of the same length."""
        if text.isascii():
            return text
        for c in set(_BEYOND.findall(text)) - self.known:
            theirs = next(i for i, head in enumerate("a1\t!") if len(self.theirs.encode_ordinary(head + c)) <= len(c.encode()))
            if len(self.ours.findall("a1\t!"[theirs] + c)) > 1:
                self.table[ord(c)] = _STANDS_FOR[theirs]
            self.known.add(c)
        return text.translate(self.table) if self.table else text


class Known(dict):
    """Pre-tokens with their ids as little-endian 32-bit numbers: found when they are first asked for; short ones are remembered, up to MEMORY of them."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__()
        self.find = find

    def __missing__(self, piece: str) -> bytes:
        made = self.find(piece)
        if len(piece) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = made
        return made


class PrefixBpe:
    """Exact for ranks in which every single byte is a token and every token is the encoding of its own bytes; the pattern may ask for \\p{L}, \\p{N} and \\s, and covers all texts."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for t, r in self.rank.items():
            self.token[r] = t
        self.size = [len(t) for t in self.token]
        self.longest = max(self.size)
        self.pattern, self.classes = regex.compile(pattern), Classes()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.known = Known(self._piece)

    @cached_property
    def found(self):
        """The automaton of all tokens."""
        import ahocorasick

        made = ahocorasick.Automaton()
        for t, r in self.rank.items():
            made.add_word(t.decode("latin-1"), r)
        made.make_automaton()
        return made

    def split(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes t."""
        if t not in self.halves:
            raw = self.token[t]
            pairs = ((self.rank.get(raw[:i], t), self.rank.get(raw[i:], t)) for i in range(1, len(raw)))
            self.halves[t] = next((p for p in pairs if max(p) < t and self._apart(*p, t)), None)
        return self.halves[t]

    def _apart(self, a: int, b: int, before: int) -> bool:
        """Whether no merge over the border of a and b has a rank under `before`, going back through what a and b are made of, latest first.

        Where both sides could merge by the same rank, the left one does so first.
        """
        while True:
            if self.rank.get(self.token[a] + self.token[b], before) < before:
                return False
            left, right = self.split(a), self.split(b)
            if left and not (right and b >= a):
                before, a = a, left[1]
            elif right:
                before, b = b + 1, right[0]
            else:
                return True

    def neighbours(self, a: int, b: int) -> bool:
        """Whether token b may stand behind token a."""
        pair = a << 32 | b
        made = self.pairs.get(pair)
        if made is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            made = self.pairs[pair] = self._apart(a, b, len(self.token))
        return made

    def extend(self, raw: bytes, last: list[int], old: list[int] | None = None, shift: int = 0, edited: int = 0) -> None:
        """Adds to last, whose entries are those of raw's first bytes, all others.

        old: the table of a text that, from place `edited` of raw on, is the same, `shift` bytes earlier. When as many entries as the longest token
        has bytes are its entries, so are all others.
        """
        n, same = len(last), 0
        lo = max(0, n + 1 - self.longest)
        size, pairs, neighbours = self.size, self.pairs, self.neighbours
        for end, t in self.found.iter(raw[lo:].decode("latin-1")):
            i = lo + end
            if i != n:
                continue
            j = i - size[t]
            if j >= 0:
                stand = pairs.get(last[j] << 32 | t)
                if not (neighbours(last[j], t) if stand is None else stand):
                    continue
            last.append(t)
            n += 1
            if old is not None and i >= edited:
                same = same + 1 if 0 <= i - shift < len(old) and old[i - shift] == t else 0
                if same == self.longest:
                    last += old[i + 1 - shift :]
                    return

    def fresh(self, raw: bytes) -> list[int]:
        """The table of raw."""
        last: list[int] = []
        n, size, known, neighbours, add = 0, self.size, self.pairs.get, self.neighbours, last.append
        for end, t in self.found.iter(raw.decode("latin-1")):
            if end == n:
                j = end - size[t]
                if j >= 0:
                    a = last[j]
                    stand = known(a << 32 | t)
                    if stand is None:
                        stand = neighbours(a, t)
                    if not stand:
                        continue
                add(t)
                n += 1
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The ids of the bytes that last is the table of."""
        ids, i = [], len(last)
        while i:
            ids.append(last[i - 1])
            i -= self.size[ids[-1]]
        return ids[::-1]

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        seen = self.classes.as_theirs(text)
        if seen is text:
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(seen)]

    def _piece(self, piece: str) -> bytes:
        ids = self.walk(self.fresh(piece.encode()))
        return struct.pack(f"<{len(ids)}i", *ids)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin, and the last one's end."""
        get = self.known.__getitem__
        made = [b"".join(map(get, self.pieces(t))) for t in texts]
        return np.frombuffer(b"".join(made), "<i4"), np.cumsum([0, *(len(m) // 4 for m in made)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        ids, ends = self.encode_all(texts)
        return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def table(self, text: str) -> Table:
        made = Table(self)
        made.replace(0, 0, text)
        return made


class Table:
    """A text with the last token of each byte prefix of its pre-tokens: appends and edits encode again only near where they are."""

    def __init__(self, bpe: PrefixBpe, text: str = "", starts: list[int] | None = None, last: list[int] | None = None):
        self.bpe, self.text, self.starts, self.last = bpe, text, starts or [], last or []
        #: Entries that the last change had to find.
        self.found = 0

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, lo: int, hi: int, new: str) -> None:
        """Puts new in place of the characters from lo to hi."""
        bpe, old_starts, old = self.bpe, self.starts, self.last
        begin = len(self.text[:lo].encode())
        until = begin + len(self.text[lo:hi].encode())
        raw_new = new.encode()
        edited, shift = begin + len(raw_new), len(raw_new) - (until - begin)
        # a pre-token looks ahead by a character, a contraction by three; so those that end well before the edit stay
        keep = max(0, bisect_left(old_starts, begin) - 3)
        p = old_starts[keep] if old_starts else 0
        self.text = self.text[:lo] + new + self.text[hi:]
        raw = self.text.encode()
        tail = raw[p:].decode()
        starts, last, self.found = old_starts[:keep], old[:p], 0
        for m in bpe.pattern.finditer(bpe.classes.as_theirs(tail)):
            at = bisect_left(old_starts, p - shift)
            if p >= edited and at < len(old_starts) and old_starts[at] == p - shift:
                starts += [s + shift for s in old_starts[at:]]
                last += old[p - shift :]
                break
            piece = tail[m.start() : m.end()].encode()
            i = bisect_right(old_starts, p) - 1
            was_end = old_starts[i + 1] if i + 1 < len(old_starts) else len(old)
            made = old[p : min(begin, was_end, p + len(piece))] if i >= 0 and old_starts[i] == p and p < begin else []
            i = bisect_right(old_starts, p + len(piece) - 1 - shift) - 1  # the old pre-token in which this one's last byte was
            kept, known = None, len(made)
            if i >= 0 and p + len(piece) > edited:
                end = old_starts[i + 1] if i + 1 < len(old_starts) else len(old)
                if end + shift == p + len(piece):
                    kept = old[old_starts[i] : end]
                    self.extended(piece, made, kept, old_starts[i] + shift - p, max(edited - p, old_starts[i] + shift - p))
            if kept is None:
                self.extended(piece, made)
            starts.append(p)
            last += made
            p += len(piece)
        self.starts, self.last = starts, last

    def extended(self, piece: bytes, made: list[int], *old) -> None:
        known, whole = len(made), len(piece)
        self.bpe.extend(piece, made, *old)
        self.found += whole - known

    def ids(self) -> list[int]:
        ends = [*self.starts[1:], len(self.last)]
        return [*chain.from_iterable(self.bpe.walk(self.last[a:b]) for a, b in zip(self.starts, ends))]


@lru_cache(maxsize=2)
def prefix_bpe(path: str, pattern: str) -> PrefixBpe:
    """One encoder for each file and Python worker."""
    return PrefixBpe(path, pattern)


def _together(texts: list[str]):
    """Ranges of texts of about TOGETHER characters, one at least."""
    lo = size = 0
    for hi, t in enumerate(texts):
        if size and size + len(t) > TOGETHER:
            yield lo, hi
            lo, size = hi, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def bpe_encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each row: key, ids (array<int>), decoded (binary: the bytes of those ids).

    A null text counts as empty, and an empty one has no ids. Rows are independent: repeated rows repeat, a null key stays null, an empty table gives none, other columns are not read.
    """
    schema = T.StructType([T.StructField(key, column_type(df, key)), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        bpe = prefix_bpe(ranks, pattern)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in _together(texts):
                ids, ends = bpe.encode_all(texts[lo:hi])
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield batch_of([b.column(0).slice(lo, hi - lo), listed, [bpe.decode(ids[i:j].tolist()) for i, j in zip(ends, ends[1:])]], schema)

    return arrow_map(df.select(key, text), run, schema)


def bpe_tables(df: DataFrame, ranks: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each row: key, text, starts (bytes at which pre-tokens start) and last (last token of each byte prefix of a pre-token), to be changed by bpe_edit. Nulls and repeats as in bpe_encode."""
    empty = df.select(F.col(key).alias(key), F.lit("").alias("text"), F.array().cast("array<int>").alias("starts"), F.array().cast("array<int>").alias("last"), F.lit(0).alias("at"), F.lit(0).alias("removed"), F.col(text).alias("inserted"))
    return bpe_edit(empty, ranks, pattern, key).drop("ids", "found")


def bpe_edit(df: DataFrame, ranks: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """bpe_tables' columns after an edit: df has them, and at, removed (characters; beyond the end: the end) and inserted. Also ids, and found: entries that were not taken over.

    A null at is the end (an append), a null removed none, a null inserted empty.
    """
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField(key, column_type(df, key)), T.StructField("text", T.StringType()), T.StructField("starts", numbers), T.StructField("last", numbers), T.StructField("ids", numbers), T.StructField("found", T.LongType())])

    def run(batches):
        bpe = prefix_bpe(ranks, pattern)
        for b in batches:
            for i in range(b.num_rows):
                text, starts, last, at, removed, new = (b.column(c)[i].as_py() for c in range(1, 7))
                made = Table(bpe, text or "", starts, last)
                lo = len(made.text) if at is None else min(max(at, 0), len(made.text))
                made.replace(lo, min(len(made.text), lo + max(removed or 0, 0)), new or "")
                yield batch_of([b.column(0).slice(i, 1), [made.text], [made.starts], [made.last], [made.ids()], [made.found]], schema)

    return arrow_map(df.select(key, "text", "starts", "last", "at", "removed", "inserted"), run, schema)


def bpe_digests(df: DataFrame, ranks: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """bpe_encode as n_tokens, ids_sha256 (of the decimal ids, joined by one space) and decoded_sha256, in lowercase hex."""
    made = bpe_encode(df, ranks, pattern, text, key)
    return made.select(key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
