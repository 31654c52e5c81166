"""Token counts by overlap resynchronisation.

A huge document is encoded in overlapping chunks with offsets. Two neighbours are spliced where both
have a pre-token boundary at the same character and the left chunk's end can't have moved it: byte-level
pre-tokenisation looks ahead by one character (by a special string's or contraction's length at most)
and never back, so from such a boundary on the right chunk's tokens are those of the whole text. Where
the neighbours share none, the overlap is doubled, and at last the chunk.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .byte_bpe import byte_bpe
from .shared import arrow_map, batch_of, column_type

CHUNK_CHARS, OVERLAP_CHARS = 32_768, 512


class Resync:
    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        self.bpe, self.chunk, self.overlap = byte_bpe(path), chunk, overlap
        #: Characters before a chunk's end whose boundaries may be those of the cut only.
        self.unsure = 4 + max([0, *map(len, self.bpe.special)])

    def _bounds(self, text: str, start: int, stop: int) -> tuple[dict[int, int], int]:
        """Pre-token starts of text[start:stop], in characters of the text, with the tokens before each; tokens in all."""
        made = self.bpe.hf.encode(text[start:stop], add_special_tokens=False)
        words, offsets, found, last = made.word_ids, made.offsets, {}, object()
        for i, word in enumerate(words):
            if word != last or word is None:
                found[start + offsets[i][0]] = i
                last = word
        return found, len(words)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(text) <= self.chunk:
            return len(self.bpe.ids(text))
        total, known, stop = 0, 0, self.chunk  # total: tokens before the proven boundary known
        left, n_left = self._bounds(text, 0, stop)
        while stop < len(text):
            overlap, found = min(self.overlap, stop - known - 1), None
            while found is None:
                begin = stop - overlap
                end = min(len(text), begin + max(self.chunk, 2 * overlap))
                right, n_right = self._bounds(text, begin, end)
                found = next((p for p in right if known < p <= stop - self.unsure and p in left), None)
                if found is None and begin <= known + 1:  # the chunk has no boundary that both can prove: lengthen it
                    stop = min(len(text), stop + (stop - known))
                    left, n_left = self._bounds(text, known, stop)
                    if stop == len(text):
                        return total + n_left
                    overlap = min(self.overlap, stop - known - 1)
                elif found is None:
                    overlap = min(2 * overlap, stop - known - 1)
            total += left[found] - left.get(known, 0)
            known, stop, left, n_left = found, end, right, n_right
        return total + n_left - left.get(known, 0)


@lru_cache(maxsize=4)
def _resync(path: str, chunk: int, overlap: int) -> Resync:
    return Resync(path, chunk, overlap)


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", limit: int = 1024, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """For each row: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens. Rows are independent: repeated rows give repeated
    results, a null key stays null, an empty table gives none, other columns are not read.
    """
    schema = T.StructType([T.StructField(key, column_type(df, key)), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        counter = _resync(tokenizer, chunk_chars, overlap_chars)
        for b in batches:
            texts = b.column(1).to_pylist()
            counts = [counter.count(t) for t in texts]
            yield batch_of([b.column(0), [len(t.encode()) if t else 0 for t in texts], counts, [n > limit for n in counts]], schema)

    return arrow_map(df.select(key, text), run, schema)
