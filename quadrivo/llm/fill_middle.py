"""Fill-in-the-middle by a parallel automaton scan.

Units (lines, words) are ended by a small automaton over bytes. A block of bytes is a function from the state before it to the state
behind it, with the units it ends from each state; functions compose associatively, so blocks are scanned all at once, from every
state, and their entry states follow from a prefix composition. A cut after k units is then sought in one block only. A second automaton
finds marks that a text has of its own.

A text of up to GIANT bytes is scanned within its row. A longer one is dealt out in chunks: tasks emit the chunks' functions, their
composition gives each document's units and the chunk, entry state and remaining units of both cuts, and only that chunk is walked again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_map, batch_of, column_type

#: Bytes of a block, of a chunk of a giant text, above which a text is giant, and of texts that are scanned together.
BLOCK, CHUNK, GIANT, TOGETHER = 256, 1 << 15, 1 << 16, 1 << 21
#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Automaton:
    """step: for each kind of byte the state that follows each state; ends: where a unit ends before such a byte. State 0 is that of an empty text."""

    kinds: tuple[bytes, ...]  # the bytes of kinds 1, 2, ...; all others are of kind 0
    step: tuple[tuple[int, ...], ...]
    ends: tuple[tuple[int, ...], ...] = ()

    @property
    def states(self) -> int:
        return len(self.step[0])

    @cached_property
    def kind(self) -> np.ndarray:
        made = np.zeros(256, np.int64)
        for k, members in enumerate(self.kinds, 1):
            made[list(members)] = k
        return made

    @cached_property
    def table(self) -> np.ndarray:
        """Following state, and 16 where a unit ends, by kind * states + state; a last kind, of padding, changes nothing."""
        ends = np.array(self.ends) if self.ends else 0
        return np.concatenate([(np.array(self.step) + 16 * ends).ravel(), np.arange(self.states)])


#: States: no unit yet, inside one, behind a byte that may end one.
UNITS = {
    "line": Automaton((b"\n",), ((1, 1, 1), (2, 2, 2)), ((0, 0, 1), (0, 0, 1))),
    "word": Automaton((b" \t\n\x0b\x0c\r",), ((1, 1, 1), (2, 2, 2)), ((0, 0, 1), (0, 0, 0))),
}
#: States: nothing, "<", "<" and a letter, a mark was found.
MARKS = Automaton((b"<", b"PSM", b">"), ((0, 0, 0, 3), (1, 1, 1, 3), (0, 2, 0, 3), (0, 0, 3, 3)))


def compose(state: np.ndarray, count: np.ndarray, rank: np.ndarray) -> None:
    """Turns each function (by row, one column a start state) into its composition with all earlier ones of its run, in place; rank is its place in the run."""
    d, last = 1, rank.max(initial=0)
    while d <= last:
        later = np.flatnonzero(rank >= d)
        via = state[later - d]
        behind, more = np.take_along_axis(state[later], via, 1), np.take_along_axis(count[later], via, 1)
        more += count[later - d]
        state[later], count[later] = behind, more
        d *= 2


class Scan:
    """Pieces of bytes, scanned from every state at once."""

    def __init__(self, automaton: Automaton, pieces: list[bytes]):
        self.a = automaton
        data = np.frombuffer(b"".join(pieces) + b"\0", np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces], dtype=np.int64)])
        n = -(-np.diff(self.bounds) // BLOCK)
        self.first = np.concatenate([[0], np.cumsum(n)])
        self.piece = np.repeat(np.arange(len(n)), n)
        self.rank = np.arange(self.first[-1]) - self.first[self.piece]
        self.begin = self.bounds[self.piece] + self.rank * BLOCK
        at = self.begin + np.arange(BLOCK)[:, None]
        inside = at < self.bounds[self.piece + 1]
        self.kinds = np.where(inside, automaton.kind[data[np.where(inside, at, -1)]], len(automaton.step)) * automaton.states
        self.state = np.tile(np.arange(automaton.states), (len(self.piece), 1))
        self.count = np.zeros_like(self.state)
        for row in self.kinds:
            code = automaton.table[row[:, None] + self.state]
            self.state = code & 15
            self.count += code >> 4
        compose(self.state, self.count, self.rank)

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """For each piece and start state: the state behind it, and the units that it ends."""
        state, count = np.tile(np.arange(self.a.states), (len(self.first) - 1, 1)), np.zeros((len(self.first) - 1, self.a.states), np.int64)
        some = np.flatnonzero(np.diff(self.first))
        state[some], count[some] = self.state[self.first[some + 1] - 1], self.count[self.first[some + 1] - 1]
        return state, count

    def select(self, piece: np.ndarray, start: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Where in a piece that is entered in state start its k-th unit ends; such a unit must end in it."""
        head = self.rank == 0
        if not len(piece):
            return np.zeros(0, np.int64)
        enter = np.zeros(len(self.first) - 1, np.int64)
        enter[piece] = start
        s = enter[self.piece]
        before = np.where(head, 0, np.roll(self.count[np.arange(len(s)), s], 1))
        entry = np.where(head, s, np.roll(self.state[np.arange(len(s)), s], 1))
        wide = self.bounds[-1] + 2
        block = np.searchsorted(self.piece * wide + before, piece * wide + k) - 1
        state, left, found = entry[block], k - before[block], np.full(len(k), -1)
        for j, row in enumerate(self.kinds[:, block]):
            code = self.a.table[row + state]
            state, left = code & 15, left - (code >> 4)
            found[(left == 0) & (found < 0)] = j
        return self.begin[block] + found - self.bounds[piece]


def cut_units(key: object, seed: int, n: int) -> tuple[int, int, int, int]:
    """Units before the middle and up to its end, and two draws in 0..99 for whether the text is rearranged and how: by key, seed and the text's number of units."""
    name = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(name[i : i + 8], 16) for i in range(0, 32, 8)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    return lo, hi, h[2] % 100, h[3] % 100


def _chars(raw: bytes) -> int:
    return int((np.frombuffer(raw, np.uint8) & 0xC0 != 0x80).sum())


def _form(raw: bytes, marked: bool, draw: int, order: int, rate: int, spm: int) -> str:
    return "plain" if not raw or marked or draw >= rate else "spm" if order < spm else "psm"


def _arranged(raw: bytes, form: str, lo: int, hi: int) -> tuple[int | None, int | None, bytes]:
    """Code points of prefix and middle, and the output."""
    if form == "plain":
        return None, None, raw
    head, body, tail = raw[:lo], raw[lo:hi], raw[hi:]
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    return _chars(head), _chars(body), b"".join([p, head, s, tail, m, body] if form == "psm" else [s, tail, p, head, m, body])


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches of about TOGETHER bytes of texts, at least one row each; a null text is empty."""
    for b in batches:
        texts = [t or b"" for t in b.column(column).cast(pa.large_binary()).to_pylist()]
        lo = size = 0
        for hi, t in enumerate(texts):
            if size and size + len(t) > TOGETHER:
                yield b.slice(lo, hi - lo), texts[lo:hi]
                lo, size = hi, 0
            size += len(t) + 1
        if lo < len(texts):
            yield b.slice(lo), texts[lo:]


def _schema(kind: T.DataType, name: str) -> T.StructType:
    fields = [(name, kind), ("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]
    return T.StructType([T.StructField(*f) for f in fields])


def _rows(b: pa.RecordBatch, n: list[int], forms: list[str], made: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    head, body, out = ([m[i] for m in made] for i in range(3))
    return batch_of([b.column(0), n, forms, head, body, pa.array(out, pa.binary())], schema)


def _in_rows(df: DataFrame, schema: T.StructType, unit: str, seed: int, rate: int, spm: int) -> DataFrame:
    def run(batches):
        for b, texts in _slices(batches, 1):
            scan, keys = Scan(UNITS[unit], texts), b.column(0).to_pylist()
            state, count = scan.functions()
            marked = Scan(MARKS, texts).functions()[0][:, 0] == 3
            n = count[:, 0] + (state[:, 0] > 0)
            drawn = [cut_units(k, seed, int(x)) for k, x in zip(keys, n)]
            forms = [_form(t, m, d[2], d[3], rate, spm) for t, m, d in zip(texts, marked, drawn)]
            cuts = np.array([d[:2] for d in drawn])
            at = np.where(cuts == 0, 0, np.diff(scan.bounds)[:, None])
            row, which = np.nonzero((cuts > 0) & (cuts < n[:, None]))
            at[row, which] = scan.select(row, np.zeros(len(row), np.int64), cuts[row, which])
            yield _rows(b, n.tolist(), forms, [_arranged(t, f, *a) for t, f, a in zip(texts, forms, at.tolist())], schema)

    return arrow_map(df, run, schema)


def _chunks(df: DataFrame, chunk: int) -> DataFrame:
    """key, digest, chunk (number), data: the giant texts dealt out."""
    schema = T.StructType([df.schema["key"], df.schema["digest"], T.StructField("chunk", T.LongType()), T.StructField("data", T.BinaryType())])

    def run(batches):
        for b, texts in _slices(batches, 1):
            for i, raw in enumerate(texts):
                for lo in range(0, len(raw), TOGETHER // chunk * chunk):
                    parts = [raw[j : j + chunk] for j in range(lo, min(len(raw), lo + TOGETHER // chunk * chunk), chunk)]
                    same = pa.array([i] * len(parts))
                    yield batch_of([b.column(0).take(same), b.column(2).take(same), [lo // chunk + j for j in range(len(parts))], parts], schema)

    return arrow_map(df.select("key", "text", "digest"), run, schema).repartition("key", "digest", "chunk")


def _cuts_of_giants(df: DataFrame, unit: str, seed: int, chunk: int) -> DataFrame:
    """key, digest, n, marked, cuts (for each the chunk, the state it is entered in, and its units that are still before the cut; null at the text's ends)."""
    name = [df.schema["key"], df.schema["digest"]]
    emitted = T.StructType([*name, T.StructField("chunk", T.LongType()), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("state", "count", "mark"))])

    def emit(batches):
        for b, data in _slices(batches, 3):
            state, count = Scan(UNITS[unit], data).functions()
            mark = Scan(MARKS, data).functions()[0]
            yield batch_of([b.column(0), b.column(1), b.column(2), state.tolist(), count.tolist(), mark.tolist()], emitted)

    # a document has at most 2^31 / chunk functions, as a row of Spark's has at most 2 GB; repeated rows have the same ones
    functions = arrow_map(_chunks(df, chunk), emit, emitted).groupBy("key", "digest", "chunk").agg(*(F.first(c).alias(c) for c in ("state", "count", "mark")))
    whole = functions.groupBy("key", "digest").agg(F.sort_array(F.collect_list(F.struct("chunk", "state", "count", "mark"))).alias("parts"))
    cut = T.StructType([T.StructField(c, T.LongType()) for c in ("chunk", "state", "units")])
    resolved = T.StructType([*name, T.StructField("n", T.LongType()), T.StructField("marked", T.BooleanType()), T.StructField("cuts", T.ArrayType(cut))])

    def resolve(batches):
        for b in batches:
            ns, marked, cuts = [], [], []
            for key, parts in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                rank = np.arange(len(parts))
                state, count, mark = (np.array([p[c] for p in parts]) for c in ("state", "count", "mark"))
                compose(state, count, rank)
                compose(mark, np.zeros_like(mark), rank)
                before, entry = np.concatenate([[0], count[:-1, 0]]), np.concatenate([[0], state[:-1, 0]])
                n = int(count[-1, 0]) + 1
                found = []
                for k in cut_units(key, seed, n)[:2]:
                    i = int(np.searchsorted(before, k)) - 1
                    found.append({"chunk": i, "state": int(entry[i]), "units": k - int(before[i])} if 0 < k < n else {"chunk": None, "state": None, "units": k})
                ns.append(n), marked.append(bool(mark[-1, 0] == 3)), cuts.append(found)
            yield batch_of([b.column(0), b.column(1), ns, marked, cuts], resolved)

    return arrow_map(whole, resolve, resolved)


def _giants(df: DataFrame, schema: T.StructType, unit: str, seed: int, rate: int, spm: int, chunk: int) -> DataFrame:
    df = df.withColumn("digest", F.sha2("text", 256))
    cuts = _cuts_of_giants(df, unit, seed, chunk).withColumnsRenamed({"key": "k", "digest": "d"})
    joined = df.join(cuts.hint("shuffle_hash"), df.key.eqNullSafe(cuts.k) & (df.digest == cuts.d)).select("key", "text", "n", "marked", "cuts")

    def run(batches):
        for b, texts in _slices(batches, 1):
            keys, n, marked, cuts = (b.column(i).to_pylist() for i in (0, 2, 3, 4))
            forms, made = [], []
            for key, raw, units, m, found in zip(keys, texts, n, marked, cuts):
                drawn, at = cut_units(key, seed, units), []
                for c in found:
                    if c["chunk"] is None:
                        at.append(len(raw) if c["units"] else 0)
                    else:
                        lo = c["chunk"] * chunk
                        at.append(lo + int(Scan(UNITS[unit], [raw[lo : lo + chunk]]).select(np.zeros(1, np.int64), np.array([c["state"]]), np.array([c["units"]]))[0]))
                forms.append(_form(raw, m, drawn[2], drawn[3], rate, spm))
                made.append(_arranged(raw, forms[-1], *at))
            yield _rows(b, n, forms, made, schema)

    return arrow_map(joined, run, schema)


def fill_middle(df: DataFrame, text: str = "text", key: str = "doc_id", unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """One row for each document: key, n (units), form (plain, psm, spm), prefix_chars, middle_chars (code points; null if plain), output.

    A text is cut after two numbers of units drawn from seed and key, and rearranged in `rate` of 100 documents, `spm` of 100 of those with the suffix first.
    A null text counts as empty; an empty text, or one with a mark of its own, stays plain. A null key draws as an empty one; rows are independent, so repeated
    rows repeat; an empty table gives none; other columns are not read. A document has to fit in a row, so in a task; its scan does not.
    """
    schema = _schema(column_type(df, key), key)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    long = F.octet_length("text") > giant
    small = _in_rows(rows.where(~F.coalesce(long, F.lit(False))), schema, unit, seed, rate, spm)
    return small.unionByName(_giants(rows.where(long), schema, unit, seed, rate, spm, chunk))


def restored(output: Column, form: Column) -> Column:
    """The text that fill_middle rearranged: each mark is in such an output once."""
    middle = F.substring_index(output, MIDDLE, -1)
    rest = F.substring_index(output, MIDDLE, 1)
    psm = F.concat(F.substring_index(F.substring_index(rest, SUFFIX, 1), PREFIX, -1), middle, F.substring_index(rest, SUFFIX, -1))
    spm = F.concat(F.substring_index(rest, PREFIX, -1), middle, F.substring_index(F.substring_index(rest, PREFIX, 1), SUFFIX, -1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_middle_digests(df: DataFrame, **options) -> DataFrame:
    """fill_middle with output_sha256 and restored_sha256 (of the text rebuilt from output and form) in place of the output."""
    made = fill_middle(df, **options)
    return made.select(*made.columns[:-1], F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


#: fill_middle_digests of documents by lists of lines.
DIGESTS_SQL = r"""
WITH units AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, len(u) AS n, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
draws AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b, CAST('0x' || h[25:32] AS BIGINT) % 100 AS o FROM units),
cuts AS (SELECT doc_id, t, n, CASE WHEN t = '' OR t LIKE '%<P>%' OR t LIKE '%<S>%' OR t LIKE '%<M>%' THEN 'plain' WHEN o < 50 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM draws)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM cuts
"""
