"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and their letters kept, with one space for anything between; n-grams of 1 to 3
characters are hashed into BUCKETS. Training sums the n-gram counts of a bounded sample of texts for each
language on the executors; the matrix of log probabilities (BUCKETS x languages) is broadcast, and whole batches of
texts are scored at once: hashed n-grams as indices, one gather and one segment sum for each language. Every language in the labels is
learned, BLOCK of them at a time: each block's matrix is learned, broadcast and scored by itself, and rows carry the best language so far.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_map, batch_of, column_type, drop_path, new_path, spare, written

BUCKETS, ORDERS, SMOOTHING = 1 << 15, (1, 2, 3), 0.5
#: Expected number of texts for each language in the training sample, and languages whose matrix is held at once.
SAMPLE, BLOCK = 2000, 256
#: Characters that are scored at once.
CHUNK = 1 << 20
UNKNOWN = "und"
#: Blanks out all that is no letter below U+0800; the rest is asked for one by one.
_LATIN = str.maketrans({i: " " for i in range(0x800) if not chr(i).isalpha()})


def _clean(text: str | None) -> str:
    """Lower-cased letters, with one space around each run of them; empty without a letter."""
    if not text:
        return ""
    low = text.lower().translate(_LATIN)
    if max(low) >= "ࠀ":
        low = "".join([c if c < "ࠀ" or c.isalpha() else " " for c in low])
    low = " ".join(low.split())
    return f" {low} " if low else ""


def hashed(text: str, buckets: int = BUCKETS, first: int | None = None) -> np.ndarray:
    """Buckets of the n-grams of a cleaned text that start at its `first` characters (default: all)."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint32)
    out, h = [], np.zeros(len(c), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = (h[: len(c) - n + 1] * np.uint32(0x01000193)) ^ (c[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n))
        if n in ORDERS:
            mixed = h[:first] * np.uint32(0x85EBCA6B)
            out.append((mixed ^ mixed >> np.uint32(15)) & np.uint32(buckets - 1))
    return np.concatenate(out)


class Model:
    """Log probabilities of some of the languages, in order of their names: prior by language, and bucket by language."""

    def __init__(self, languages: list[str], prior: np.ndarray, matrix: np.ndarray):
        self.languages, self.prior, self.matrix = languages, prior, matrix

    def best(self, cleaned: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of each cleaned text the likeliest language, its log likelihood, and the logarithm of the sum of all likelihoods."""
        scores = np.tile(self.prior, (len(cleaned), 1))
        todo = [(i, c[at : at + CHUNK + max(ORDERS) - 1]) for i, c in enumerate(cleaned) for at in range(0, len(c), CHUNK)]
        while todo:
            batch, size = [], 0
            while todo and (not batch or size + len(todo[-1][1]) <= CHUNK):
                batch.append(todo.pop())
                size += len(batch[-1][1])
            grams = [hashed(c, self.matrix.shape[1], CHUNK) for _, c in batch]
            starts = np.cumsum([0, *map(len, grams)])[:-1]
            index = np.concatenate(grams)
            owners = np.array([i for i, _ in batch])
            for j in range(len(self.languages)):
                np.add.at(scores[:, j], owners, np.add.reduceat(self.matrix[j][index], starts))
        at, top = scores.argmax(1), scores.max(1)
        return [self.languages[i] for i in at.tolist()], top, top + np.log(np.exp(scores - top[:, None]).sum(1))

    def predict(self, texts: list[str | None], so_far: tuple | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The likeliest language of each text, among those of this block and those so far: name, log likelihood, logarithm of the sum; und without a letter or languages."""
        cleaned = [_clean(t) for t in texts]
        names, top, total = self.best(cleaned) if self.languages else ([UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.inf))
        if so_far:
            before, best, whole = so_far
            names = [a if keep else b for a, b, keep in zip(before, names, (best >= top).tolist())]
            top, total = np.maximum(best, top), np.logaddexp(whole, total)
        return [n if c else UNKNOWN for n, c in zip(names, cleaned)], top, total


def posterior(names: list[str], top: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(np.array(names) == UNKNOWN, 0.0, np.exp(top - total)) if names else np.empty(0)


def held_out(key: str) -> Column:
    """Whether a row is never learned from: CRC-32 of the key as text leaves 2 modulo 4; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, buckets: int = BUCKETS, block: int = BLOCK) -> Iterator[Model]:
    """Learns from rows that are not held out and whose language and text are not null: a model for each block of languages, at least one.

    Each language's rows are thinned to `sample` expected ones by a hash of key and text, so rare languages keep all
    theirs; rows equal in both count once. The driver holds the counts and the matrix of one block at a time, whatever the table's size.
    """
    spark = df.sparkSession
    rows = df.filter(~held_out(key) & F.col(lang).isNotNull())
    path = new_path(spark, "languages")
    sizes = written(rows.groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count("*").alias("n")), "languages", path)
    whole = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    listed = ((r.lang, r.n) for r in sizes.orderBy("lang").toLocalIterator())
    some = list(islice(listed, block))
    if not some:
        yield Model([], np.zeros(0), np.zeros((0, buckets)))
    while some:
        yield _learn(rows, dict(some), whole, text, lang, key, sample, buckets)
        some = list(islice(listed, block))
    drop_path(spark, path)


def _learn(rows: DataFrame, sizes: dict[str, int], whole: int, text: str, lang: str, key: str, sample: int, buckets: int) -> Model:
    languages = sorted(sizes)
    place = {x: i for i, x in enumerate(languages)}
    named = F.col(lang).cast("string")
    share = F.get(F.lit([sample / sizes[x] for x in languages]), F.array_position(F.lit(languages), named).cast("int") - 1)
    mark = F.xxhash64(F.lit("lang"), F.col(key).isNull(), F.col(key), F.col(text))
    drawn = rows.filter(F.col(text).isNotNull() & named.isin(languages)).select(mark.alias("mark"), share.alias("share"), named.alias("lang"), F.col(text).alias("text"))
    picked = drawn.filter(F.pmod("mark", F.lit(1 << 20)) / float(1 << 20) < F.col("share")).dropDuplicates(["mark", "lang"]).select("lang", "text")
    schema = T._parse_datatype_string("lang int, bucket int, n long")

    def count(batches):
        total = np.zeros((len(languages), buckets), np.int64)
        for b in batches:
            for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if c := _clean(t):
                    for at in range(0, len(c), CHUNK):
                        total[place[x]] += np.bincount(hashed(c[at : at + CHUNK + max(ORDERS) - 1], buckets, CHUNK), minlength=buckets)
        rows, columns = np.nonzero(total)
        yield batch_of([rows.astype(np.int32), columns.astype(np.int32), total[rows, columns]], schema)

    counts = np.zeros((len(languages), buckets))
    for r in arrow_map(picked, count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_batches():
        counts[r.column(0).to_numpy(), r.column(1).to_numpy()] = r.column(2).to_numpy()
    matrix = np.log(counts + SMOOTHING) - np.log(counts.sum(1, keepdims=True) + SMOOTHING * buckets)
    return Model(languages, np.log(np.array([sizes[x] for x in languages], float) / whole), matrix)


def identify(df: DataFrame, models: Iterable[Model], text: str = "text") -> DataFrame:
    """df with lang_pred and score, which replace columns of these names; only the text is looked at."""
    keep = [c for c in df.columns if c not in ("lang_pred", "score")]
    return _scored(df.select(*keep), models, keep, keep.index(text))


def _scored(df: DataFrame, models: Iterable[Model], keep: list[str], at: int) -> DataFrame:
    """df: the kept columns, and the text: one of them, or the column behind them. Every block but the last is scored into a table of the shared folder."""
    spark, plain = df.sparkSession, len(df.columns)
    state = [spare(df, f"state{i}") for i in range(3)]
    running = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in zip(state, (T.StringType(), T.DoubleType(), T.DoubleType())))])
    ended = T.StructType([*(df.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def scored(rows: DataFrame, model: Model, last: bool) -> DataFrame:
        shared, more = spark.sparkContext.broadcast(model), len(rows.columns) > plain  # BUCKETS x BLOCK numbers at most

        def run(batches):
            for whole in batches:
                for lo in range(0, whole.num_rows, 512):
                    b = whole.slice(lo, 512)
                    so_far = (b.column(plain).to_pylist(), b.column(plain + 1).to_numpy(), b.column(plain + 2).to_numpy()) if more else None
                    found = shared.value.predict(b.column(at).to_pylist(), so_far)
                    if last:
                        yield batch_of([*(b.column(i) for i in range(len(keep))), found[0], posterior(*found)], ended)
                    else:
                        yield batch_of([*(b.column(i) for i in range(plain)), *found], running)

        return arrow_map(rows, run, ended if last else running)

    models = iter(models)
    model, was = next(models), None
    for following in models:
        path = new_path(spark, "languages-so-far")
        df = written(scored(df, model, False), "", path)
        if was:
            drop_path(spark, was)
        model, was = following, path
    return scored(df, model, True)


def language_id(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """For each row: key, held_out, lang_pred (a learned language, und for a text that is null or has no letter), score (0 to 1; 0 for und).

    Whole texts are scored. Ties go to the first language by name. Repeated rows repeat, a null key stays
    null, an empty table gives none; without any labelled text all are und.
    """
    rows = df.select(F.col(key), held_out(key).alias("held_out"), F.col(text).alias(f"{key}_text"))
    return _scored(rows, train(df, text, lang, key, sample, block=block), [key, "held_out"], 2)
