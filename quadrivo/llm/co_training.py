"""Quality classifier by co-training.

Two views of a document have a classifier each: the text content (which words occur, hashed) and the page
metadata (source, language, size and layout: shares of capitals, signs, line lengths; binned). Both learn from a bounded sample of labelled
documents; then, over rounds, each scores all unlabelled documents on the executors and adds its most confident verdicts, for each
class, to the other's training set. Each view's score is calibrated on labelled documents that neither has learned from, and a combination of the
calibrated views, which lets either veto, scores all documents.

Every text is read once: its features are written to the shared folder (two bytes for each distinct word and beginning of a word, eleven numbers), and rounds and
verdicts work on these. The driver holds the features of the labelled sample, bounded in rows and in words, and of the verdicts handed over: so many a view, class and round, each
of 2**16 word buckets at most, however long its text is. It holds them in two bytes each, some times over, and never a wider form of all of them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_map, batch_of, column_type, drop_path, new_path, written

#: Buckets of words, of categories; bins of a number. Expected documents of the labelled sample, the most distinct words in all of them; rounds, and the
#: verdicts of a class that a view hands over in one round.
WORDS, CATEGORIES, BINS = 1 << 16, 128, 12
SAMPLE, SAMPLE_WORDS, ROUNDS, HANDED, CONFIDENT = 12_000, 8_000_000, 3, 50, 0.95
#: Beginnings of words that are features too, as words are inflected; steps of a view's first fit and of later ones, which go on from it; how strongly log-odds are drawn in
#: by their standard errors, so that words seen by chance on one side weigh little; weight of a verdict beside a label.
BEGINNINGS, STEPS, ERRORS, VOUCHED = (4, 6), (40, 10), 4.0, 0.25
#: Words that a Python worker remembers; features that a product is worked out for at a time.
MEMORY, PIECE = 400_000, 1 << 18
NUMBERS = ("log_chars", "log_lines", "line_chars", "upper", "signs", "digits", "bangs", "spaces", "repeats")
_WORD = re.compile(r"\w+")
_UPPER, _SIGNS, _DIGITS, _SPACES = (bytes(c for c in range(128) if test(chr(c))) for test in (str.isupper, lambda c: not c.isalnum() and not c.isspace() and c.isprintable() and c not in ".,;:'!?-\"", str.isdigit, str.isspace))


def numbers(text: str | None) -> list[float]:
    """NUMBERS of a whole text."""
    raw = (text or "").encode()
    n = max(1, len(raw))
    lost = lambda drop: (len(raw) - len(raw.translate(None, drop))) / n
    lines, words = raw.count(b"\n") + 1, raw.split()
    return [math.log1p(len(raw)), math.log1p(lines), len(raw) / lines, lost(_UPPER), lost(_SIGNS), lost(_DIGITS), raw.count(b"!") / n, lost(_SPACES), 1 - len(set(words)) / max(1, len(words))]


def categories(*values: str | None) -> list[int]:
    return [zlib.crc32(f"{i}:{v}".encode()) % CATEGORIES for i, v in enumerate(values)]


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS


def buckets(text: str | None, known: dict[str, tuple[int, ...]]) -> set[int]:
    """Buckets of a text's words and their beginnings; known remembers those of words met before."""
    found: set[int] = set()
    for w in words(text):
        b = known.get(w)
        if b is None:
            b = known[w] = (bucket(w), *(bucket(f"{w[:n]}*") for n in BEGINNINGS if len(w) > n))
        found.update(b)
    if len(known) > MEMORY:
        known.clear()
    return found


class Sparse:
    """Rows of active features, the constant `size` in each. They are kept as they come, flat, with each row's count; what a product needs for each of them is made for some
    rows at a time, so that it doesn't grow with them."""

    def __init__(self, rows: list[np.ndarray], size: int):
        self._set(np.concatenate(rows) if rows else np.empty(0, np.int64), np.array(list(map(len, rows)), np.int64), size)

    @classmethod
    def flat(cls, index: np.ndarray, sizes: np.ndarray, size: int) -> Sparse:
        """From the features of all rows, one row after another, and how many each row has."""
        made = object.__new__(cls)
        made._set(index, sizes, size)
        return made

    def _set(self, index: np.ndarray, sizes: np.ndarray, size: int) -> None:
        self.size, self.n, self.index, self.sizes = size, len(sizes), index, sizes

    def dot(self, w: np.ndarray) -> np.ndarray:
        made = np.empty(self.n)
        for rows, places in pieces(self.sizes):
            made[rows] = np.bincount(np.repeat(np.arange(rows.stop - rows.start), self.sizes[rows]), w[self.index[places]], rows.stop - rows.start)
        return made + w[-1]

    def back(self, g: np.ndarray) -> np.ndarray:
        made = np.zeros(self.size + 1)
        for rows, places in pieces(self.sizes):
            np.add.at(made, self.index[places].astype(np.intp), np.repeat(g[rows], self.sizes[rows]))
        made[-1] = np.bincount(np.zeros(self.n, np.intp), g, 1)[0]
        return made

    def take(self, which: np.ndarray) -> Sparse:
        return Sparse.flat(taken(self.index, self.sizes, which), self.sizes[which], self.size)


def pieces(sizes: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Rows, of so many features each, in runs of PIECE features (but a row at least): the rows' places, and their features' places."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        start = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, start + PIECE, side="right")))
        yield slice(lo, hi), slice(start, int(ends[hi - 1]))
        lo = hi


def taken(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The features of some of the rows."""
    ends = np.cumsum(sizes)
    return np.concatenate([np.empty(0, flat.dtype), *(flat[ends[i] - sizes[i] : ends[i]] for i in which)])


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: Sparse, y: np.ndarray, weight: np.ndarray, rare: int, scaled: np.ndarray | None = None, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression on features scaled by their log-odds ratio, drawn in by ERRORS (features of fewer than `rare` rows are left out), by Adam: weights, the constant's
    last, and the scaled weights, from which a later fit may go on."""
    if not x.n or y.min() == y.max():
        w = np.zeros(x.size + 1)
        w[-1] = 0.0 if not x.n else 4.0 * (2 * y[0] - 1)
        return w, np.zeros(x.size + 1)
    pos, neg, seen = x.back(y * weight), x.back((1 - y) * weight), x.back(np.ones(x.n))
    ratio = np.log((pos + 1) / (pos[-1] + 2)) - np.log((neg + 1) / (neg[-1] + 2))
    ratio *= ratio**2 / (ratio**2 + ERRORS**2 * (1 / (pos + 1) + 1 / (neg + 1)))
    ratio[seen < rare] = 0
    ratio[-1] = 1
    w, m, v = np.zeros(x.size + 1) if scaled is None else scaled.copy(), np.zeros(x.size + 1), np.zeros(x.size + 1)
    total = weight.sum()
    for step in range(1, STEPS[scaled is not None] + 1):
        g = ratio * x.back((sigmoid(x.dot(ratio * w)) - y) * weight) / total + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return ratio * w, w


def _dense_fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method; x has a constant column."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    edges: np.ndarray
    text: np.ndarray
    meta: np.ndarray
    calibration: list[np.ndarray]
    joint: np.ndarray
    known: dict = field(default_factory=dict, repr=False)

    def meta_features(self, values: np.ndarray, cats: np.ndarray) -> np.ndarray:
        """Active features of each row: a bin of each number, then the categories."""
        bins = np.stack([j * (BINS + 1) + np.searchsorted(self.edges[j], values[:, j], side="right") for j in range(len(NUMBERS))], 1)
        return np.concatenate([bins, len(NUMBERS) * (BINS + 1) + cats], 1)

    def combine(self, zt: np.ndarray, zm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the views and of both together."""
        ct, cm = (c[0] + c[1] * z for c, z in zip(self.calibration, (zt, zm)))
        joint = np.stack([np.ones_like(ct), np.clip(ct, -8, 8), np.clip(cm, -8, 8), np.minimum(np.clip(ct, -8, 8), np.clip(cm, -8, 8))], 1) @ self.joint
        return sigmoid(ct), sigmoid(cm), sigmoid(joint)

    def text_score(self, text: str | None) -> float:
        found = sorted(buckets(text, self.known))
        return float(self.text[-1]) + (float(self.text[found].sum()) if found else 0.0)


def _meta_size() -> int:
    return len(NUMBERS) * (BINS + 1) + CATEGORIES


@dataclass
class Rows:
    """Features of documents: an id that equal contents share, numbers and categories side by side, word buckets (sorted, flat, with each document's count)."""

    ids: np.ndarray
    meta: np.ndarray
    flat: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, ids, meta: list[bytes], words: list[bytes]) -> Rows:
        """From columns of the features table."""
        return cls(np.array(ids, np.int64), np.frombuffer(b"".join(meta)).reshape(-1, META), np.frombuffer(b"".join(words), "<u2"), np.array([len(w) // 2 for w in words], np.int64))

    @classmethod
    def joined(cls, parts: list[Rows]) -> Rows:
        return parts[0] if len(parts) == 1 else cls(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("ids", "meta", "flat", "sizes")))

    def take(self, which: np.ndarray) -> Rows:
        return Rows(self.ids[which], self.meta[which], taken(self.flat, self.sizes, which), self.sizes[which])

    def view(self, model: Model, which: int) -> Sparse:
        """The text's features, or those of the metadata."""
        if not which:
            return Sparse.flat(self.flat, self.sizes, WORDS)
        features = model.meta_features(self.meta[:, : len(NUMBERS)], self.meta[:, len(NUMBERS) :].astype(np.int64))
        return Sparse.flat(features.ravel(), np.full(len(features), features.shape[1]), _meta_size())

    def scores(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """What each view's weights add up to."""
        text = np.empty(len(self.sizes))
        for rows, places in pieces(self.sizes):
            sizes = self.sizes[rows]
            ends = np.cumsum(sizes)
            sums = np.add.reduceat(np.r_[0.0, model.text[self.flat[places]], 0.0], np.stack([ends - sizes + 1, ends + 1], 1).ravel())[::2]
            text[rows] = np.where(sizes > 0, sums, 0.0)
        text += model.text[-1]
        features = model.meta_features(self.meta[:, : len(NUMBERS)], self.meta[:, len(NUMBERS) :].astype(np.int64))
        return text, model.meta[features].sum(1) + model.meta[-1]


META = len(NUMBERS) + 2


def verdicts(model: Model, rows: Rows, told: list[set[int]], handed: int) -> list[tuple[np.ndarray, ...]]:
    """For each view that is told: ids, sureness, classes and numbers of words of the other view's `handed` surest verdicts of each class, one for equal
    contents, on rows it was not told of before and is not of the other opinion on: toxic words are seen in texts only, so metadata can't vouch for their absence."""
    probability = [sigmoid(z) for z in rows.scores(model)]
    found = []
    for other in (0, 1):
        p, there = probability[1 - other], probability[other]
        firm = (np.maximum(p, 1 - p) >= CONFIDENT) & ((p > 0.5) == (there > 0.5)) & ~np.isin(rows.ids, np.fromiter(told[other], np.int64, len(told[other])))
        found.append(surest(rows.ids[firm], np.abs(p[firm] - 0.5), p[firm] > 0.5, rows.sizes[firm], handed))
    return found


def surest(ids: np.ndarray, sure: np.ndarray, good: np.ndarray, n: np.ndarray, handed: int) -> tuple[np.ndarray, ...]:
    """One of each id, and of these the `handed` surest of each class."""
    _, first = np.unique(ids, return_index=True)
    order = first[np.lexsort((ids[first], -sure[first]))]
    kept = np.concatenate([order[good[order] == c][:handed] for c in (True, False)])
    return ids[kept], sure[kept], good[kept], n[kept]


def learn(rows: Rows, y: np.ndarray, held: np.ndarray, exchange: Callable[[Model, list[set[int]]], list[tuple[Rows, np.ndarray]]], rounds: int = ROUNDS) -> Model:
    """The model of labelled rows, of which `held` are for calibration only. exchange gives, for each view, the rows and classes that the other hands to it."""
    numbers_ = rows.meta[:, : len(NUMBERS)]
    edges = np.stack([np.quantile(numbers_[:, j], np.linspace(0, 1, BINS + 2)[1:-1]) if len(y) else np.zeros(BINS) for j in range(len(NUMBERS))])
    model = Model(edges, np.zeros(WORDS + 1), np.zeros(_meta_size() + 1), [np.array([0.0, 1.0])] * 2, np.array([0.0, 0.5, 0.5, 0.0]))
    if not len(y):
        return model
    own = rows.take(np.flatnonzero(~held))
    parts = [[(own, y[~held].astype(float), 1.0)] for _ in (0, 1)]
    told: list[set[int]] = [set(own.ids.tolist()) | set(rows.ids[held].tolist()) for _ in (0, 1)]
    scaled: list[np.ndarray | None] = [None, None]
    for step in range(rounds + 1):
        weights = []
        for view, rare in ((0, 3), (1, 1)):
            x = Rows.joined([p for p, _, _ in parts[view]]).view(model, view)
            target = np.concatenate([t for _, t, _ in parts[view]])
            weight = np.concatenate([np.full(len(t), w) for _, t, w in parts[view]])
            w, scaled[view] = fit(x, target, weight, rare, scaled[view])
            weights.append(w)
        model.text, model.meta = weights
        if step == rounds:
            break
        for view, (more, good) in enumerate(exchange(model, told)):
            if len(good):
                parts[view].append((more, good.astype(float), VOUCHED))
                told[view] |= set(more.ids.tolist())
    if held.any() and 0 < y[held].mean() < 1:
        z = rows.take(np.flatnonzero(held)).scores(model)
        model.calibration = [_dense_fit(np.stack([np.ones(len(s)), s], 1), y[held]) for s in z]
        a, b = (np.clip(c[0] + c[1] * s, -8, 8) for c, s in zip(model.calibration, z))
        model.joint = _dense_fit(np.stack([np.ones(len(a)), a, b, np.minimum(a, b)], 1), y[held])
    return model


def _draw(salt: str, *c: Column) -> Column:
    """A number from 0 to below 1, by hash."""
    return F.pmod(F.xxhash64(F.lit(salt), *c), F.lit(1 << 24)) / float(1 << 24)


def features(df: DataFrame, text: str, key: str, source: str, lang: str) -> DataFrame:
    """_key, _id (a hash of the content that the views look at), _n (its distinct word buckets), _meta and _words (binary) of each row, written to the shared folder."""
    t, s, g = F.col(text), F.col(source).cast("string"), F.col(lang).cast("string")
    content = F.xxhash64(*(x for c in (t, s, g) for x in (F.coalesce(c, F.lit("")), c.isNull())))
    schema = T.StructType([T.StructField("_key", column_type(df, key)), *T._parse_datatype_string("_id long, _n int, _meta binary, _words binary")])

    def run(batches):
        known: dict[str, tuple[int, ...]] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                texts, s, g = (b.column(i).to_pylist() for i in (2, 3, 4))
                meta = [np.array([*numbers(x), *categories(*c)], "<f8").tobytes() for x, c in zip(texts, zip(s, g))]
                found = [np.array(sorted(buckets(x, known)), "<u2") for x in texts]
                yield batch_of([b.column(0), b.column(1), [len(x) for x in found], meta, [x.tobytes() for x in found]], schema)

    return written(arrow_map(df.select(F.col(key).alias("_key"), content.alias("_id"), t.alias("_text"), s.alias("_source"), g.alias("_lang")), run, schema), "features")


def fetched(made: DataFrame, ids: list[int]) -> Rows:
    """Features of the contents with these ids, each once, in the order of the ids."""
    wanted = made.sparkSession.createDataFrame([(i,) for i in ids], "_id long")  # those of a bounded sample, or of the verdicts handed over
    rows = made.join(F.broadcast(wanted), "_id", "left_semi").groupBy("_id").agg(F.first("_meta").alias("_meta"), F.first("_words").alias("_words"))
    got = {i: (m, w) for i, m, w in zip(*(c.to_pylist() for c in rows.toArrow().columns))}
    ids = [i for i in ids if i in got]
    return Rows.of(ids, [got[i][0] for i in ids], [got[i][1] for i in ids])


def _labelled(made: DataFrame, labels: DataFrame, key: str, sample: int, most_words: int) -> tuple[Rows, np.ndarray, np.ndarray]:
    """The sample: features, whether good, whether held back for calibration. Distinct keys are drawn first, so that those that are joined are
    few, then the distinct contents of their rows, as a key may have any number of them."""
    bad = F.greatest(1 - F.col("quality").cast("int"), F.coalesce(F.col("toxic").cast("int"), F.lit(0)))
    path = new_path(made.sparkSession, "labels")
    known = written(labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(key).alias("_key")).agg((1 - F.max(bad)).alias("_y")), "labels", path)
    picked = known.filter(_draw("labelled", F.col("_key")) < sample / max(1, known.count()))
    rows = made.select("_key", "_id", "_n").join(F.broadcast(picked), "_key")
    contents = written(rows.groupBy("_id").agg(F.min("_y").alias("y"), F.first("_n").alias("n")), "contents")
    total = contents.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    share = min(1.0, sample / max(1, total.rows), most_words / max(1, total.words))
    got = sorted((r._id, r.y) for r in contents.filter(_draw("content", F.col("_id")) < share).collect())
    ids = [i for i, _ in got]
    drop_path(made.sparkSession, path)
    held = np.array([i % 4 == 0 for i in ids], bool)
    return fetched(made, ids), np.array([y for _, y in got], np.int64), held


def co_train(made: DataFrame, labels: DataFrame, key: str = "doc_id", sample: int = SAMPLE, handed: int = HANDED, rounds: int = ROUNDS, most_words: int = SAMPLE_WORDS) -> Model:
    """The model of a features table and labels (see train)."""
    rows, y, held = _labelled(made, labels, key, sample, most_words)
    schema = T._parse_datatype_string("view int, id long, sure double, good boolean, n long")

    def exchange(model: Model, told: list[set[int]]) -> list[tuple[Rows, np.ndarray]]:
        shared = made.sparkSession.sparkContext.broadcast((model, told))  # two weight vectors, and the ids of the bounded training sets

        def run(batches):
            (model, told), best = shared.value, [(np.empty(0, np.int64), np.empty(0), np.empty(0, bool), np.empty(0, np.int64))] * 2
            for b in batches:
                found = verdicts(model, Rows.of(*(b.column(i).to_pylist() for i in range(3))), told, handed)
                best = [surest(*(np.concatenate(c) for c in zip(old, new)), handed) for old, new in zip(best, found)]
            for view, found in enumerate(best):
                yield batch_of([np.full(len(found[0]), view, np.int32), *found], schema)

        # A task sends on no more than could be among the surest of all.
        sent = arrow_map(made.select("_id", "_meta", "_words"), run, schema).groupBy("view", "id", "good").agg(F.max("sure").alias("sure"), F.first("n").alias("n"))
        order = Window.partitionBy("view", "good").orderBy(F.desc("sure"), "id")
        chosen = [{}, {}]
        for r in sent.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= handed).collect():
            chosen[r.view][r.id] = r.good
        every = fetched(made, sorted(set(chosen[0]) | set(chosen[1])))
        shared.destroy()
        place = {i: n for n, i in enumerate(every.ids.tolist())}
        return [(every.take(np.array([place[i] for i in sorted(c)], np.int64)), np.array([c[i] for i in sorted(c)], bool)) for c in chosen]

    return learn(rows, y, held, exchange, rounds)


def train(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns to tell documents labelled quality 1 and not toxic from the rest.

    Of the distinct labelled keys `sample` expected ones are drawn, of the distinct contents of their rows as many, and fewer where these
    have over SAMPLE_WORDS distinct words in all. All other rows are unlabelled, and all of them take part in every round of the exchange.
    Null keys and labels are left out; of several labels of a key or content the worst counts.
    """
    made = features(df, text, key, source, lang)
    return co_train(made, labels, key, sample)


def score(df: DataFrame, model: Model, keep: list[str], text: str = "text", source: str = "source", lang: str = "lang", threshold: float = 0.5) -> DataFrame:
    """The kept columns (none named as these) with text_prob, meta_prob, quality_prob (calibrated, of being good) and kept (quality_prob >= threshold) for every row."""
    out = T._parse_datatype_string("text_prob double, meta_prob double, quality_prob double, kept boolean")
    schema = T.StructType([*(df.schema[c] for c in keep), *out])
    shared, k = df.sparkSession.sparkContext.broadcast(model), len(keep)  # two weight vectors of fixed size
    # What is kept is not sent twice.
    more = [c for c in (text, source, lang) if c not in keep]
    places = [[*keep, *more].index(c) for c in (text, source, lang)]

    def run(batches):
        model = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                texts, s, g = (b.column(i).to_pylist() for i in places)
                zt = np.array([model.text_score(t) for t in texts])
                features = model.meta_features(np.array([numbers(t) for t in texts]), np.array([categories(*c) for c in zip(s, g)]))
                pt, pm, p = model.combine(zt, model.meta[features].sum(1) + model.meta[-1])
                yield batch_of([*(b.column(i) for i in range(k)), pt, pm, p, p >= threshold], schema)

    return arrow_map(df.select(*keep, *more), run, schema)


def quality_classifier(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", lang: str = "lang", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """For each row: key, text_prob, meta_prob, quality_prob, kept.

    A null text counts as empty, null source and lang are values of their own. Repeated rows repeat, a null key stays
    null, an empty table gives none. Without labels of both kinds all rows get the verdict of the one kind, or 0.5 (kept).
    """
    made = features(df, text, key, source, lang)
    shared = df.sparkSession.sparkContext.broadcast(co_train(made, labels, key, sample))
    schema = T.StructType([T.StructField(key, column_type(df, key)), *T._parse_datatype_string("text_prob double, meta_prob double, quality_prob double, kept boolean")])

    def run(batches):
        for b in batches:
            pt, pm, p = shared.value.combine(*Rows.of(*(b.column(i).to_pylist() for i in (1, 2, 3))).scores(shared.value))
            yield batch_of([b.column(0), pt, pm, p, p >= threshold], schema)

    return arrow_map(made.select("_key", "_id", "_meta", "_words"), run, schema)
