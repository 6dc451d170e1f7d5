"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins.  Boosting goes round the features; in its
turn a feature gets a shallow tree on the current gradients, which adds to the
feature's lookup table.  The strongest pairs of features, by the gain of one cut
in each on what is left, then get tables of their own the same way.  A score is
the intercept plus one table entry for each feature and pair: vectorised bin
additions.

The model is fitted on a bounded sample of labelled rows (`SAMPLE`, chosen by a
hash of doc_id).  Features are computed once for every whole text and kept in the
shared folder.

Defined cases: a null text counts as empty; its features are 0 and it is scored.
Without a labelled row the score is 0.5; with one class only, the share of
labels, smoothed.  Null labels are left out; repeated labels each count.  A
document without doc_id is held out, and scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, settled, ship, slices, table, utf8
from .langid import held_out
from .perplexity import measures, per_doc

#: Labelled rows that are fitted on, nearly; twice as many at most.
SAMPLE = 20_000
BINS, ROUNDS, RATE, CUTS, LEAST = 32, 150, 0.15, 3, 10.0
PAIRS, PAIR_BINS, PAIR_ROUNDS = 4, 8, 60
THRESHOLD = 0.3
FEATURES = (
    "log_words", "word_length", "symbols", "digits", "capitals", "marks", "shouts", "other_bytes",
    "repeated_lines", "repeated_windows", "repeated_neighbours", "distinct_words", "line_length", "longest_word",
)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_DIGITS, _CAPITALS = _table(b"0123456789"), _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MARKS, _SHOUTS = _table(b".,;:'\"()-"), _table(b"!?")


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of `FEATURES` for each document."""
    n = len(bounds) - 1
    m = measures(data, bounds)
    words = Words(data, bounds)
    h, doc = words.hashes(), words.doc

    def within(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])

    size = np.maximum(np.diff(bounds), 1)
    count = np.maximum(words.counts, 1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    lines = within(data == 10) + 1
    longest = np.zeros(n)
    np.maximum.at(longest, doc, words.end - words.start)
    # Words of a document that it has at an earlier place too are those beyond its distinct ones.
    order = np.argsort(per_doc(h, doc))
    keys = per_doc(h, doc)[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    own = np.bincount(doc[order][first], minlength=n)
    columns = [
        np.log1p(words.counts), m["word_chars"] / count, m["n_symbols"] / size, within(_DIGITS[data]) / size,
        within(_CAPITALS[data]) / size, within(_MARKS[data]) / size, within(_SHOUTS[data]) / size, within(data >= 128) / size,
        m["n_dup_lines"] / lines, m["n_repeat_words"] / count, np.bincount(doc[same], minlength=n) / count, own / np.sqrt(count),
        np.log1p(size / lines), np.log1p(longest),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], 1)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = utf8(batch.column(1))
        for i, j in slices(bounds):
            x = features(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            flat = pa.array(x.ravel())
            cut = pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(cut, flat)], ["doc_id", "x"])


@dataclass
class Gam:
    edges: list[np.ndarray]
    bias: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]

    def coarse(self, j: int, b: np.ndarray) -> np.ndarray:
        return b * PAIR_BINS // (len(self.edges[j]) + 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        bins = self.bins(x)
        out = np.full(len(x), self.bias)
        for t, b in zip(self.tables, bins, strict=True):
            out += t[b]
        for j, k, t in self.pairs:
            out += t[self.coarse(j, bins[j]), self.coarse(k, bins[k])]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def shallow_tree(g: np.ndarray, h: np.ndarray, cuts: int = CUTS) -> np.ndarray:
    """The leaf value of each bin, of a greedy tree with so many cuts; g, h: sums of
    gradients and hessians by bin."""
    leaves = [(0, len(g))]
    for _ in range(cuts):
        best = (1e-9, None, None)
        for at, (a, b) in enumerate(leaves):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gt, ht = g[a:b].sum(), h[a:b].sum()
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(hl < LEAST / 4) | (ht - hl < LEAST / 4)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), at, a + k + 1)
        if best[1] is None:
            break
        a, b = leaves.pop(best[1])
        leaves += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _pair_gain(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut in each of two features, its gain over none and the four leaves' values."""
    best = (0.0, np.zeros_like(g))
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total = cg[-1, -1] ** 2 / (ch[-1, -1] + 1)
    for i in range(len(g) - 1):
        for j in range(g.shape[1] - 1):
            gs = np.array([cg[i, j], cg[i, -1] - cg[i, j], cg[-1, j] - cg[i, j], cg[-1, -1] - cg[i, -1] - cg[-1, j] + cg[i, j]])
            hs = np.array([ch[i, j], ch[i, -1] - ch[i, j], ch[-1, j] - ch[i, j], ch[-1, -1] - ch[i, -1] - ch[-1, j] + ch[i, j]])
            gain = float((gs**2 / (hs + 1)).sum() - total)
            if gain > best[0]:
                v = -gs / (hs + 1)
                t = np.empty_like(g)
                t[: i + 1, : j + 1], t[: i + 1, j + 1 :], t[i + 1 :, : j + 1], t[i + 1 :, j + 1 :] = v
                best = (gain, t)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """A model of labels y (0 or 1) on feature rows x."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    model = Gam(edges)
    p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    model.bias = float(np.log(p / (1 - p)))
    model.tables = [np.zeros(len(e) + 1) for e in edges]
    if not len(y) or y.min() == y.max():
        return model
    bins = model.bins(x)
    out = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-out))
        return q - y, q * (1 - q)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = slopes()
            n = len(model.tables[j])
            step = RATE * shallow_tree(np.bincount(b, g, n), np.bincount(b, h, n))
            model.tables[j] += step
            out += step[b]
    g, h = slopes()
    coarse = [model.coarse(j, b) for j, b in enumerate(bins)]

    def sums(j: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = coarse[j] * PAIR_BINS + coarse[k]
        return tuple(np.bincount(at, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in slopes())

    every = [(j, k) for j in range(len(bins)) for k in range(j)]
    strongest = sorted(every, key=lambda jk: -_pair_gain(*sums(*jk))[0])[:PAIRS]
    model.pairs = [(j, k, np.zeros((PAIR_BINS, PAIR_BINS))) for j, k in strongest]
    for _ in range(PAIR_ROUNDS):
        for j, k, t in model.pairs:
            step = RATE * _pair_gain(*sums(j, k))[1]
            t += step
            out += step[coarse[j], coarse[k]]
    return model


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(x))], ["doc_id", "score"])

    return run


def train(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Gam:
    """A model from feature rows (doc_id, x) and labels (doc_id, quality).

    A hash of doc_id picks about `sample` of the labelled rows; where a few ids have very many
    rows it may pick more, of which the first 2 * sample by id count."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "quality")
    both = settled(rows.where(~held_out()).join(known, "doc_id"))
    share = min(1.0, sample / max(both.count(), 1))
    some = both.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).sort("doc_id", "quality", "x")
    got = some.limit(2 * sample).toArrow()
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return fit(x, (got["quality"].to_numpy() == 1).astype(np.float64))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("x", T.ArrayType(T.DoubleType()))])
    rows = table(docs.select("doc_id", "text").mapInArrow(_featured, schema), "features")
    model = spark.sparkContext.broadcast(train(rows, labels))
    out = rows.mapInArrow(_scored(model), T.StructType([schema[0], T.StructField("score", T.DoubleType())]))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
