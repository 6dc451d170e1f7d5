"""Quality rules with n-gram perplexity.

The language model is a modified Kneser-Ney model of order 5 over code points.  A
text counts as its words joined by single spaces.  Spark counts the n-grams of all
documents, every one with its exact code points; nothing is folded, pruned or capped,
so what the model gathers grows with the corpus.

A document must not vouch for itself: texts are dealt into two folds by their checksum
(so exact copies share a fold), and each fold is scored by the model of the other.
The probabilities of all n-grams that a fold needs come from joins between n-gram
tables, order by order, and are stored in arrays sorted by n-gram hash.  Up to
`HASHES` n-grams the arrays are broadcast; a larger model is dealt out instead: texts
go in blocks of `BLOCK_BYTES`, each with the sorted array of just its own n-grams.

A text's perplexity is per letter: its bits over its letters and digits (any code point
beyond ASCII counts), so signs cost bits without making a text longer.
Each language gets a band of bits per letter from the distribution over all
its documents: the quartiles, widened by `FENCE` interquartile ranges.  A
document outside its language's band is rejected, as is one that fails the
base rules.

Defined cases: a null or empty text has no words and fails the base rules.  A
null language is a language of its own.  Repeated rows are judged alike, each
on its own.  With one fold empty all n-grams of the other are equally likely.  An
empty table gives an empty result.  Other columns pass through unless a metric's
name clashes, in which case the metric's name gets a `_`.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, Words, distinct, forget, fresh, give_back, mix, settled, ship, slices, small, table, utf8

ORDER = 5
#: Largest number of n-grams (12 bytes each) whose probabilities are broadcast.
HASHES = 4_000_000
#: Bytes of text of a block, where they aren't.
BLOCK_BYTES = 4 << 20
#: Bytes of text whose n-grams a task works out at once: some 150 bytes for each.
PART_BYTES = SLICE_BYTES // 2
#: N-grams that a task holds before it sums their counts up; it hands on half as many distinct ones.
HELD = 1_000_000
#: Symbols that are sorted at once, in words of the place and of numbers of so many bits.
PLACE, SHORT = 20, 8
STRETCH = 1 << PLACE
#: Base rules: fewest words, and the largest share of words in repeated windows.
MIN_WORDS = 20
MAX_REPEATED = 30
REPEAT_WINDOW = 8
#: Interquartile ranges that a band reaches beyond the quartiles, on both sides.
FENCE = 4.0
#: Bits are summed as whole numbers of 2^-16, so any order of adding gives the same sum.
UNIT = 1 << 16
#: Histogram bins for each bit per letter.
BINS = 256
SYMBOLS = b"#*$%&|<>"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURED = (*METRICS, "n_letters", "units")

#: A symbol is a code point and 1, in 21 bits; 0 stands before a text.
POINT = 21
ONE, TWO = (1 << POINT) - 1, (1 << 2 * POINT) - 1
GRAM = ["fold", "hi", "lo"]
_is_symbol = np.zeros(256, bool)
_is_symbol[list(SYMBOLS)] = True
#: By byte: ASCII letters and digits, and the first byte of any other code point.
_is_letter = np.array([chr(b).isalnum() if b < 0x80 else b >= 0xC0 for b in range(256)])


# ---------------------------------------------------------------- n-grams of texts


def symbols(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all documents, each with single spaces, and each document's bounds among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
    space = (points == 32) | ((points >= 9) & (points <= 13))
    before = np.ones(len(points), bool)
    before[1:] = space[:-1]
    before[at[:-1][at[:-1] < len(points)]] = True
    keep = ~(space & before)
    at = np.concatenate([[0], np.cumsum(keep)])[at]
    return np.where(space, np.uint32(32), points)[keep] + np.uint32(1), at


@dataclass
class Grams:
    """The distinct n-grams that end at some places: their fold, their first two symbols and their
    last three, the places in the order of the n-grams, and how many each has."""

    fold: np.ndarray
    hi: np.ndarray
    lo: np.ndarray
    places: np.ndarray
    n: np.ndarray

    @property
    def hashes(self) -> np.ndarray:
        return hashed(self.fold, self.hi, self.lo)


def grams(data: np.ndarray, bounds: np.ndarray) -> tuple[list[Grams], np.ndarray]:
    """The n-grams of all documents, by stretches of `STRETCH` symbols, and each document's bounds
    among the symbols."""
    c, at = symbols(data, bounds)
    fold = np.repeat(folds(data, bounds), np.diff(at))
    own = np.minimum(np.arange(len(c)) - np.repeat(at[:-1], np.diff(at)), ORDER - 1).astype(np.uint8)
    return [_distinct(c, own, fold, i, min(i + STRETCH, len(c))) for i in range(0, len(c), STRETCH)], at


def _back(c: np.ndarray, own: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The symbols k before some places; 0 before a document's first."""
    return np.where(own[places] >= k, c[places - k], 0).astype(np.uint64)


def _packed(c: np.ndarray, own: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hi, lo = np.zeros(len(places), np.uint64), np.zeros(len(places), np.uint64)
    for k in range(ORDER):
        if k < 3:
            lo |= _back(c, own, places, k) << np.uint64(POINT * k)
        else:
            hi |= _back(c, own, places, k) << np.uint64(POINT * (k - 3))
    return hi, lo


def _distinct(c: np.ndarray, own: np.ndarray, fold: np.ndarray, start: int, end: int) -> Grams:
    used = np.flatnonzero(np.bincount(c[max(0, start - ORDER) : end]))
    if len(used) < 1 << SHORT:
        # Few symbols: their numbers and the place fill one word, and sorting words is quick.
        number = np.zeros(used[-1] + 1, np.uint8)
        number[used] = np.arange(1, len(used) + 1)
        first = max(0, start - ORDER)
        short = number[c[first:end]]
        word = fold[start:end] << np.uint64(SHORT * ORDER + PLACE)
        word |= np.arange(end - start, dtype=np.uint64)
        for k in range(ORDER):
            past = np.zeros(end - start, np.uint64)
            skip = max(0, k - (start - first))
            past[skip:] = short[start - first + skip - k : end - first - k]
            past[own[start:end] < k] = 0
            word |= past << np.uint64(SHORT * k + PLACE)
        word.sort()
        places = (word & np.uint64(STRETCH - 1)).astype(np.int64) + start
        word >>= np.uint64(PLACE)
    else:
        every = np.arange(start, end)
        word = hashed(fold[start:end], *_packed(c, own, every))
        order = np.argsort(word)
        word, places = word[order], every[order]
    at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    hi, lo = _packed(c, own, places[at])
    return Grams(fold[places[at]], hi, lo, places, np.diff(np.append(at, len(word))))


def folds(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The fold of each document: the same for the same text."""
    view = memoryview(np.ascontiguousarray(data))
    return np.fromiter((zlib.crc32(view[a:b]) & 1 for a, b in zip(bounds[:-1], bounds[1:], strict=True)), np.uint64, len(bounds) - 1)


def hashed(fold: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """A 64-bit hash of an n-gram in a fold."""
    return mix(mix(hi ^ (fold << np.uint64(60))) ^ lo)


def _counted(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], [], []]  # hashes, fold, hi, lo and n

        def whole(k: int) -> np.ndarray:
            x = np.concatenate(held[k])
            held[k].clear()  # so that no two columns stand twice at a time
            return x

        def merged() -> None:
            h = whole(0)
            order = np.argsort(h)
            h = h[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            held[0].append(h[at])
            del h
            held[4].append(np.add.reduceat(whole(4)[order], at))
            order = order[at]
            for k in (1, 2, 3):
                held[k].append(whole(k)[order])

        def given() -> Iterator[pa.RecordBatch]:
            _, *columns = (x.pop() for x in held)
            for i in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)].astype(np.int64)) for x in columns], [*GRAM, "n"])

        for batch in batches:
            data, bounds = utf8(batch.column(column))
            for i, j in slices(bounds, PART_BYTES):
                for g in grams(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])[0]:
                    for x, own in zip(held, (g.hashes, g.fold.astype(np.uint8), g.hi, g.lo, g.n), strict=True):
                        x.append(own)
                if len(held[0]) > 1 and sum(map(len, held[0])) > HELD:
                    merged()
                    if len(held[0][0]) > HELD // 2:
                        yield from given()
        if held[0]:
            merged()
            yield from given()
        give_back()

    return run


# ---------------------------------------------------------------- the model


def _suffix(k: int) -> list:
    """The last k symbols of an n-gram."""
    hi = F.col("hi") if k == ORDER else F.expr(f"hi & {ONE}L") if k == 4 else F.lit(0).cast("long")
    lo = F.expr(f"lo & {(ONE, TWO)[k - 1]}L") if k < 3 else F.col("lo")
    return [hi, lo]


def _context() -> list:
    """All but the last symbol of an n-gram."""
    return [F.expr(f"shiftright(hi, {POINT})"), F.expr(f"shiftright(lo, {POINT}) | shiftleft(hi & {ONE}L, {2 * POINT})")]


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """fold, k, hi, lo and n of all n-grams of the documents: how often those of the highest
    order occur, and how many symbols stand before the shorter ones."""
    ship(docs.sparkSession)
    now = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(_counted("text"), "fold long, hi long, lo long, n long")
    # Written before it is read for the shorter ones, so that texts are counted once.
    longest = table(now.groupBy(*GRAM).agg(F.sum("n").alias("n")), "ngrams")
    now, shorter = longest, []
    for k in range(ORDER - 1, 0, -1):
        hi, lo = _suffix(k)
        now = now.select("fold", hi.alias("hi"), lo.alias("lo")).groupBy(*GRAM).agg(F.count("*").alias("n"))
        shorter.append(now.withColumn("k", F.lit(k)))
    others = table(reduce(DataFrame.unionByName, shorter), "ngrams")
    every = longest.withColumn("k", F.lit(ORDER)).unionByName(others)
    every.tables = (longest, others)
    return every


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the counts of
    counts; half a count each where those are too few to tell."""
    if not (n1 and n2 and n3):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    cut = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(c, 0.05), k - 0.05) for k, c in enumerate(cut, 1))


@dataclass
class Model:
    """Models by fold.  grams: fold, k, hi, lo and mass (the count less its discount); contexts:
    fold, k, hi, lo, total and gamma (the weight of the shorter n-grams); points: the
    number of symbols of each fold."""

    grams: DataFrame
    contexts: DataFrame
    points: dict[int, int]


def fit(every: DataFrame) -> Model:
    """The models of n-gram counts."""
    of = F.when
    n = F.col("n")
    rows = every.groupBy("fold", "k").agg(F.count("*").alias("types"), *[F.count(of(n == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect()  # one a fold and order
    cut = {(r.fold, r.k): discounts(r.n1, r.n2, r.n3, r.n4) for r in rows}

    def discount(i: int):
        here = F.lit(0.0)
        for (fold, k), d in cut.items():
            here = F.when((F.col("fold") == fold) & (F.col("k") == k), F.lit(d[i])).otherwise(here)
        return here

    mass = n - F.when(n == 1, discount(0)).when(n == 2, discount(1)).otherwise(discount(2))
    hi, lo = _context()
    sums = every.select("fold", "k", hi.alias("hi"), lo.alias("lo"), "n").groupBy("fold", "k", "hi", "lo")
    sums = sums.agg(F.sum("n").alias("total"), F.count(of(n == 1, 1)).alias("n1"), F.count(of(n == 2, 1)).alias("n2"), F.count(of(n > 2, 1)).alias("n3"))
    gamma = (discount(0) * F.col("n1") + discount(1) * F.col("n2") + discount(2) * F.col("n3")) / F.col("total")
    contexts = table(sums.select("fold", "k", "hi", "lo", "total", gamma.alias("gamma")), "contexts")
    return Model(every.select("fold", "k", "hi", "lo", mass.alias("mass")), contexts, {r.fold: r.types for r in rows if r.k == 1})


def probabilities(needed: DataFrame, model: Model, swap: bool = True) -> DataFrame:
    """fold, hi, lo and p of the needed n-grams of the highest order.  needed: as `counts` gives
    them.  swap: each fold by the other fold's model, instead of its own.

    Order by order, each distinct n-gram meets its own mass, its context's weight and the
    probability of the n-gram without its first symbol.  The shorter ones are written order by
    order: the plan of all orders at once takes the driver's memory."""
    by = (1 - F.col("fold")) if swap else F.col("fold")
    below, tables = None, []
    for k in range(1, ORDER + 1):
        own = model.grams.where(F.col("k") == k).select(by.alias("fold"), "hi", "lo", "mass")
        around = model.contexts.where(F.col("k") == k).select(by.alias("fold"), F.col("hi").alias("chi"), F.col("lo").alias("clo"), "total", "gamma")
        rows = needed.where(F.col("k") == k).select(*GRAM).join(own, GRAM, "left")
        chi, clo = _context()
        rows = rows.withColumn("chi", chi).withColumn("clo", clo).join(around, ["fold", "chi", "clo"], "left")
        if below is None:
            less = F.lit(1.0)
            for fold, n in model.points.items():
                less = F.when(F.col("fold") == (1 - fold if swap else fold), F.lit(1.0 / (n + 1))).otherwise(less)
            rows = rows.withColumn("less", less)
        else:
            shi, slo = _suffix(k - 1)
            rows = rows.withColumn("shi", shi).withColumn("slo", slo)
            rows = rows.join(below.select("fold", F.col("hi").alias("shi"), F.col("lo").alias("slo"), F.col("p").alias("less")), ["fold", "shi", "slo"])
        p = F.coalesce(F.coalesce("mass", F.lit(0.0)) / F.col("total") + F.col("gamma") * F.col("less"), "less")
        below = rows.select(*GRAM, p.alias("p"))
        if k < ORDER:
            below = table(below, "orders")
            tables.append(below)
    below.tables = tables
    return below


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fold, hi, lo, p = (batch.column(i).to_numpy() for i in range(4))
        h = hashed(fold.view(np.uint64), hi.view(np.uint64), lo.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.rint(-np.log2(p) * UNIT).astype(np.int32))], ["h", "units"])


def scores(docs: DataFrame, text: str = "text") -> DataFrame:
    """h and units (the information in 2^-16 bits) of each n-gram of the documents."""
    every = counts(docs, text)
    model = fit(every)
    longest = probabilities(every, model)
    found = table(longest.mapInArrow(_stored, "h long, units int"), "scores")
    forget(model.contexts, *every.tables, *longest.tables)
    return found


class Hashes:
    """N-gram hashes in order, with the units of each."""

    def __init__(self, rows: pa.Table) -> None:
        h = rows.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        self.h, self.units = h[order], rows.column("units").to_numpy()[order]

    def of(self, parts: list[Grams], n: int) -> np.ndarray:
        """The units of the n-gram at each of n places; all n-grams must be there."""
        out = np.empty(n, np.int64)
        for g in parts:
            out[g.places] = np.repeat(self.units[np.searchsorted(self.h, g.hashes)], g.n)
        return out


def measures(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The base metrics of each document."""
    n, words = len(bounds) - 1, Words(data, bounds)

    def within(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])

    points = (data & 0xC0) != 0x80
    out = {"n_words": words.counts, "word_chars": within(points & ~words.apart), "n_symbols": within(_is_symbol[data])}

    ends = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([bounds[:-1], ends + 1]))
    start = start[start < len(data)]
    stop = np.minimum(np.append(start[1:], len(data)), np.append(ends, len(data))[np.searchsorted(ends, start)])
    full = np.searchsorted(words.start, stop) > np.searchsorted(words.start, start)
    start, stop = start[full], stop[full]
    doc = np.searchsorted(bounds, start, "right") - 1
    key = per_doc(words.spans(start, stop), doc)
    _, once = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(doc, minlength=n) - np.bincount(doc[once], minlength=n)

    at, h = words.windows(words.hashes(), REPEAT_WINDOW)
    key = per_doc(h, words.doc[at])
    ordered = np.sort(key)
    again = distinct(ordered[1:][ordered[1:] == ordered[:-1]])
    step = np.zeros(len(words.start) + 1, np.int64)
    if len(again):
        hit = at[again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key]
        np.add.at(step, hit, 1)
        np.add.at(step, hit + REPEAT_WINDOW, -1)
    covered = np.cumsum(step[:-1]) > 0
    out["n_repeat_words"] = np.diff(np.concatenate([[0], np.cumsum(covered)])[words.first])
    return out


def per_doc(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return h ^ ((doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


# ---------------------------------------------------------------- scoring


def _judged(data: np.ndarray, bounds: np.ndarray, known: Hashes) -> list[pa.Array]:
    """The metrics, letters and units of each document."""
    parts: list[dict[str, np.ndarray]] = []
    for i, j in slices(bounds, PART_BYTES):
        own, at = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        part = measures(own, at)
        each, where = grams(own, at)
        units = known.of(each, where[-1])
        part["n_letters"] = np.diff(np.concatenate([[0], np.cumsum(_is_letter[own])])[at])
        part["units"] = np.diff(np.concatenate([[0], np.cumsum(units)])[where])
        parts.append(part)
    return [pa.array(np.concatenate([p[k] for p in parts] or [np.zeros(0)]).astype(np.int64)) for k in MEASURED]


def _scored(model, column: str, keep: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            made = _judged(*utf8(batch.column(column)), known)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + made, [*keep, *(f"m_{k}" for k in MEASURED)])

    return run


def _blocks(column: str) -> Callable:
    """Rows with the block that each goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, bounds = utf8(batch.column(column))
            for i, j in slices(bounds, BLOCK_BYTES):
                block += 1
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(j - i, block))], [*part.schema.names, "block"])

    return run


def _wanted(column: str) -> Callable:
    """The n-grams of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy()
            data, bounds = utf8(batch.column(column))
            cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                for i, j in slices(bounds[a : b + 1], PART_BYTES):
                    own, at = data[bounds[a + i] : bounds[a + j]], bounds[a + i : a + j + 1] - bounds[a + i]
                    for g in grams(own, at)[0]:
                        h = g.hashes
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), block[a])), pa.array(h.view(np.int64))], ["block", "h"])

    return run


def _scored_blocks(docs: DataFrame, known: DataFrame, column: str, keep: list[str], schema: T.StructType) -> DataFrame:
    """As `_scored`, with the n-grams of each block in place of all."""
    marked = T.StructType([*docs.schema.fields, T.StructField("block", T.LongType())])
    blocks = table(docs.mapInArrow(_blocks(column), marked), "blocks")
    wanted = blocks.select(column, "block").mapInArrow(_wanted(column), "block long, h long").distinct().join(known, "h")

    def run(texts: pa.Table, own: pa.Table) -> pa.Table:
        made = _judged(*utf8(texts.column(column)), Hashes(own))
        return pa.table([texts.column(k) for k in keep] + made, names=[*keep, *(f"m_{k}" for k in MEASURED)])

    return blocks.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(run, schema)


def scored(docs: DataFrame, carry: list[str], text: str = "text", lang: str = "lang", most: int = HASHES) -> DataFrame:
    """The columns `carry` with the struct `verdict`: metrics, bits per letter, the
    language's band, base_failed and kept.

    Metrics and score are computed once and kept in the shared folder; the bands
    come from the histogram of all documents' scores by language.  most: up to so many
    n-grams the model is broadcast.
    """
    spark = docs.sparkSession
    known = scores(docs, text)
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*at.values())
    keep = list(dict.fromkeys([*(at[c] for c in carry), at[lang]]))
    schema = T.StructType([plain.schema[c] for c in keep] + [T.StructField(f"m_{k}", T.LongType()) for k in MEASURED])
    need = plain.select(*dict.fromkeys([*keep, at[text]]))
    model = None
    if known.count() <= most:
        model = spark.sparkContext.broadcast(Hashes(known.toArrow()))
        give_back()
        rows = need.mapInArrow(_scored(model, at[text], keep), schema)
    else:
        rows = _scored_blocks(need, known, at[text], keep, schema)
    rows = table(rows, "perplexity")
    forget(known)
    if model:
        model.destroy()
    rows = rows.withColumn("bits", F.col("m_units") / F.lit(float(UNIT)) / F.greatest(F.col("m_n_letters"), F.lit(1)))
    bands = small(fences(rows.where(F.col("m_n_words") >= MIN_WORDS), at[lang]))
    base = (F.col("m_n_words") < MIN_WORDS) | (100 * F.col("m_n_repeat_words") > MAX_REPEATED * F.col("m_n_words"))
    inside = F.coalesce((F.col("bits") >= F.col("low")) & (F.col("bits") <= F.col("high")), F.lit(True))
    out = rows.join(bands, rows[at[lang]].eqNullSafe(bands["band_of"]), "left").select(
        *[F.col(at[c]).alias(c) for c in carry],
        F.struct(
            *[F.col(f"m_{k}").alias(k) for k in METRICS],
            base.alias("base_failed"),
            (~base & inside).alias("kept"),
            F.pow(F.lit(2.0), "bits").alias("perplexity"),
            F.pow(F.lit(2.0), "low").alias("lower_band"),
            F.pow(F.lit(2.0), "high").alias("upper_band"),
        ).alias(fresh(carry, "verdict")),
    )
    return out


def fences(rows: DataFrame, lang: str) -> DataFrame:
    """band_of, low, high for each language, from a histogram of its documents' bits."""
    bins = rows.groupBy(F.col(lang).alias("band_of"), F.floor(F.col("bits") * BINS).alias("bin")).agg(F.count("*").alias("n"))
    each = Window.partitionBy("band_of")
    upto = each.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(each))
    q = [F.min(F.when(F.col("upto") >= p * F.col("all"), F.col("bin"))) for p in (0.25, 0.75)]
    found_ = bins.groupBy("band_of").agg((q[0] / BINS).alias("q1"), ((q[1] + 1) / BINS).alias("q3"))
    reach = FENCE * (F.col("q3") - F.col("q1"))
    return settled(found_.select("band_of", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high")))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the metrics, base_failed, kept and the perplexity with its band."""
    return scored(docs, ["doc_id"]).select("doc_id", "verdict.*")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns."""
    name = fresh(docs.columns, "verdict")
    rows = scored(docs, docs.columns)
    return rows.where(rows[name]["kept"]).drop(name)
