"""Language identification by rank-order profiles.

A profile ranks the `TOP` most frequent letter n-grams (1 to 3 letters, words
edged by a separator).  A language's profile comes from all training documents
in it; a document takes the language with the least out-of-place distance: the
sum over the document's own profile of the difference of ranks, or `TOP` for an
n-gram that the language's profile lacks.

N-grams are exact: three code points of 21 bits fill one 64-bit key.  Spark sums
the counts of all training documents, and each language's profile is cut out
where the counts are.  What reaches the driver at once is `TOP` rows for each language of
a group of `MOST_LANGUAGES`; more languages are compared group after group.

Defined cases: a null text, or one without a letter, is `und` with score 0.  A
null language trains nothing; a document without id is neither trained on nor
left out of the result.  With no trained language all is `und`.  Repeated rows
are each judged, and each trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, fresh, settled, ship, slices, table, utf8

TOP = 300
UNKNOWN = "und"
#: The share of the greatest distance that a document may keep and still be accepted.
LEAST_SCORE = 0.05
#: Distinct n-grams a task holds before it hands on their counts.
HELD = 2_000_000
#: Bytes of text whose n-grams a task holds at once: some 150 bytes for each.
PART_BYTES = SLICE_BYTES // 4
#: Languages whose profiles are broadcast together (300 rows of 16 bytes each); more go in groups.
MOST_LANGUAGES = 8192

_EDGE = 1


@cache
def _letters() -> np.ndarray:
    """By code point: 0 if it isn't a letter, else 2 more than its lower case."""
    out = np.zeros(0x110000, np.uint32)
    for p in range(0x40000):
        x = chr(p)
        if x.isalpha():
            low = x.lower()
            out[p] = ord(low) + 2 if len(low) == 1 else p + 2
    return out


def grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and word edges of all documents: a row of the keys of the 1-, 2- and
    3-gram that end there (0: none); and each document's bounds among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
    c = _letters()[points]
    letter = c > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    first = at[:-1][at[:-1] < len(c)]
    keep[first] = letter[first]
    at = np.concatenate([[0], np.cumsum(keep)])[at]
    c = c[keep].astype(np.uint64)
    c[c == 0] = _EDGE
    own = np.arange(len(c)) - np.repeat(at[:-1], np.diff(at))
    back = [np.full(len(c), _EDGE, np.uint64) for _ in range(2)]
    for k, b in enumerate(back, 1):
        b[k:] = c[:-k]
        b[own < k] = _EDGE
    keys = np.zeros((len(c), 3), np.uint64)
    keys[:, 0] = np.where(c == _EDGE, 0, c)
    keys[:, 1] = c | (back[0] << np.uint64(21))
    keys[:, 2] = np.where(own < 1, 0, keys[:, 1] | (back[1] << np.uint64(42)))
    return keys, at


def _counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = keys[keys > 0]
    x.sort()
    if not len(x):
        return x, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[at], np.diff(np.append(at, len(x)))


def _added(old: np.ndarray, old_n: np.ndarray, got: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counts of two arrays of sorted keys, the first not empty; its counts are changed."""
    at = np.searchsorted(old, got)
    there = old[np.minimum(at, len(old) - 1)] == got
    old_n[at[there]] += n[there]
    new = ~there
    return np.insert(old, at[new], got[new]), np.insert(old_n, at[new], n[new])


def ranked(keys: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent keys, most frequent first; ties by key."""
    own, n = _counts(keys)
    if len(own) > top:
        least = np.partition(n, len(n) - top)[len(n) - top]
        at = np.flatnonzero(n >= least)
        own, n = own[at], n[at]
    return own[np.argsort(-n, kind="stable")][:top]


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (own, n) in held.items():
            for i in range(0, len(own), 1 << 16):
                k = own[i : i + (1 << 16)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k), pa.array(n[i : i + (1 << 16)])], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        langs = batch.column(0).to_pylist()
        data, bounds = utf8(batch.column(1))
        for i, j in slices(bounds, PART_BYTES):
            keys, at = grams(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            own = np.array(langs[i:j], object)
            which = np.repeat(np.arange(j - i), np.diff(at))
            for lang in set(own.tolist()):
                got, n = _counts(keys[(own == lang)[which]].ravel())
                if lang in held:
                    held[lang] = _added(*held[lang], got, n)
                elif len(got):
                    held[lang] = got, n
            if sum(len(own) for own, _ in held.values()) > HELD:
                yield from flush()
    yield from flush()


class Profiles:
    """The languages' ranks of all n-grams in any profile; `TOP` where one lacks it."""

    def __init__(self, rows: list[tuple[str, int, int]], top: int = TOP) -> None:
        self.langs = sorted({r[0] for r in rows})
        grams_ = np.array([r[1] for r in rows], np.int64).view(np.uint64)
        self.keys = np.unique(grams_)
        self.ranks = np.full((len(self.keys), len(self.langs)), top, np.int32)
        column = {x: k for k, x in enumerate(self.langs)}
        for (lang, _, rank), at in zip(rows, np.searchsorted(self.keys, grams_), strict=True):
            self.ranks[at, column[lang]] = rank - 1
        self.top = top

    def nearest(self, own: np.ndarray) -> tuple[str, float]:
        """The language with the least distance (the first by name of equals), and the
        share of the greatest possible distance that it stays below it."""
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        ranks = np.where((self.keys[at] == own)[:, None], self.ranks[at], self.top)
        out = np.abs(ranks - np.arange(len(own), dtype=np.int32)[:, None])
        out[ranks == self.top] = self.top
        total = out.sum(0)
        best = int(total.argmin())
        return self.langs[best], 1.0 - float(total[best]) / (self.top * len(own))


def ranks(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, gram and rank of each language's profile, from the columns `lang` and `text`."""
    ship(docs.sparkSession)
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    counts = docs.where("lang is not null").select("lang", "text").mapInArrow(_trained, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "gram", "rank")


def fit(docs: DataFrame, top: int = TOP, most: int = MOST_LANGUAGES) -> list[Profiles]:
    """The profiles of all languages, in groups of at most `most` or so (by a hash of the name)."""
    rows = settled(ranks(docs, top))
    parts = -(-rows.where("rank = 1").count() // most)
    group = F.pmod(F.xxhash64("lang"), F.lit(parts))
    each = [rows.where(group == i) if parts > 1 else rows for i in range(parts)]
    return [Profiles([tuple(r) for r in own.collect()], top) for own in each]  # `top` rows a language


def _predicted(profiles, text: int, carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = profiles.value
        for batch in batches:
            data, bounds = utf8(batch.column(text))
            for i, j in slices(bounds, PART_BYTES):
                keys, at = grams(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                got = [known.nearest(ranked(keys[a:b].ravel(), known.top)) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(i, j - i) for k in range(carried)] + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                    [f"c{k}" for k in range(carried)] + ["p0", "p1"],
                )

    return run


def _nearest(docs: DataFrame, profiles: Profiles, carry: list[str], text: str) -> DataFrame:
    spark = docs.sparkSession
    at = carry.index(text) if text in carry else len(carry)
    columns = [*carry, *([text] if at == len(carry) else [])]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    schema = T.StructType([*plain.schema.fields[: len(carry)], T.StructField("p0", T.StringType()), T.StructField("p1", T.DoubleType())])
    return plain.mapInArrow(_predicted(spark.sparkContext.broadcast(profiles), at, len(carry)), schema)


def predict(docs: DataFrame, profiles: list[Profiles], carry: list[str], text: str = "text") -> DataFrame:
    """The columns `carry` with lang_pred and score.

    A worker holds one group of profiles at a time: of several groups each goes over the
    texts in turn, and the nearest language so far is kept."""
    ship(docs.sparkSession)
    names = [fresh(carry, "lang_pred"), fresh(carry, "score")]
    out = _nearest(docs, profiles[0] if profiles else Profiles([]), [*carry, *([text] if len(profiles) > 1 and text not in carry else [])], text)
    for more in profiles[1:]:
        kept = [f"c{i}" for i in range(len(out.columns) - 2)]
        before = table(out.toDF(*kept, "q0", "q1"), "languages")
        own = f"c{carry.index(text) if text in carry else len(carry)}"
        both = _nearest(before, more, before.columns, own).toDF(*before.columns, "p0", "p1")
        better = (F.col("p1") > F.col("q1")) | (F.col("p1") == F.col("q1")) & (F.col("p0") < F.col("q0"))
        out = both.select(*kept, F.when(better, F.col("p0")).otherwise(F.col("q0")).alias("p0"), F.greatest("p1", "q1").alias("p1"))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], F.col("p0").alias(names[0]), F.col("p1").alias(names[1]))


def held_out(doc_id: str = "doc_id"):
    """Whether a document stays out of training: crc32 of its id as text, mod 5, is 0, or it has none."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from those not held out."""
    profiles = fit(docs.where(~held_out()))
    return predict(docs, profiles, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents with a language and at least that score, with their columns."""
    profiles = fit(docs.where(~held_out()))
    out = predict(docs, profiles, docs.columns)
    lang, score = out.columns[-2:]
    return out.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).drop(lang, score)
