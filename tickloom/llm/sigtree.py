"""N-gram Jaccard self-join by signature trees.

Documents are sets of word shingles; two link when their Jaccard similarity
reaches a given per cent (`Measure`).  The join is exact, in three steps:

1. Candidates.  Shingles have one global order: the corpus's most frequent ones
   last, else by hash.  A set of n shingles of which a partner must share o has
   its first n - o + l in that order as prefix; partners then share l prefix
   shingles.  Shingles in the prefixes of up to `GROUP` sets give pairs, which
   are counted; a pair with enough in common is a candidate.  Shingles in more
   prefixes only lower the count that a pair needs; documents that could
   partner on such shingles alone are linked to each shingle's first one.
2. Clusters are the connected components of the candidates.  A cluster goes to
   one task, or, past `BLOCK` shingles, in blocks by set size and hash: every two
   blocks that may hold partners go to a task together.
3. In a task a signature tree holds the sets: a node has the OR of its sets' token
   bitmaps and the range of their sizes.  Two trees (or one with itself) are
   traversed together; a pair of nodes goes when their common bits and sizes
   don't allow enough overlap, or when all below them are connected already.  Sets
   that remain are compared exactly.

Links become connected components.  Equal sets are one node from the start.

Defined cases: null and empty texts have no shingle and link with nothing; of
fewer words than a shingle has, the whole sequence is one.  Rows without doc_id get no
component (and are no one's partner).  Rows that share a doc_id are one node that
has each one's links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, distinct, fresh, lower_ascii, mix, settled, ship, slices, small, table, utf8
from .graph import components

#: Prefix shingles that partners must share: this share of the set.
COMMON = 0.05
#: Largest group of which all pairs are counted.
GROUP = 8
#: Shingles in more than this share of the documents (and this many at least) come last in
#: the order; at most so many of them, as each has at least that part of all shingles.
FREQUENT, FREQUENT_LEAST, FREQUENT_MOST = 0.001, 16, 1_000_000
#: Shares in which the documents of a shingle of a large group are linked.
SHARES = 256
#: Shingles of a block of a large cluster.
BLOCK = 500_000
FAN, CHUNK = 8, 8192
#: Shingles a task holds while it counts.
HELD = 2_000_000


@dataclass(frozen=True)
class Measure:
    """What makes documents partners: words of a shingle, and the least Jaccard per cent."""

    words: int = 4
    link: int = 85

    def need(self, n: int) -> int:
        """The least overlap with any partner of a set of n."""
        return (self.link * n + 99) // 100

    def common(self, n: int) -> int:
        """The prefix shingles that a set of n shares with any partner that shares as many."""
        return min(max(1, math.ceil(COMMON * n)), self.need(n))

    def common_sql(self, n: str) -> str:
        return f"least(greatest(1, ceil({n} * {COMMON}D)), ({n} * {self.link} + 99) DIV 100)"

    @property
    def size_class(self) -> float:
        """Set sizes of partners differ by one class of this ratio at most."""
        return 100 / (self.link - 1)


#: The measure of the registered query, and that of pipelines.
QUERY, STAGE = Measure(4, 85), Measure(5, 80)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    words = Words(lower_ascii(data), bounds)
    h = words.hashes()
    at, runs = words.windows(h, k)
    cut = np.searchsorted(at, words.first)
    out = [distinct(runs[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    for d in np.flatnonzero((words.counts > 0) & (words.counts < k)):
        own = h[words.first[d] : words.first[d + 1]]
        key = np.uint64(len(own))
        for x in own:
            key = mix(np.array([key ^ x]))[0]
        out[d] = np.array([key])
    return out


def _counted(m: Measure):
    """Shingles that are frequent in a task, with their counts (too low by what was pruned)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        docs = shingles = 0

        def merge() -> None:
            nonlocal keys, counts
            if not held:
                return
            own, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            both = distinct(np.concatenate([keys, own]))
            total = np.zeros(len(both), np.int64)
            total[np.searchsorted(both, keys)] += counts
            total[np.searchsorted(both, own)] += n
            if len(both) > HELD:
                kept = total > max(1, FREQUENT / 4 * docs)
                both, total = both[kept], total[kept]
            keys, counts = both, total

        for batch in batches:
            data, bounds = utf8(batch.column(0))
            for i, j in slices(bounds):
                held += shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], m.words)
                docs += j - i
                shingles += sum(map(len, held[i - j :]))
                if sum(map(len, held)) > HELD:
                    merge()
        merge()
        kept = counts >= max(3, FREQUENT / 2 * docs)
        yield pa.RecordBatch.from_arrays([pa.array(keys[kept].view(np.int64)), pa.array(counts[kept])], ["shingle", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([shingles])], ["shingle", "n"])  # of all

    return run


def frequent(docs: DataFrame, m: Measure, text: str = "text") -> np.ndarray:
    """The corpus's most frequent shingles, sorted."""
    rows = settled(docs.select(text).mapInArrow(_counted(m), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")))
    every = rows.where("shingle IS NULL").first()
    least = max(FREQUENT_LEAST, FREQUENT * docs.count(), (every.n if every else 0) / FREQUENT_MOST)
    found = rows.where(F.col("shingle").isNotNull() & (F.col("n") >= least)).select("shingle").toArrow()
    return np.sort(found["shingle"].to_numpy().view(np.uint64))


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    cut = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(parts)))


def _profiled(last, m: Measure):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = last.value
        for batch in batches:
            data, bounds = utf8(batch.column(1))
            for i, j in slices(bounds):
                sets = shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], m.words)
                name, prefix, last_ones = [], [], []
                for s in sets:
                    name.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    n = len(s)
                    length = n - m.need(n) + m.common(n) if n else 0
                    late = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s if n and len(often) else np.zeros(n, bool)
                    first = s[~late][:length]
                    prefix.append(first.view(np.int64))
                    last_ones.append(s[late][: length - len(first)].view(np.int64))
                size = np.array([len(s) for s in sets], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(size), pa.array(name, pa.binary()), lists(prefix), lists(last_ones)],
                    ["doc_id", "n", "set", "prefix", "late"],
                )

    return run


def profiles(docs: DataFrame, m: Measure) -> DataFrame:
    """doc_id, n (the set's size), set (a 128-bit name of the set), and the prefix of each
    document: what isn't frequent in `prefix`, the rest in `late`."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    last = spark.sparkContext.broadcast(frequent(texts, m))
    return table(texts.mapInArrow(_profiled(last, m), f"doc_id {kind}, n int, set binary, prefix array<long>, late array<long>"), "shingles")


def candidates(sets: DataFrame, m: Measure) -> DataFrame:
    """Pairs a, b of doc_ids that may link, or chain documents that may; from doc_id, n and
    prefix of one document for each set."""
    # What isn't frequent is in few documents, so its groups fit the tasks that size them;
    # a frequent shingle's group is large without counting.
    rows = sets.select("doc_id", "n", F.explode("prefix").alias("shingle"))
    rows = rows.withColumn("size", F.count("*").over(Window.partitionBy("shingle"))).where("size > 1")
    often = sets.select("doc_id", "n", F.explode("late").alias("shingle"), F.lit(GROUP + 1).cast("long").alias("size"))
    rows = table(rows.unionByName(often), "grouped")
    # A smaller partner may ask for less: the least that any can ask for counts.
    smallest = f"(n * {m.link} + 99) DIV 100"
    wide = rows.where(F.col("size") > GROUP)
    heavy = settled(wide.groupBy("doc_id").agg(F.count("*").alias("h"), F.first("n").alias("n")).withColumn("l", F.expr(m.common_sql(smallest))))

    member = F.struct("doc_id", "n")
    group = rows.where(F.col("size") <= GROUP).groupBy("shingle").agg(F.sort_array(F.collect_list(member)).alias("g"))
    # Near copies share many shingles with the same others: such groups are counted once.
    group = group.groupBy("g").agg(F.count("*").alias("w"))
    pair = F.expr(f"""
        filter(
          flatten(transform(g, (x, i) -> transform(slice(g, i + 2, {GROUP}), y -> struct(x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb)))),
          p -> p.a < p.b AND 100L * least(p.na, p.nb) >= {m.link}L * greatest(p.na, p.nb))""")
    pairs = group.select("w", F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.sum("w").alias("s"), F.first("p.na").alias("na"), F.first("p.nb").alias("nb"))
    for side in "ab":
        h = heavy.select(F.col("doc_id").alias(side), F.col("h").alias(f"h{side}"))
        pairs = pairs.join(h, side, "left")
    enough = F.expr(m.common_sql("least(na, nb)"))
    pairs = pairs.where(F.col("s") >= enough - F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))).select("a", "b")

    alone = wide.join(heavy.where("h >= l").select("doc_id"), "doc_id").select("doc_id", "shingle")
    return pairs.unionByName(chains(alone))


def chains(rows: DataFrame) -> DataFrame:
    """Pairs a, b that connect all documents of each shingle, from doc_id and shingle: each is
    linked to the first one of its share of the shingle's documents, and that one to the first
    of all, so no task has more of a shingle than a share."""
    rows = rows.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)))
    near = rows.groupBy("shingle", "share").agg(F.min("doc_id").alias("b"))
    far = near.groupBy("shingle").agg(F.min("b").alias("a"))
    own = rows.join(near, ["shingle", "share"]).select(F.col("doc_id").alias("a"), "b")
    return own.unionByName(near.join(far, "shingle").select("a", "b")).where("a != b")


def units(clusters: DataFrame, m: Measure, block: int = BLOCK) -> DataFrame:
    """doc_id, unit (a string) and side: what goes to a task together.  In units with sides
    0 and 1 only sets of different sides are compared.  clusters: doc_id, n, cluster."""
    rows = clusters.withColumn("c", F.floor(F.log("n") / F.log(F.lit(m.size_class))).cast("int"))
    sums = rows.groupBy("cluster", "c").agg(F.sum("n").alias("w"))
    whole = sums.groupBy("cluster").agg(F.sum("w").alias("total"))
    parts = sums.join(whole.where(F.col("total") > block), "cluster").withColumn("k", F.ceil(2 * F.col("w") / block).cast("int"))
    next_to = [parts.select("cluster", (F.col("c") - d).alias("c"), F.col("k").alias(f"k{i}")) for i, d in enumerate((1, -1))]
    for other in next_to:
        parts = parts.join(other, ["cluster", "c"], "left")
    # Few clusters are split: their parts go to the rows, not a large cluster's rows to one task.
    rows = rows.join(small(settled(parts.drop("w", "total"))), ["cluster", "c"], "left")
    rows = rows.withColumn("i", F.expr("cast(pmod(xxhash64(doc_id), k) as int)"))
    spread = F.expr("""
        CASE WHEN k IS NULL THEN array(struct(concat_ws(':', cluster) AS unit, 0 AS side)) ELSE concat(
          transform(sequence(0, k - 1), j -> struct(concat_ws(':', cluster, c, least(i, j), c, greatest(i, j)) AS unit, IF(i > j, 1, 0) AS side)),
          IF(k0 IS NULL, array(), transform(sequence(0, k0 - 1), j -> struct(concat_ws(':', cluster, c, i, c + 1, j) AS unit, 0 AS side))),
          IF(k1 IS NULL, array(), transform(sequence(0, k1 - 1), j -> struct(concat_ws(':', cluster, c - 1, j, c, i) AS unit, 1 AS side)))) END""")
    return rows.select("doc_id", F.explode(spread).alias("u")).select("doc_id", "u.unit", "u.side")


class Tree:
    """A signature tree over sets (sorted distinct shingles), bottom level first."""

    def __init__(self, sets: list[np.ndarray], rows: np.ndarray) -> None:
        """rows: which sets, in the order of the leaves."""
        size = np.array([len(sets[r]) for r in rows], np.int64)
        wide = 1 << int(np.ceil(np.log2(np.clip(2 * size.mean(), 256, 8192))))
        bits = np.zeros((len(rows), wide), bool)
        for k, r in enumerate(rows):
            bits[k, (sets[r] & np.uint64(wide - 1)).astype(np.int64)] = True
        self.rows = rows
        maps = np.packbits(bits, axis=1).view(np.uint64)
        slack = size - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, size, size, slack)]
        while len(maps) > 1:
            cut = np.arange(0, len(maps), FAN)
            maps = np.bitwise_or.reduceat(maps, cut)
            low, high, slack = self.levels[-1][1:]
            self.levels.append((maps, np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(slack, cut)))


class Join:
    """The components of sets under Jaccard links."""

    def __init__(self, sets: list[np.ndarray], sides: np.ndarray, link: int) -> None:
        self.link = link
        self.size = np.array([len(s) for s in sets], np.int64)
        self.cut = np.concatenate([[0], np.cumsum(self.size)])
        _, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(int(self.flat.max(initial=0)) + 1, bool)
        self.root = np.arange(len(sets))
        order = np.lexsort(([int(s[0]) for s in sets], self.size))
        left, right = (order[sides[order] == x] for x in (0, 1))
        if not len(right):
            self._traverse(Tree(sets, left))
        elif len(left):
            self._traverse(Tree(sets, np.concatenate([left, right])), len(left))

    def _traverse(self, tree: Tree, left: int = 0) -> None:
        """Walks the pairs of nodes from the root down; pairs of sets are compared at the bottom.

        left: if given, only pairs of one of the first `left` leaves and a later one count.
        """
        top = len(tree.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > CHUNK:
                stack += [(level, a[i : i + CHUNK], b[i : i + CHUNK]) for i in range(0, len(a), CHUNK)][::-1]
                continue
            keep = self._open(tree, level, a, b)
            if left:
                first, last = a * FAN**level, np.minimum((b + 1) * FAN**level, len(tree.rows)) - 1
                keep &= (first < left) & (last >= left)
            a, b = a[keep], b[keep]
            maps, low, high, slack = tree.levels[level]
            most = np.bitwise_count(maps[a] & maps[b]).sum(1, dtype=np.int64) + np.minimum(slack[a], slack[b])
            most = np.minimum(most, np.minimum(high[a], high[b]))
            keep = (100 + self.link) * most >= self.link * (low[a] + low[b])
            keep &= (100 * high[a] >= self.link * low[b]) & (100 * high[b] >= self.link * low[a])
            if not level:
                keep &= a != b
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if not level:
                self._compare(tree.rows[a], tree.rows[b])
                continue
            n = len(tree.levels[level - 1][0])
            i, j = np.divmod(np.arange(FAN * FAN), FAN)
            a2, b2 = (a[:, None] * FAN + i).ravel(), (b[:, None] * FAN + j).ravel()
            keep = (a2 < n) & (b2 < n) & (a2 <= b2)
            stack.append((level - 1, a2[keep], b2[keep]))

    def _open(self, tree: Tree, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether anything below two nodes isn't connected yet."""
        roots = self.root[tree.rows]
        cut = np.arange(0, len(roots), FAN**level)
        low, high = np.minimum.reduceat(roots, cut), np.maximum.reduceat(roots, cut)
        return np.minimum(low[a], low[b]) != np.maximum(high[a], high[b])

    def _compare(self, a: np.ndarray, b: np.ndarray) -> None:
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        for s, e in zip(starts, np.append(starts[1:], len(a)), strict=True):
            x, others = a[s], b[s:e]
            others = others[self.root[others] != self.root[x]]
            if not len(others):
                continue
            own = self.flat[self.cut[x] : self.cut[x + 1]]
            self.mark[own] = True
            sizes = self.size[others]
            got = self.mark[np.concatenate([self.flat[self.cut[o] : self.cut[o + 1]] for o in others])]
            shared = np.add.reduceat(got.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            self.mark[own] = False
            linked = others[100 * shared >= self.link * (self.size[x] + sizes - shared)]
            if len(linked):
                roots = np.unique(self.root[np.append(linked, x)])
                self.root[np.isin(self.root, roots)] = roots[0]


def _joined(m: Measure):
    """Links a, b of each unit: a set's document and the first one of its component."""

    def linked(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sides, texts = [], [], []
        for part in held:
            ids.append(part.column(0))
            sides.append(part.column(2).to_numpy())
            texts.append(part.column(3))
        data, bounds = utf8(pa.chunked_array(texts))
        ids = pa.chunked_array(ids).to_numpy()
        sets = []
        for i, j in slices(bounds):
            sets += shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], m.words)
        full = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
        if len(full) > 1:
            root = full[Join([sets[k] for k in full], np.concatenate(sides)[full], m.link).root]
            away = root != full
            yield pa.RecordBatch.from_arrays([pa.array(ids[full[away]]), pa.array(ids[root[away]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        for batch in batches:
            keys = batch.column(1).to_pylist()
            start = 0
            for k in range(len(keys) + 1):
                if k == len(keys) or keys[k] != name:
                    if k > start:
                        held.append(batch.slice(start, k - start))
                    start = k
                    if k < len(keys):
                        if held:
                            yield from linked(held)
                        name, held = keys[k], []
        if held:
            yield from linked(held)

    return run


def links(docs: DataFrame, parts: DataFrame, m: Measure) -> DataFrame:
    """Links a, b that connect all linked documents of the units."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").join(parts, "doc_id").select("doc_id", "unit", "side", "text")
    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(_joined(m), f"a {kind}, b {kind}")


def join(docs: DataFrame, m: Measure = QUERY, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that it reaches by links)."""
    sets = profiles(docs, m)
    known = sets.where("doc_id IS NOT NULL AND n > 0")
    classes = settled(known.groupBy("set").agg(F.min("doc_id").alias("rep")))
    one = known.join(classes.select("set", F.col("rep").alias("doc_id")), ["set", "doc_id"], "left_semi")
    clusters = components(candidates(one, m)).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    sizes = known.groupBy("doc_id").agg(F.max("n").alias("n"))
    parts = units(settled(clusters.join(sizes, "doc_id")), m, block)
    # An id that stands on several texts links what they are linked with.
    several = known.join(known.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "doc_id")
    same = several.join(classes, "set").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links(docs, parts, m).unionByName(same))
    rep = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    rep = rep.select("set", F.coalesce("component", "rep").alias("component"))
    out = sets.select("doc_id", "n", "set").join(rep, "set", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, m: Measure = STAGE) -> DataFrame:
    """One document of each component, its first, with its columns; of rows with one doc_id
    the one with the first text.  Rows without doc_id stay."""
    first = join(docs, m).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(first, "doc_id", "left_semi")
    text, place = F.sha2(F.coalesce("text", F.lit("")), 256), fresh(docs.columns, "place")
    one = Window.partitionBy("doc_id").orderBy(text, *[F.col(f"`{c}`") for c, t in docs.dtypes if c != "text" and not t.startswith("map")])
    named = named.withColumn(place, F.row_number().over(one)).where(F.col(place) == 1).drop(place)
    return named.unionByName(docs.where("doc_id IS NULL"))
