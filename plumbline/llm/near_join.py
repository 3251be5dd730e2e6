"""Exact Jaccard similarity join on word shingles, with connected components.

Documents with the same set of shingles are one node. Sets fall into size bands whose limits lie the threshold apart,
so partners are in the same band or in neighbouring ones. Two sets that reach the threshold share one of the first
``n - ceil(t * n) + 1`` shingles of each in any common order (rare ones first, by a sample's counts: that only
concerns the cost). A tile is one such shingle and band:

1. every node of a tile is compared with the tile's leader and leaders with those of the next band, which unites large
   groups of copies with a number of comparisons linear in their members;
2. what isn't connected by then is compared with two random members of each of its tiles;
3. then all nodes of neighbouring tiles that aren't connected yet are compared with each other, so no link between
   different components is lost.

A comparison first bounds the overlap from above by the bit counts of hashed bitmaps, and what passes is decided by
the intersection of the sorted arrays.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, bytes_of, column_batches, crc_mod_column, cut, forget, id_marks, marked, partitions, send, skew_safe_join, trimmed, unsend
from .graph import components

MULT = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted arrays of 64-bit hashes of a text's distinct shingles of ``k`` words."""

    def __init__(self, k: int, limit: int = 50_000):
        self.k, self.limit, self.memo = k, limit, {}

    def words(self, text: bytes) -> list[bytes]:
        return text.translate(LOWER).split()

    def hashes(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        got = list(map(memo.get, words))
        if None in got:
            if len(memo) > self.limit:
                memo.clear()
            for w in {w for w, x in zip(words, got) if x is None}:
                memo[w] = xxhash.xxh3_64_intdigest(w)
            got = [memo[w] if x is None and w in memo else x for w, x in zip(words, got)]
            got = [xxhash.xxh3_64_intdigest(w) if x is None else x for w, x in zip(words, got)]
        return np.array(got, dtype=np.uint64)

    def __call__(self, text: bytes) -> np.ndarray:
        words = self.words(text)
        if not words:
            return np.zeros(0, dtype=np.uint64)
        h, k = self.hashes(words), self.k
        if len(h) < k:
            k = len(h)
        with np.errstate(over="ignore"):
            out = h[: len(h) - k + 1].copy()
            for i in range(1, k):
                out = out * MULT + h[i : len(h) - k + 1 + i]
            out = (out + np.uint64(k)) * MULT
            out ^= out >> np.uint64(32)
            out *= np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(29)
        return np.unique(out)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def band_of(n: int, num: int, den: int) -> int:
    """Bands are a bit wider than the threshold, so rounding can't part partners by more than one band; equal sets, as
    a threshold of 1 asks for, have equal sizes."""
    if num >= den:
        return n
    return int(math.log(n) / (math.log(den / num) * 1.001))


def bitmap(values: np.ndarray) -> np.ndarray:
    """Parities of the shingles that fall on each of a power of two places, at least two for a shingle.

    The larger of two widths folds to the smaller one by exclusive or of its halves.
    """
    width = 1 << min(16, max(8, (2 * len(values) - 1).bit_length()))
    counts = np.bincount((values >> np.uint64(7)).astype(np.int64) & (width - 1), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8))


def node_of(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a set's hash as two signed numbers."""
    digest = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


#: Nodes of a shingle up to which their pairs are handed on without a look at the bitmaps.
SMALL = 32
#: Nodes of a tile that one task compares with as many others at a time.
BLOCK = 2048
FACTS = "doc_id bigint, n bigint, node bigint, more bigint, band int, bits binary, prefix array<bigint>"


def _hot_shingles(rows: DataFrame, k: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of shingles that at least three documents of one in sixteen share; the commonest ``most``.

    They only set the order in which shingles are taken, so their number and the sample bound the cost and the size
    of what is sent to the tasks (16 MB), and have no say in the result.
    """

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(k)
        for batch in column_batches(batches, 2 << 20):
            found = [make(t) for t in bytes_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])

    sample = rows.filter(crc_mod_column("doc_id", 16) == 5)
    counts = cut(sample.mapInArrow(trimmed(shingles), "h bigint").groupBy("h").agg(F.count("*").alias("c")).filter("c >= 3"))
    # the least count that leaves ``most`` shingles at most; there are few distinct counts
    levels = counts.groupBy("c").agg(F.count("*").alias("k")).orderBy(F.desc("c")).toArrow()
    fits = np.cumsum(levels.column("k").to_numpy()) <= most
    least = int(levels.column("c").to_numpy()[fits][-1]) if fits.any() else 1 << 62
    got = counts.filter(F.col("c") >= least).toArrow()
    h, c = got.column("h").to_numpy().view(np.uint64), got.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def _facts(rows: DataFrame, k: int, num: int, den: int, node_bits: int) -> DataFrame:
    hot_h, hot_c = _hot_shingles(rows, k)
    hot = send(rows.sparkSession, (hot_h, hot_c))

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        make, seen = Shingler(k), set()
        hashes, counts = hot.value
        for batch in column_batches(batches):
            ns, nodes, others, bands, bits, prefixes = [], [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), bytes_of(batch)):
                values = make(text)
                n = len(values)
                node, more = node_of(values) if n else (None, None)
                prefix = signature = None
                if n and doc_id is not None and (node, more) not in seen:
                    seen.add((node, more))
                    prefix = _prefix(values, prefix_length(n, num, den), hashes, counts)
                    signature = bitmap(values).tobytes()
                ns.append(n)
                nodes.append(node if node is None or node_bits == 64 else node & (1 << node_bits) - 1)
                others.append(more)
                bands.append(band_of(n, num, den) if n else None)
                bits.append(signature)
                prefixes.append(prefix)
            if len(seen) > 50_000:
                seen.clear()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
            columns = [pa.array(c, t) for c, t in zip((ns, nodes, others, bands, bits, prefixes), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n", "node", "more", "band", "bits", "prefix"])

    return cut(rows.mapInArrow(trimmed(facts), FACTS))


def _prefix(values: np.ndarray, length: int, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if len(hot):
        at = np.minimum(np.searchsorted(hot, values), len(hot) - 1)
        common = hot[at] == values
        if common.any():
            rank = np.where(common, counts[at], 0)
            values = values[np.lexsort((values, rank))]
    return values[:length].view(np.int64)


def _nodes(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, nodes): a node number for each distinct set, with its first 64 bits as ``raw``, and nodes' least ids.

    Sets that have their first 64 bits in common with another (a few pairs among 10^10 sets) get other numbers until
    all differ.
    """
    facts, attempt = facts.withColumn("raw", F.col("node")), 0
    while True:
        full = facts.filter("node is not null and doc_id is not null")
        grouped = full.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("more").alias("more"), F.max("more").alias("most"), F.min("raw").alias("raw"))
        nodes = cut(grouped)
        clash = nodes.filter("more != most").select(F.col("node").alias("_clash"))
        if clash.isEmpty():
            return facts, nodes.drop("most")
        attempt += 1
        own = F.when(F.col("_clash").isNull(), F.col("node")).otherwise(F.xxhash64("raw", "more", F.lit(attempt)))
        facts = cut(facts.join(clash, F.col("node") == F.col("_clash"), "left").withColumn("node", own).drop("_clash"))


def _stars(full: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, stars): the nodes of shingles that several have, as (h, band, node), and pairs (a, b) with leaders.

    A tile's leader is its least node; leaders of neighbouring bands are a pair too. Tiles are never gathered: counts
    and leaders are summed up before the shuffle, and rows of a very common shingle spread by their nodes.
    """
    found = full.filter("prefix is not null")
    tiles = found.select(F.explode("prefix").alias("h"), "band", "node")
    several = tiles.groupBy("h").agg(F.min("node").alias("n0"), F.max("node").alias("n1"), F.count("*").alias("c"))
    several = cut(several.filter("n0 < n1").select("h", "c"))
    total = found.agg(F.sum(F.size("prefix"))).first()[0] or 0
    runs = cut(skew_safe_join(tiles, several, "h", "c", total).filter("c is not null").select("h", "band", "node").distinct())
    leaders = runs.groupBy("h", "band").agg(F.min("node").alias("lead"), F.count("*").alias("size"))
    by = Window.partitionBy("h").orderBy("band")
    leaders = cut(leaders.withColumn("before", F.when(F.lag("band").over(by) == F.col("band") - 1, F.lag("lead").over(by))))
    own = skew_safe_join(runs, leaders.select("h", "band", "lead", "size"), ["h", "band"], "size", runs.count()).select("node", "lead")
    both = own.unionByName(leaders.select(F.col("lead").alias("node"), F.col("before").alias("lead"))).filter("node != lead")
    return runs, cut(both.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct())


def _dealt(runs: DataFrame, sizes: DataFrame, tasks: int) -> DataFrame:
    """Rows (h, band, node, comp, n, bits) of open tiles in groups (h, at, kind, x, y) that one task compares at once.

    The few nodes of a small shingle are one group, of kind -1. Larger tiles are parted in blocks by a hash of the node,
    and a group is a pair of blocks: x and y of a tile (kind 0; one block if they are the same) or x of a tile and y
    of the next band's (kind 1). ``side`` tells a group's two blocks apart.
    """
    small = runs.filter(F.col("size") <= SMALL).select("h", F.lit(0).alias("at"), F.lit(-1).alias("kind"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"), "band", "node", "comp", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("binary").alias("bits"))
    large, by = runs.filter(F.col("size") > SMALL), Window.partitionBy("h").orderBy("band")
    blocks = large.groupBy("h", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m"))
    beside = lambda f, step: F.coalesce(F.when(f("band").over(by) == F.col("band") + step, f("m").over(by)), F.lit(0))
    blocks = blocks.withColumns({"before": beside(F.lag, -1), "after": beside(F.lead, 1)})
    own = large.join(blocks, ["h", "band"]).join(sizes, "node").withColumn("i", F.pmod(F.xxhash64("node"), "m").cast("int"))

    def pairs(count: str, key):
        every = F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(every, lambda j: F.struct(*[c.cast("int").alias(n) for n, c in zip(("at", "kind", "x", "y", "side"), key(j))]))

    i, band = F.col("i"), F.col("band")
    groups = F.concat(
        pairs("m", lambda j: (band, F.lit(0), F.least(i, j), F.greatest(i, j), F.when(i > j, 1).otherwise(0))),
        pairs("after", lambda j: (band, F.lit(1), i, j, F.lit(0))),
        pairs("before", lambda j: (band - 1, F.lit(1), j, i, F.lit(1))),
    )
    dealt = own.select("h", "band", "node", "comp", "n", "bits", F.explode(groups).alias("g")).select("h", "g.*", "band", "node", "comp", "n", "bits")
    key = ["h", "at", "kind", "x", "y"]
    return small.unionByName(dealt).repartition(tasks, *key).sortWithinPartitions(*key, "band")


def _folded(bits: list[bytes], width: int) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, folded to ``width`` bytes."""
    out = np.empty((len(bits), width // 8), dtype=np.uint64)
    for i, x in enumerate(bits):
        row = np.frombuffer(x, np.uint64)
        while len(row) * 8 > width:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out[i] = row
    return out


def _unconnected(num: int, den: int, tile: int = 256):
    """From the groups of :func:`_dealt`: pairs of nodes of neighbouring bands that lie in different components.

    Groups of larger tiles come with sizes and bitmaps, and only pairs within their bounds are handed on.
    """

    def tested(key: tuple, run: list[tuple]) -> Iterator[pa.RecordBatch]:
        side, band, node, comp, n = (np.array(c, dtype=np.int64) for c in list(zip(*run))[:5])
        bits, halves = [x[5] for x in run], key[2] == 1 or key[2] == 0 and key[3] != key[4]
        if (comp == comp[0]).all():
            return
        bounded = bits[0] is not None
        for i in range(0, len(node), tile):
            for j in range(i, len(node), tile):
                if band[j] > band[min(i + tile, len(node)) - 1] + 1:
                    break
                a, b = slice(i, i + tile), slice(j, j + tile)
                fit = (comp[a, None] != comp[None, b]) & (np.abs(band[a, None] - band[None, b]) <= 1)
                if halves:
                    fit &= side[a, None] != side[None, b]
                if i == j:
                    fit &= np.tri(*fit.shape, k=-1, dtype=bool).T
                if bounded and fit.any():
                    width = min(map(len, bits[a] + bits[b]))
                    x, y = _folded(bits[a], width), _folded(bits[b], width)
                    apart = np.zeros(fit.shape, dtype=np.int64)
                    for word in range(width // 8):
                        apart += np.bitwise_count(x[:, None, word] ^ y[None, :, word])
                    both = n[a, None] + n[None, b]
                    overlap = np.minimum((both - apart) // 2, np.minimum(n[a, None], n[None, b]))
                    fit &= den * overlap >= num * (both - overlap)
                x, y = np.nonzero(fit)
                if len(x):
                    left, right = node[a][x], node[b][y]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], ["a", "b"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, run = None, []
        for batch in batches:
            for *key, side, band, node, comp, n, bits in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last:
                    if len(run) > 1:
                        yield from tested(last, run)
                    last, run = key, []
                run.append((side, band, node, comp, n, bits))
        if len(run) > 1:
            yield from tested(last, run)

    return pairs


def _arrays(rows: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(raw, more, hashes) of the documents in ``ids`` (and of a few others that its hashed marks let through)."""
    marks = send(rows.sparkSession, id_marks(ids))

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(k)
        for batch in batches:
            fit = marked(batch.column("doc_id"), marks.value)
            for part in column_batches([batch.filter(pa.array(fit))]):
                found = [v for v in map(make, bytes_of(part)) if len(v)]
                keys = [node_of(v) for v in found]
                columns = [pa.array([x[i] for x in keys], pa.int64()) for i in (0, 1)] + [pa.array([v.tobytes() for v in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["raw", "more", "hashes"])

    return rows.mapInArrow(trimmed(arrays), "raw bigint, more bigint, hashes binary")


def _bounded(num: int, den: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in column_batches(batches):
            fit = []
            for na, nb, xa, xb in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "xa", "xb"))):
                x, y = np.frombuffer(xa, np.uint64), np.frombuffer(xb, np.uint64)
                while len(x) > len(y):
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                while len(y) > len(x):
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                overlap = min((na + nb - int(np.bitwise_count(x ^ y).sum())) // 2, na, nb)
                fit.append(den * overlap >= num * (na + nb - overlap))
            yield batch.filter(pa.array(fit)).select(["a", "b"])

    return check


def _intersected(num: int, den: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in column_batches(batches, 32 << 20):
            fit = []
            for x, y in zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist()):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = np.concatenate([u, v])
                same.sort(kind="stable")
                overlap = int((same[1:] == same[:-1]).sum())
                fit.append(den * overlap >= num * (len(u) + len(v) - overlap))
            yield batch.filter(pa.array(fit)).select(["a", "b"])

    return check


def _verified(pairs: DataFrame, sizes: DataFrame, nodes: DataFrame, rows: DataFrame, k: int, num: int, den: int, node_bits: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold; arrays are made of those alone that pass the bounds."""
    seen = pairs.join(sizes.toDF("a", "na", "xa"), "a").join(sizes.toDF("b", "nb", "xb"), "b")
    close = seen.filter(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
    left = cut(close.mapInArrow(_bounded(num, den), "a bigint, b bigint"))
    met = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    met = cut(met.join(nodes.select("node", "rep", "raw", "more"), "node"))
    made = _arrays(rows, met.select(F.col("rep").alias("doc_id")), k)
    whole = F.lit(True) if node_bits == 64 else F.lit(False)
    found = made.withColumn("raw", F.when(whole, F.col("raw")).otherwise(F.col("raw").bitwiseAND((1 << min(node_bits, 62)) - 1)))
    arrays = cut(found.join(met, ["raw", "more"]).select("node", "hashes").dropDuplicates(["node"]))
    both = left.join(arrays.toDF("b", "hb"), "b").join(arrays.toDF("a", "ha"), "a")
    return cut(both.mapInArrow(_intersected(num, den), "a bigint, b bigint"))


def _mixed(runs: DataFrame, links: DataFrame) -> DataFrame:
    """The tiles' rows with their components, of shingles that more than one component has."""
    roots = components(links, "a", "b").toDF("node", "root")
    marked = runs.join(roots, "node", "left").select("h", "band", "node", F.coalesce("root", "node").alias("comp"))
    several = marked.groupBy("h").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size")).filter("c0 != c1")
    return marked.join(several.select("h", "size"), "h")


def near_components(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", node_bits: int = 64) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id.

    Lower-cases A-Z, takes words between characters of [\\x20\\x09-\\x0D]; a document's set are its distinct ``k``-word
    shingles, or its whole word sequence if it is shorter. Documents link when den * |intersection| >= num * |union|;
    component_id is the smallest id that links reach. Null texts count as empty; empty sets link with nothing. Rows
    without an id have no component and take no part; rows that share an id are one document of several texts: all
    get one component. Very long texts are one set like any other. Other columns are ignored; an empty table gives no
    rows. ``node_bits`` (64, or up to 62 to try clashes) are what sets are first numbered by; the result doesn't
    depend on it.
    """
    unsend()
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    facts, nodes = _nodes(_facts(rows, k, num, den, node_bits))
    full = facts.filter("node is not null and doc_id is not null")
    runs, stars = _stars(full)
    sizes = full.filter("prefix is not null").join(runs.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]).select("node", "n", "bits")
    sizes = cut(sizes)
    verified = lambda pairs: _verified(pairs, sizes, nodes, rows, k, num, den, node_bits)
    links = verified(stars)

    # other leaders for what is left: two random members of each tile, so large groups of copies become one component
    mixed = cut(_mixed(runs, links))
    pick = [F.min_by(F.struct("node", "comp"), F.xxhash64("h", "node", F.lit(seed))) for seed in (1, 2)]
    leaders = mixed.groupBy("h", "band").agg(F.array(*pick).alias("lead"))
    met = mixed.join(leaders, ["h", "band"]).select("node", "comp", F.explode("lead").alias("lead")).filter("comp != lead.comp")
    more = met.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()
    more = cut(more.join(stars, ["a", "b"], "left_anti"))
    links = links.unionByName(verified(more))

    open_runs = cut(_mixed(mixed.select("h", "band", "node"), links))
    rest = _dealt(open_runs, sizes, partitions(df)).mapInArrow(_unconnected(num, den), "a bigint, b bigint").distinct()
    rest = rest.join(stars.unionByName(more), ["a", "b"], "left_anti")
    links = links.unionByName(verified(rest))

    # rows that share an id are one document
    reps = nodes.select("node", "rep")
    edges = links.join(reps.toDF("a", "ra"), "a").join(reps.toDF("b", "rb"), "b").select("ra", "rb")
    same = full.select("node", "doc_id").join(full.groupBy("doc_id").agg(F.count_distinct("node").alias("v")).filter("v > 1"), "doc_id", "left_semi")
    edges = edges.unionByName(same.join(reps, "node").select(F.col("rep").alias("ra"), F.col("doc_id").alias("rb")))
    final = nodes.join(components(edges, "ra", "rb").toDF("rep", "root"), "rep", "left")
    final = final.select("node", "copies", F.coalesce("root", "rep").alias("component_id"))
    found = skew_safe_join(full.select("doc_id", "n", "node"), final, "node", "copies", full.count())
    alone = facts.filter("node is null or doc_id is null").select("doc_id", "n", F.when(F.col("node").isNull(), F.col("doc_id")).alias("component_id"))
    return found.select("doc_id", "n", "component_id").unionByName(alone).withColumnRenamed("n", "n_shingles")
