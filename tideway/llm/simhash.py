"""SimHash near-duplicates, searched through BK-trees of shards.

A fingerprint has a bit for each of 64 places, set when more than half of the
XXH64 hashes of the text's word shingles have it. Two fingerprints within
RADIUS bits agree on at least two of six blocks of bits, whatever they are. So
each distinct fingerprint is dealt to the 15 shards of its pairs of blocks, and
each shard is a BK-tree: children are keyed by their distance to the parent,
and a search follows only edges within the radius of its distance to a node.
A shard's tree and the fingerprints searched in it are dealt to one task
together, which takes the place of a broadcast whose size would grow with the
table. Trees are built and searched as arrays, level by level, all shards of a
task at once. A shard hands on links of a spanning forest, never all pairs.

Beyond HOT_ROWS fingerprints a shard's queries are dealt to several tasks, each
with the same tree, so no dense group is one task's work.

Edge cases: a null text is empty; a text without words has fingerprint zero,
linked like any other; fewer words than a shingle are one shingle; repeated
rows share their fingerprint; an empty table gives no rows; a null doc_id never
names a component unless nothing else does. ``kept`` keeps other columns
whatever their names; of rows that share the smallest doc_id of a group one
stays, chosen by a hash of all its columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.common import batch, binary, components, cut, one_of_alike, row_key, small_batches

RADIUS = 4
#: First bit and width of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Pairs of query and node that a search holds at once.
HELD = 1 << 20


def fingerprint(raw: bytes, words: int = 4, seed: int = 42) -> int:
    from xxhash import xxh64_intdigest as h

    found = raw.lower().split()
    if not found:
        return 0
    text = b" ".join(found)
    if len(found) <= words:
        return h(text, seed)
    gap = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    starts = [0, *(gap + 1).tolist()]
    ends = [*gap.tolist(), len(text)][words - 1 :]
    hashes = np.array([h(text[a:b], seed) for a, b in zip(starts, ends)], ">u8")  # the last starts have no end of their own
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


_PRINTS = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int32()), ("fp", pa.int64())])


def _prints(words: int, seed: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t, words, seed) for t in binary(b.column(3))], np.uint64)
            yield batch(_PRINTS, *(b.column(i) for i in range(3)), pa.array(got.view(np.int64)))

    return work


def prints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, h1 and h2 (hashes of the row), fp: the fingerprint as a signed 64-bit number."""
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", row_key(docs).alias("key"), "text").select("doc_id", "key.h1", "key.h2", "text")
    return keyed.mapInArrow(_prints(words, seed), "doc_id long, h1 long, h2 int, fp long")


def shards(fps: DataFrame) -> DataFrame:
    """key, fp, first: each fingerprint under each of its 15 pairs of blocks."""
    part = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in BLOCKS]
    keys = [F.lit(k << 32) + part[i] * F.lit(1 << 11) + part[j] for k, (i, j) in enumerate(combinations(range(6), 2))]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp", "first")


class Forest:
    """BK-trees over fingerprints, one for each run of equal keys; node k is fingerprint k."""

    def __init__(self, keys: np.ndarray, fps: np.ndarray):
        n = len(fps)
        self.fps = fps.view(np.uint64)
        new = np.concatenate([[True], keys[1:] != keys[:-1]]) if n else np.zeros(0, bool)
        self.root = np.flatnonzero(new)[np.cumsum(new) - 1] if n else np.zeros(0, np.int64)
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        todo = np.flatnonzero(~new)
        at = self.root[todo]
        while len(todo):
            d = np.bitwise_count(self.fps[todo] ^ self.fps[at]).astype(np.int64)
            slot = at * 65 + d
            _, first, of = np.unique(slot, return_index=True, return_inverse=True)
            child = todo[first]
            parent[child], edge[child] = at[first], d[first]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, at = todo[rest], child[of][rest]
        order = np.lexsort((edge, parent))
        self.kids, self.edge = order, edge[order]
        owner = parent[order]
        self.lo, self.hi = np.searchsorted(owner, np.arange(n)), np.searchsorted(owner, np.arange(n), "right")

    def search(self, query: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, nodes) within radius, in pieces. A query is the number of a fingerprint, searched in its own tree."""
        work = [(query, self.root[query])]
        while work:
            q, at = work.pop()
            if len(q) > HELD:
                half = len(q) // 2
                work += [(q[:half], at[:half]), (q[half:], at[half:])]
                continue
            d = np.bitwise_count(self.fps[q] ^ self.fps[at]).astype(np.int64)
            near = (d <= radius) & (q > at)
            if near.any():
                yield q[near], at[near]
            many = self.hi[at] - self.lo[at]
            q, at, d = np.repeat(q, many), np.repeat(at, many), np.repeat(d, many)
            if not len(q):
                continue
            place = np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many) + self.lo[at]
            follow = np.abs(self.edge[place] - d) <= radius
            if follow.any():
                work.append((q[follow], self.kids[place[follow]]))


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the classes of a[i] and b[i]; label holds a root, the smallest member, for each element."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            nxt = label[label]
            if np.array_equal(nxt, label):
                break
            label[:] = nxt


_EDGES = pa.schema([("a", pa.int64()), ("first_a", pa.int64()), ("b", pa.int64()), ("first_b", pa.int64())])
TREE_ROWS = 200_000
#: Rows of a shard whose queries one task answers.
HOT_ROWS = 20_000
#: What a fingerprint without any doc_id is ordered by.
NO_ID = (1 << 63) - 1


def _links(radius: int):
    def linked(key: np.ndarray, mine: np.ndarray, fp: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        trees, label, asked = Forest(key, fp), np.arange(len(fp)), np.flatnonzero(mine)
        for i in range(0, len(asked), 4096):
            for q, at in trees.search(asked[i : i + 4096], radius):
                joined(label, q, at)
        own = np.flatnonzero(label != np.arange(len(fp)))
        to = label[own]
        return batch(_EDGES, *map(pa.array, (fp[own], first[own], fp[to], first[to])))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            key = b.column(0).to_numpy() * 4096 + b.column(1).to_numpy()  # a shard's deal for one task is a tree of its own
            held.append((key, b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(), b.column(4).to_numpy()))
            rows += len(key)
            if rows >= TREE_ROWS:  # whole shards only: the last key may go on
                every = [np.concatenate(x) for x in zip(*held, strict=True)]
                end = int(np.searchsorted(every[0], every[0][-1]))
                if end:
                    yield linked(*_several(*(x[:end] for x in every)))
                held, rows = [tuple(x[end:] for x in every)], len(every[0]) - end
        if held:
            yield linked(*_several(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return work


def _several(key: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows whose key has others."""
    if len(key) < 2:
        return key[:0], *(x[:0] for x in others)
    same = key[1:] == key[:-1]
    keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    return key[keep], *(x[keep] for x in others)


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, first_a, b, first_b: links within the radius between distinct fingerprints (fp, first) that join all that are linked, a forest for each task."""
    if radius != RADIUS:
        raise ValueError("six blocks, two agreed, hold for a radius of 4")
    entries = shards(fps)
    hot = entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select("key", F.least(F.lit(4096), F.ceil(F.col("n") / HOT_ROWS)).cast("int").alias("parts"))
    hot = cut(hot)
    if hot.limit(1).count():
        entries = entries.join(hot, "key", "left").select("key", "fp", "first", F.coalesce("parts", F.lit(1)).alias("parts"))
        entries = entries.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        entries = entries.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")) == F.col("part"))
    else:
        entries = entries.withColumns({"part": F.lit(0), "mine": F.lit(True)})
    dealt = entries.select("key", "part", "mine", "fp", "first").repartition("key", "part").sortWithinPartitions("key", "part", "fp")
    return dealt.mapInArrow(_links(radius), "a long, first_a long, b long, first_b long")


def groups(docs: DataFrame, words: int = 4, seed: int = 42, radius: int = RADIUS) -> DataFrame:
    """doc_id, h1, h2 (hashes of the row), fp, component_id (the smallest doc_id reachable, itself included)."""
    rows = cut(prints(docs, words, seed))
    least = cut(rows.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("first")))
    # A node is ordered by its smallest doc_id, so that a component's smallest node names it.
    node = lambda k: F.struct(F.col(f"first_{k}").alias("first"), F.col(k).alias("fp")).alias(k)
    roots = components(links(least, radius).select(node("a"), node("b"))).select(F.col("node.fp").alias("fp"), F.col("root.first").alias("root"))
    named = least.join(roots, "fp", "left").select("fp", F.nullif(F.coalesce("root", "first"), F.lit(NO_ID)).alias("component_id"))
    return rows.join(cut(named), "fp").select("doc_id", "h1", "h2", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def kept(docs: DataFrame, words: int = 4, seed: int = 42, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each group, that of the smallest doc_id. Rows without doc_id stay."""
    found = groups(docs, words, seed, radius).where("doc_id = component_id")
    first = found.groupBy("component_id").agg(F.min(F.struct("h1", "h2")).alias("key")).select("key")
    keyed = docs.where("doc_id is not null").select(row_key(docs).alias("key"), F.struct("*").alias("row"))
    stay = one_of_alike(keyed.join(first, "key", "left_semi"), "key")
    return stay.select("row.*").unionByName(docs.where("doc_id is null"))
