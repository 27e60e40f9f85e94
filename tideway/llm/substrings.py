"""Substring deduplication with a compressed FM-index for each shard.

A window is WINDOW consecutive words of one document. Words under a window that
also starts in a document with a smaller doc_id are removed.

Dealing. The key of a window is the least hash among its GRAM-word runs. Equal
windows have equal keys, and neighbours mostly share one, so a document is cut
into segments: runs of windows with one key. Segments, not documents, are
dealt to shards, and each document is streamed only against the shards where
its windows can be. First only the keys travel: a shard says which of them
occur in more than one document. Then the segments under such keys travel with
their words. What a task already sees repeated among its own documents is
settled there, so a passage that many share travels once a task.

Search. A shard sorts the suffixes of its distinct segments to WINDOW words and
keeps of them the Burrows-Wheeler transform as a wavelet matrix over packed
bits with 32-bit counts, and for each suffix the number of its segment in the
narrowest type; neither the text nor the suffix array stays. The documents'
segments are then streamed against that index, a bounded number of windows at a
time: their words are looked up in the index's vocabulary and every window is
extended backwards, word by word. A window whose interval shrinks to one row is
matched by itself alone and stops: the length reached is its matching
statistic. Those that reach WINDOW words are compared with the smallest
document in their interval.

Words are 64-bit XXH64 numbers from the first step on; a false match takes two
different words of one number in equal surroundings.

Edge cases: a null text has no words; texts shorter than a window lose
nothing; a null doc_id is smaller than all others; rows with one doc_id never
remove each other's words; empty tables give no rows; other columns are left
alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tideway.llm.common import batch, binary, small_batches

WINDOW, GRAM = 13, 7
#: Words that a map task works on at once, and text bytes for each shard.
CHUNK_WORDS, SHARD_BYTES = 1_500_000, 7_500_000
#: A small table still spreads over a cluster.
LEAST_SHARDS = 64
#: Windows that are streamed against an index at once.
HELD = 1 << 18
NULL_ID = -(1 << 63)
MEMORY = 400_000


class Numbers(dict):
    """Word -> its number; remembers the words it met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        got = self[word] = xxh64_intdigest(word)
        return got


NUMBERS = Numbers()


def numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all words, and where each text's words start (one more entry at the end)."""
    split = [t.split() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)
    return np.fromiter(map(NUMBERS.__getitem__, chain.from_iterable(split)), np.uint64, int(at[-1])), at


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Segments:
    """Runs of windows with one key: first window, windows, key, document (its place among the texts)."""

    def __init__(self, words: np.ndarray, at: np.ndarray):
        n, k = len(words), WINDOW - GRAM + 1
        self.first = self.many = self.doc = np.zeros(0, np.int64)
        self.key = np.zeros(0, np.uint64)
        if n < WINDOW:
            return
        gram = np.zeros(n - GRAM + 1, np.uint64)
        for j in range(GRAM):
            gram = gram * np.uint64(0xD6E8FEB86659FD93) + words[j : n - GRAM + 1 + j]
        low, span = mixed(gram), 1
        while span < k:
            step = min(span, k - span)
            low = np.minimum(low[:-step], low[step:])
            span += step
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(low)]
        whole = np.arange(len(low)) + WINDOW <= at[doc + 1]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        many = np.add.reduceat(whole.astype(np.int64), first) if len(first) else first
        keep = many > 0
        self.first, self.many = first[keep], many[keep]
        self.key, self.doc = low[self.first], doc[self.first]
        #: The number of a segment within its document.
        start = np.concatenate([[True], self.doc[1:] != self.doc[:-1]]) if len(self.doc) else np.zeros(0, bool)
        self.ordinal = np.arange(len(self.doc)) - np.maximum.accumulate(np.where(start, np.arange(len(self.doc)), 0))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstandard frame."""
    import zstandard

    body = b"".join(len(a).to_bytes(8, "little") + a.dtype.str.encode().ljust(4) + np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpacked(raw: bytes) -> list[np.ndarray]:
    import zstandard

    body, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    while at < len(body):
        n, kind = int.from_bytes(body[at : at + 8], "little"), np.dtype(body[at + 8 : at + 12].decode().strip())
        out.append(np.frombuffer(body, kind, n, at + 12))
        at += 12 + n * kind.itemsize
    return out


def small(a: np.ndarray) -> np.ndarray:
    """a in the narrowest unsigned type that holds it."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def by_document(doc: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(document, its values) for each document, from rows in any order."""
    if not len(doc):
        return
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    for a, b in zip(edge, [*edge[1:], len(doc)], strict=True):
        yield int(doc[a]), [v[order[a:b]] for v in values]


def chunks(batches: Iterable[pa.RecordBatch], words: int, extra: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]]:
    """doc ids, text hashes, words, starts and an extra column of as many documents as have about so many words."""
    ids, hashes, texts, more, size = [], [], [], [], 0
    for b in batches:
        for d, h, t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), binary(b.column(2)), b.column(extra).to_pylist() if extra else [None] * b.num_rows, strict=True):
            ids.append(NULL_ID if d is None else d)
            hashes.append(h)
            texts.append(t)
            more.append(x)
            size += len(t)
            if size >= 6 * words:
                yield np.array(ids, np.int64), np.array(hashes, np.int64), *numbered(texts), more
                ids, hashes, texts, more, size = [], [], [], [], 0
    if ids:
        yield np.array(ids, np.int64), np.array(hashes, np.int64), *numbered(texts), more


_BLOB = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("blob", pa.binary())])
_BLOB_DDL = "shard int, doc_id long, hash long, blob binary"
_FOUND = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("blob", pa.binary())])
_FOUND_DDL = "doc_id long, hash long, blob binary"

def _keys(shards: int, chunk_words: int):
    """For each shard the keys of a chunk; keys that two documents of the chunk share are settled at once."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, words, at, _ in chunks(batches, chunk_words):
            s = Segments(words, at)
            if not len(s.key):
                continue
            order = np.lexsort((s.doc, s.key))
            key, doc = s.key[order], ids[s.doc[order]]
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            group = np.repeat(np.arange(len(edge)), np.diff([*edge, len(key)]))
            shared = np.minimum.reduceat(doc, edge) != np.maximum.reduceat(doc, edge)
            again = order[shared[group]]
            rows = [(int(hashes[d]) % shards, int(ids[d]), int(hashes[d]), packed(small(np.sort(o)))) for d, (o,) in by_document(s.doc[again], s.ordinal[again])]
            # A document may have a key in several segments: each asks.
            ask = np.concatenate([order[~shared[group]], order[edge[shared]]])
            known = np.concatenate([np.zeros(len(ask) - int(shared.sum()), bool), np.ones(int(shared.sum()), bool)])
            # 40 bits of a key within its shard: two keys that look alike here only send more words later.
            short = (s.key // np.uint64(shards)) & np.uint64((1 << 40) - 1)
            shard = (s.key[ask] % np.uint64(shards)).astype(np.int64)
            for k, (a, m) in by_document(shard, ask, known):
                a, m = a[o := np.argsort(short[a], kind="stable")], m[o]
                have, place = np.unique(s.doc[a], return_inverse=True)
                rows.append((k, None, None, packed(small(np.diff(short[a], prepend=np.uint64(0))), m.view(np.uint8), small(place), small(s.ordinal[a]), ids[have], hashes[have])))
            yield batch(_BLOB, *zip(*rows, strict=True))

    return work


def repeated(blobs: list[list[np.ndarray]]) -> Iterator[tuple[int, int, bytes]]:
    """Which segments of which documents have a key that other documents have too."""
    key = np.concatenate([np.cumsum(b[0], dtype=np.uint64) for b in blobs])
    known = np.concatenate([b[1] for b in blobs]).astype(bool)
    doc = np.concatenate([b[4][b[2]] for b in blobs])
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    group = np.empty(len(key), np.int64)
    group[order] = np.repeat(np.arange(len(edge)), np.diff([*edge, len(key)]))
    shared = (np.minimum.reduceat(doc[order], edge) != np.maximum.reduceat(doc[order], edge)) | np.logical_or.reduceat(known[order], edge)
    tell, at = shared[group] & ~known, 0
    for b in blobs:
        t = tell[at : at + len(b[0])]
        at += len(b[0])
        for d, (o,) in by_document(b[2][t].astype(np.int64), b[3][t]):
            yield int(b[4][d]), int(b[5][d]), packed(small(np.sort(o)))


def _by_shard(answer):
    """One shard's rows at a time, sorted by shard: its blobs are answered together, rows of a document are final and go on as they are."""

    def rows(found) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(found), 4096):
            yield batch(_FOUND, *zip(*found[i : i + 4096], strict=True))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            final = []
            for k, d, h, raw in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if k != now and held:
                    yield from rows(list(answer(held)))
                    held = []
                now = k
                if d is None:
                    held.append(unpacked(raw))
                else:
                    final.append((d, h, raw))
            yield from rows(final)
        if held:
            yield from rows(list(answer(held)))

    return work


class WaveletMatrix:
    """rank(symbol, place) over a sequence: one packed bit vector with counts for each bit of a symbol."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.word, self.count, self.zeros = bits, [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            pad = np.zeros((len(seq) // 64 + 1) * 64, np.uint8)
            pad[: len(seq)] = bit
            word = np.packbits(pad, bitorder="little").view("<u8")
            self.word.append(word)
            self.count.append(np.concatenate([[0], np.cumsum(np.bitwise_count(word), dtype=np.int64)]).astype(np.uint32 if len(seq) < 1 << 32 else np.int64))
            self.zeros.append(len(seq) - int(bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def ones(self, level: int, i: np.ndarray) -> np.ndarray:
        q = i >> 6
        return self.count[level][q].astype(np.int64) + np.bitwise_count(self.word[level][q] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before lo and before hi."""
        start = np.zeros(len(symbol), np.int64)
        both = np.concatenate([start, lo, hi])
        n = len(symbol)
        for level in range(self.bits):
            bit = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            one = self.ones(level, both)
            both = np.where(np.tile(bit, 3), one + self.zeros[level], both - one)
        return both[n : 2 * n] - both[:n], both[2 * n :] - both[:n]


class FMIndex:
    """Backward search for runs of up to ``depth`` symbols in a text whose symbol 0 separates its parts. ``owner`` numbers the part that each place of the text is in; of each suffix that number is kept."""

    def __init__(self, text: np.ndarray, owner: np.ndarray, depth: int):
        rank, have = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while have < depth:
            step = min(have, depth - have)
            after = np.zeros_like(rank)
            after[:-step] = rank[step:]
            pair = rank * (int(rank.max()) + 1) + after
            order = np.argsort(pair, kind="stable")
            new = np.concatenate([[False], pair[order][1:] != pair[order][:-1]])
            rank = np.empty_like(rank)
            rank[order] = np.cumsum(new)
            have += step
        self.owner = small(owner)[order]
        last = np.concatenate([text[-1:], text[:-1]])[order]
        self.top = int(text.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.top))])
        self.tree = WaveletMatrix(last, max(1, int(self.top - 1).bit_length()))

    def match(self, stream: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For runs of ``length`` symbols of a stream that start at the given places: how many symbols, from the end, more than one suffix matches, and the interval of suffixes where all of them do. A symbol that the text does not have, or 0, matches nothing."""
        stream = np.where(stream < self.top, stream, 0)
        reached = np.zeros(len(start), np.int64)
        sp, ep = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        at = np.arange(len(start))
        c = stream[start + length - 1]
        lo, hi = np.where(c > 0, self.before[c], 0), np.where(c > 0, self.before[c + 1], 0)
        for j in range(length - 2, -2, -1):
            several = hi - lo > 1
            at, lo, hi = at[several], lo[several], hi[several]
            reached[at] += 1
            if j < 0 or not len(at):
                break
            c = stream[start[at] + j]
            a, b = self.tree.rank(c, lo, hi)
            lo, hi = np.where(c > 0, self.before[c] + a, 0), np.where(c > 0, self.before[c] + b, 0)
        sp[at], ep[at] = lo, hi
        return reached, sp, ep

    def least(self, sp: np.ndarray, ep: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The least value, by owner, in each interval of suffixes."""
        begin, which = np.unique(sp, return_inverse=True)
        end = np.zeros(len(begin), np.int64)
        end[which] = ep
        low = np.append(value[self.owner], np.iinfo(np.int64).max)  # reduceat wants places below the length
        found = np.minimum.reduceat(low, np.stack([begin, end], 1).ravel())[::2] if len(begin) else low[:0]
        return found[which]


def segment_numbers(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each segment: the sum of its words' numbers by powers of an odd base, and its length."""
    power = np.cumprod(np.full(int(size.max(initial=1)), 0xC6BC279692B5C323, np.uint64))
    edge = np.cumsum(size) - size
    flat = np.repeat(start - edge, size) + np.arange(int(size.sum()))
    return mixed(np.add.reduceat(mixed(words[flat]) * power[flat - np.repeat(start, size)], edge)) + size.astype(np.uint64)


def _needed(shards: int, chunk_words: int):
    """For each shard the segments of a chunk that were said to repeat, each distinct one once, with the smallest document that has it."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, words, at, flags in chunks(batches, chunk_words, extra=3):
            s = Segments(words, at)
            first = np.searchsorted(s.doc, np.arange(len(ids)))
            pick = [first[d] + unpacked(x)[0].astype(np.int64) for d, xs in enumerate(flags) for x in xs or ()]
            if not pick:
                continue
            pick = np.unique(np.concatenate(pick))
            start, many, key, doc = s.first[pick], s.many[pick], s.key[pick], s.doc[pick]
            size = many + WINDOW - 1
            number = segment_numbers(words, start, size)
            order = np.lexsort((ids[doc], number))
            run = np.concatenate([[True], number[order][1:] != number[order][:-1]])
            least = ids[doc[order]][np.maximum.accumulate(np.where(run, np.arange(len(order)), 0))]
            own = ids[doc[order]] == least
            gone, kept, of = order[~own], order[run], np.cumsum(run) - 1
            rows = [(int(hashes[d]) % shards, int(ids[d]), int(hashes[d]), packed(small(np.sort(a - at[d])), small(n[np.argsort(a)]))) for d, (a, n) in by_document(doc[gone], start[gone], many[gone])]
            owner, group = order[own], of[own]  # occurrences in the smallest document
            shard = (key[kept] % np.uint64(shards)).astype(np.int64)
            members = np.argsort(group, kind="stable")
            lo, hi = np.searchsorted(group[members], np.arange(len(kept))), np.searchsorted(group[members], np.arange(len(kept)), "right")
            for k, (which,) in by_document(shard, np.arange(len(kept))):
                seg = kept[which]
                n = size[seg]
                e = np.cumsum(n) - n
                body, ids_at = np.unique(words[np.repeat(start[seg] - e, n) + np.arange(int(n.sum()))], return_inverse=True)
                count = hi[which] - lo[which]
                occ = owner[members[np.repeat(lo[which] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]]
                have, place = np.unique(doc[occ], return_inverse=True)
                rows.append((k, None, None, packed(body, small(ids_at), small(n), key[seg].astype(np.uint32), small(count), small(place), small(start[occ] - at[doc[occ]]), ids[have], hashes[have])))
            yield batch(_BLOB, *zip(*rows, strict=True))

    return work


def matched(blobs: list[list[np.ndarray]], window: int = WINDOW) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(doc_id, hash, first windows, windows in a row) that also start in a smaller document, from one shard's segments."""
    body = [b[0][b[1]] for b in blobs]
    size = np.concatenate([b[2].astype(np.int64) for b in blobs])
    key = np.concatenate([b[3] for b in blobs])
    count = np.concatenate([b[4].astype(np.int64) for b in blobs])
    doc = np.concatenate([b[7][b[5]] for b in blobs])
    hashed = np.concatenate([b[8][b[5]] for b in blobs])
    place = np.concatenate([b[6].astype(np.int64) for b in blobs])
    words = np.concatenate(body)
    first, source = np.cumsum(count) - count, np.cumsum(size) - size
    least = doc[first]
    # Of equal segments only the one of the smallest document is searched; in all others each window is a repeat.
    number = segment_numbers(words, source, size)
    order = np.lexsort((least, number))
    run = np.concatenate([[True], number[order][1:] != number[order][:-1]])
    smallest = least[order][np.maximum.accumulate(np.where(run, np.arange(len(order)), 0))]
    later = order[least[order] > smallest]
    times = count[later]
    lost = np.repeat(first[later] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    seg, same = order[run], order[~run & (least[order] == smallest)]  # equal segments of one document are searched each, which is rare
    seg = np.concatenate([seg, same])
    # A segment alone under its key has no window that another has.
    _, of, n_key = np.unique(key[seg], return_inverse=True, return_counts=True)
    seg = seg[n_key[of] > 1]
    names, doc_at = np.unique(np.stack([doc, hashed], 1), axis=0, return_inverse=True)
    doc_at = doc_at.ravel()
    found = [(doc_at[lost], place[lost], np.repeat(size[later], times) - window + 1)]
    if len(seg):
        found.append(_searched(words, size, source, seg, least, first, count, place, doc_at, window))
    who, begin, length = (np.concatenate(x) for x in zip(*found, strict=True))
    for d, (x, y) in by_document(who, begin, length):
        yield int(names[d, 0]), int(names[d, 1]), x, y


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of runs that begin at start and have so many places, one run after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _searched(words, size, source, seg, least, first, count, place, doc_at, window) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document, first window, windows in a row of the segments' windows that a smaller document has too."""
    n, value = size[seg], least[seg]
    vocabulary, symbol = np.unique(words[_runs(source[seg], n)], return_inverse=True)
    edge = np.cumsum(n + 1) - (n + 1)
    text = np.zeros(int((n + 1).sum()), np.int64)
    text[_runs(edge, n)] = symbol + 1
    index = FMIndex(text, np.repeat(np.arange(len(seg)), n + 1), window)
    del text, symbol
    out = [(np.zeros(0, np.int64),) * 3]
    many = n - window + 1
    parts = np.searchsorted(np.cumsum(many), np.arange(HELD, int(many.sum()), HELD)) + 1
    for which in np.split(np.arange(len(seg)), np.unique(parts)):
        if not len(which):
            continue
        # These segments as a stream of symbols, whatever index they are searched in.
        said = words[_runs(source[seg[which]], n[which])]
        at = np.minimum(np.searchsorted(vocabulary, said), len(vocabulary) - 1)
        stream = np.where(vocabulary[at] == said, at + 1, 0)
        base = np.cumsum(n[which]) - n[which]
        own, start = np.repeat(which, many[which]), _runs(base, many[which])
        offset = start - np.repeat(base, many[which])
        reached, sp, ep = index.match(stream, start, window)
        full = np.flatnonzero(reached == window)
        hit = full[index.least(sp[full], ep[full], value) < value[own[full]]]
        # Windows in a row, for each occurrence of the segment in its smallest document.
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (own[hit][1:] != own[hit][:-1])])) if len(hit) else hit
        length = np.diff([*begin, len(hit)])
        s, away = own[hit[begin]], offset[hit[begin]]
        times = count[seg[s]]
        occ = _runs(first[seg[s]], times)
        out.append((doc_at[occ], place[occ] + np.repeat(away, times), np.repeat(length, times)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def removed(blobs: list[list[np.ndarray]]) -> Iterator[tuple[int, int, bytes]]:
    for d, h, a, k in matched(blobs):
        yield d, h, packed(small(a), small(k))


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def _strip(digest: bool):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for copy, text, found in zip(b.column(1).to_pylist(), binary(b.column(2)), b.column(3).to_pylist(), strict=True):
                words = text.split()
                n = len(words)
                if copy and n >= WINDOW:
                    words = []
                elif found:
                    change = np.zeros(n + 1, np.int64)
                    for raw in found:
                        a, k = (x.astype(np.int64) for x in unpacked(raw))
                        np.add.at(change, a, 1)
                        np.add.at(change, a + k + WINDOW - 1, -1)
                    stay = np.cumsum(change[:n]) == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                n_words.append(n)
                n_removed.append(n - len(words))
                left = b" ".join(words)
                kept.append(hashlib.sha256(left).hexdigest().encode() if digest else left)
            ids = pa.array([None if d == NULL_ID else d for d in b.column(0).to_pylist()], pa.int64())
            yield batch(_RESULT, ids, n_words, n_removed, kept)

    return work


def deduplicated(docs: DataFrame, digest: bool = False, chunk_words: int = CHUNK_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept: what is left of each text, its words joined by one space (or its SHA-256)."""
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(max(LEAST_SHARDS, size // shard_bytes))
    texts = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    # A text that a smaller document has as a whole has no other window: such copies are known by a digest and travel no further.
    digests = texts.select("doc_id", "hash", F.md5("text").alias("md5"))
    first = digests.groupBy("md5").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = digests.join(first, "md5").where("doc_id > first").select("doc_id", "hash", F.lit(True).alias("copy")).distinct()
    dealt = texts.repartition("doc_id", "hash").join(copies.hint("shuffle_hash"), ["doc_id", "hash"], "left")
    own = dealt.where("copy is null").drop("copy")

    def of_document(rows: DataFrame, answer) -> DataFrame:
        """The blobs for each document, from the tasks that settled them and from the shards."""
        found = rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(_by_shard(answer), _FOUND_DDL)
        return found.groupBy("doc_id", "hash").agg(F.collect_list("blob").alias("blobs"))

    # One plan: both joins read the same exchange of the texts.
    flags = of_document(own.mapInArrow(_keys(shards, chunk_words), _BLOB_DDL), repeated)
    flagged = own.join(flags.hint("shuffle_hash"), ["doc_id", "hash"], "inner")
    segments = flagged.select("doc_id", "hash", "text", "blobs").mapInArrow(_needed(shards, chunk_words), _BLOB_DDL)
    spans = of_document(segments, removed)
    joined = dealt.join(spans.hint("shuffle_hash"), ["doc_id", "hash"], "left")
    out = joined.select("doc_id", "copy", "text", "blobs").mapInArrow(_strip(digest), "doc_id long, n_words long, n_removed long, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))


def digest(docs: DataFrame) -> DataFrame:
    return deduplicated(docs, digest=True).withColumnRenamed("kept", "kept_sha256")
