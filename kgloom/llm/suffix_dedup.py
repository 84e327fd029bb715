"""Suffix-array dedup: bytes of long repeats are removed, by bucket-pointer refinement.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller doc_id. Suffixes are
sorted by bucket-pointer refinement: they fall into buckets by their first q bytes, and a bucket is refined by sorting its
suffixes on the bucket identifiers of later offsets, identifiers that earlier rounds have refined already; a round so
doubles the depth, until buckets are equal over `length` bytes (`refine`).

To do so over all documents without a row per byte:

1. Anchors. Of every window of `length` bytes the q-gram with the smallest hash is its anchor. Equal windows have equal
   anchors at the same place, so only anchors (one byte in about 18) are compared. Documents are packed into chunks;
   chunks send the hashes of their anchors, packed, to the part that the hash belongs to, once a chunk; parts answer
   with a bit for each: does any other document have it. This is the initial bucketing by q-grams.
2. Contexts. For anchors that recur, chunks send two 64-bit hashes of the anchor's context (all bytes that windows around
   it can cover) to the part of the context, and those of its two half windows to the parts of these. Parts answer: an
   earlier document has the whole context, or another context has this half. Any window has one half or the other.
3. Refinement. Contexts that are the first of their kind and share a half are sent as bytes, as far as windows with that
   half reach, to the part of the half. Each
   part refines its buckets by bucket pointers to depth `length` and gives, for each window, the smallest document.
4. Chunks put the windows together, remove what they cover, and give the rest.

A group of copies, however large, is one context to each chunk, and an anchor with many different surroundings goes to as
many parts as these have halves; nothing is collected by group. There is a part for each `part_bytes` of text, whatever the
cluster's settings. Chunks are written once, bucketed by chunk, so that answers meet them without moving texts; the table
is dropped when the result is written.

Hashes of anchors have 48 bits and those of halves 32 within an anchor: a clash only makes a needless candidate. Contexts
are told apart by 128 bits beside the anchor's 48, mixed independently; clashes of these are not looked for.

Defined results: a null text is empty; rows with equal doc_id are no repeats of each other; a null doc_id is larger than
any other, and null ids are equal; texts shorter than `length` lose nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import documents, written

LENGTH, GRAM = 50, 16
_CHUNK = 4 << 20
PART_BYTES = 8 << 20
_LAST = (1 << 63) - 1
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _words64(data: bytes, at: int, n: int) -> np.ndarray:
    """The 8 bytes from each of n offsets, as numbers."""
    return np.ndarray((n,), "<u8", data, at, (1,))


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h + x) * _M2
    return h ^ (h >> np.uint64(29))


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _mix2(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _turn(h ^ (_turn(x * _M2, 31) * _M1), 27) * _M1 + np.uint64(0x52DCE729)


def hash_spans(data: bytes, starts: np.ndarray, sizes: np.ndarray, mix=_mix) -> np.ndarray:
    """A 64-bit hash of each span; data has 8 bytes of padding."""
    words = np.ndarray((len(data) - 8,), "<u8", data, 0, (1,))
    h = (sizes.astype(np.uint64) + np.uint64(1)) * _M1
    for k in range(0, int(sizes.max(initial=0)), 8):
        left = np.clip(sizes - k, 0, 8)
        x = words[np.minimum(starts + k, len(words) - 1)]
        keep = np.where(left >= 8, ~np.uint64(0), (np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1))
        h = np.where(left > 0, mix(h, x & keep), h)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x = best(x[:-k], x[k:])
        k *= 2
    return best(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the q-grams that are the smallest of some window; none in a text shorter than a window."""
    n = len(text) - gram + 1
    width = length - gram + 1
    if n < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    places, hashes, step = [], [], 1 << 17  # in pieces that stay in the cache
    for a in range(0, n - width + 1, step):
        b = min(a + step + width - 1, n)  # windows that start in [a, a + step)
        piece = text[a : b + gram - 1] + bytes(8)
        h = _words64(piece, 0, b - a) * _M1
        h ^= h >> np.uint64(29)
        for k in [*range(8, gram - 8, 8), gram - 8]:
            h = _mix(h, _words64(piece, k, b - a))
        low = _slide(h, width, np.minimum)
        pad = np.zeros(width - 1, np.uint64)
        at = np.flatnonzero(_slide(np.concatenate([pad, low, pad]), width, np.maximum) == h)
        places.append(at + a)
        hashes.append(h[at])
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def refine(data: bytes, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket identifiers of the suffixes at `starts`, equal exactly where their first `length` bytes are; ordered as the suffixes are.

    Buckets of 8 bytes come first. A round sorts on the pair of a suffix's bucket and the bucket `depth` bytes on, both
    as refined so far, which doubles the depth. The last round overlaps. `data` must go on for `length` bytes after the
    last start."""
    whole = data + bytes(8)
    covered = np.unique((starts[:, None] + np.arange(0, length - 7)).ravel()) if len(starts) * 43 < len(data) else np.arange(len(data))
    pointer = np.zeros(len(data) + 1, np.int64)
    _, inverse = np.unique(_words64(whole, 0, len(data))[covered].byteswap(), return_inverse=True)
    pointer[covered] = inverse
    depth = 8
    while depth < length:
        ahead = min(depth, length - depth)
        later = np.minimum(covered + ahead, len(data))
        _, inverse = np.unique(pointer[covered] * (len(covered) + 1) + pointer[later], return_inverse=True)
        pointer[covered] = inverse
        depth += ahead
    return pointer[starts]


def pack(docs: DataFrame) -> DataFrame:
    """Documents packed into chunks: chunk, ids, sizes and bytes. A document is never cut; null ids become the last id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            name = int.from_bytes(uuid.uuid4().bytes[:8], "little", signed=True)
            columns = [pa.array([name]), pa.array([ids], pa.list_(pa.int64())), pa.array([list(map(len, texts))], pa.list_(pa.int64())), pa.array([b"".join(texts)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "sizes", "data"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids.append(_LAST if not doc.is_valid else doc.as_py())
                texts.append(text.as_py().encode() if text.is_valid else b"")
                size += len(texts[-1])
                if size >= _CHUNK:
                    yield out()
                    ids, texts, size = [], [], 0
        if ids:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "chunk long, ids array<long>, sizes array<long>, data binary")


class Chunk:
    """A chunk's anchors; the same each time they are worked out."""

    def __init__(self, ids, sizes, data: bytes, length: int, gram: int):
        self.ids, self.sizes, self.data = np.asarray(ids, np.int64), np.asarray(sizes, np.int64), data
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        found = [anchors(data[a:b], length, gram) for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]
        self.doc = np.repeat(np.arange(len(found)), [len(p) for p, _ in found])
        self.place = (np.concatenate([p for p, _ in found]) if found else np.empty(0, np.int64)) + self.starts[self.doc]
        self.hash = (np.concatenate([h for _, h in found]) if found else np.empty(0, np.uint64)) >> np.uint64(16)
        self.keys, self.key = np.unique(self.hash, return_inverse=True)
        # Ids of the key's documents: does more than one document of this chunk have it?
        doc_id = self.ids[self.doc]
        low, high = np.full(len(self.keys), _LAST), np.full(len(self.keys), -_LAST - 1)
        np.minimum.at(low, self.key, doc_id)
        np.maximum.at(high, self.key, doc_id)
        self.low, self.shared = low, low != high

    def contexts(self, rows: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, left, size) of the bytes that windows around these anchors can cover."""
        doc, at = self.doc[rows], self.place[rows]
        side = length - gram
        start, stop = np.maximum(self.starts[doc], at - side), np.minimum(self.ends[doc], at + gram + side)
        return start, at - start, stop - start


def _chunks(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[tuple[dict, Chunk]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pydict()
            yield {x: v[0] for x, v in row.items()}, Chunk(row["ids"][0], row["sizes"][0], row["data"][0], length, gram)


def _cut(parts: np.ndarray, n: int) -> list[np.ndarray]:
    """Indices of each part's rows; a stable order, so that answers can be put back."""
    order = np.argsort(parts, kind="stable")
    return np.split(order, np.searchsorted(parts[order], np.arange(1, n)))


def _route(keys: np.ndarray, n: int) -> list[np.ndarray]:
    """Which keys go to each part."""
    h = (keys ^ (keys >> np.uint64(32))) * _M1
    return _cut((h >> np.uint64(20)) % np.uint64(n), n)


def _put_back(parts, answers, routes: list[list[np.ndarray]], kind: str) -> list[np.ndarray]:
    """What the parts have said of the keys that a chunk had sent by these routes, a list after the other."""
    out = [np.zeros(sum(map(len, r)), kind) for r in routes]
    for part, data in zip(parts or (), answers or (), strict=True):
        said, at = np.frombuffer(data, kind), 0
        for values, route in zip(out, routes, strict=True):
            n = len(route[part])
            values[route[part]] = said[at : at + n]
            at += n
    return out


def _same(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct combination of values, in the combinations' order, and each row's combination."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[order][1:] != x[order][:-1]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def _blob(*arrays: np.ndarray) -> bytes:
    return b"".join(x.tobytes() for x in arrays)


def _unpack(messages, kinds: str) -> tuple[list[np.ndarray], list[list[int]]]:
    """Columns of messages that hold, for each list, its number of rows and its columns; and these numbers by message."""
    lists = kinds.split()
    columns: list[list[list[np.ndarray]]] = [[[] for _ in x.split(",")] for x in lists]
    counts = []
    for x in messages:
        n, at = np.frombuffer(x, "<i8", len(lists)).tolist(), 8 * len(lists)
        counts.append(n)
        for k, kind in enumerate(lists):
            for j, one in enumerate(kind.split(",")):
                columns[k][j].append(np.frombuffer(x, one, n[k], at))
                at += n[k] * np.dtype(one).itemsize
    return [np.concatenate(c) for k in columns for c in k], counts


def _kept(docs: DataFrame, length: int, gram: int, parts: int | None, part_bytes: int) -> tuple[DataFrame, str]:
    """(doc_id, n_bytes, spans, kept) of every document, and the name of the table that it is worked out from."""
    if not 8 < gram <= length:
        raise ValueError("gram must be over 8 and at most length")
    spark = docs.sparkSession
    whole = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    n_parts = parts or max(16, -(-whole // part_bytes))
    table = f"kgloom_chunks_{uuid.uuid4().hex}"
    pack(docs).write.bucketBy(n_parts, "chunk").option("compression", "zstd").saveAsTable(table)
    packed = spark.table(table)
    message = "chunk long, part int, data binary"
    side = length - gram
    half = -(-side // 2)

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["chunk", "part", "data"])

    def asked(frame: DataFrame, work) -> DataFrame:
        return frame.mapInArrow(work, message).repartition(n_parts, "part").groupBy("part")

    def answered(group: pd.DataFrame, said: np.ndarray, counts: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"chunk": group["chunk"].to_numpy(), "part": group["part"].to_numpy(), "data": [x.tobytes() for x in np.split(said, np.cumsum(counts)[:-1])]})

    def by_chunk(frame: DataFrame, n: int) -> DataFrame:
        lists = frame.groupBy("chunk").agg(F.collect_list(F.struct("part", "data")).alias("x"))
        return written(lists.select("chunk", F.col("x.part").alias(f"parts{n}"), F.col("x.data").alias(f"answers{n}")), "answers")

    # 1. Which anchors does another document have?
    def first(batches):
        for row, c in _chunks(batches, length, gram):
            yield sent([(row["chunk"], p, _blob(np.array([len(at)]), c.keys[at], c.shared[at].view(np.uint8), c.low[at])) for p, at in enumerate(_route(c.keys, n_parts)) if len(at)])

    def recur(group: pd.DataFrame) -> pd.DataFrame:
        (keys, shared, low), counts = _unpack(group["data"], "<u8,u1,<i8")
        _, inverse = np.unique(keys, return_inverse=True)
        n = int(inverse.max(initial=-1)) + 1
        least, most, any_shared = np.full(n, _LAST), np.full(n, -_LAST - 1), np.zeros(n, np.uint8)
        np.minimum.at(least, inverse, low)
        np.maximum.at(most, inverse, low)
        np.maximum.at(any_shared, inverse, shared)
        hit = ((least != most) | (any_shared > 0))[inverse].astype(np.uint8)
        return answered(group, hit, [n for (n,) in counts])

    columns = ["chunk", "ids", "sizes", "data"]
    joined = packed.select(*columns)
    hits = by_chunk(asked(joined, first).applyInPandas(recur, message), 1)

    # 2. Which contexts does an earlier document have, which halves another context?
    class Contexts:
        """A chunk's distinct contexts of anchors that recur: anchor, hashes, smallest document, a row that has it there, each row's context."""

        def __init__(self, row: dict, c: Chunk):
            (hit,) = _put_back(row["parts1"], row["answers1"], [_route(c.keys, n_parts)], "u1")
            self.chunk, self.rows = c, np.flatnonzero(hit[c.key])
            start, left, size = c.contexts(self.rows, length, gram)
            data = c.data + bytes(16 + half + gram)
            one = hash_spans(data, start, size) + left.astype(np.uint64) * _M1
            two = hash_spans(data, start, size, _mix2) ^ left.astype(np.uint64)
            some, self.of = _same(c.hash[self.rows], one, two)
            doc = c.ids[c.doc[self.rows]]
            order = np.lexsort((doc, self.of))
            lead = order[np.searchsorted(self.of[order], np.arange(len(some)))]
            self.doc, self.lead = doc[lead], self.rows[lead]
            anchor = c.hash[self.lead]
            self.name, self.check = _mix(anchor * _M1, one[lead]), two[lead]
            at, own = c.place[self.lead], c.doc[self.lead]
            width = np.full(len(at), gram + half)
            # Halves that the document's ends cut off hold no window.
            self.sides = []
            for start_, whole_ in ((np.maximum(at - half, 0), at - c.starts[own] >= half), (at, c.ends[own] - at >= gram + half)):
                tail = hash_spans(data, start_, width) & np.uint64(0xFFFFFFFF)
                rows = np.flatnonzero(whole_)
                self.sides.append((rows, _mix(_mix(anchor * _M2, tail), np.full(len(at), len(self.sides) + 1, np.uint64))[rows]))
            self.routes = [_route(self.name, n_parts), *[_route(keys, n_parts) for _, keys in self.sides]]

        def hear(self, row: dict) -> None:
            """What the parts said: `earlier`, and the rows of each side that another context has the half of."""
            earlier, *others = _put_back(row["parts2"], row["answers2"], self.routes, "u1")
            self.earlier = earlier > 0
            self.open = [(rows[(said > 0) & ~self.earlier[rows]], keys[(said > 0) & ~self.earlier[rows]]) for (rows, keys), said in zip(self.sides, others, strict=True)]
            self.open_routes = [_route(keys, n_parts) for _, keys in self.open]

    def second(batches):
        for row, c in _chunks(batches, length, gram):
            x = Contexts(row, c)
            out = []
            for p, (at, *ends) in enumerate(zip(*x.routes, strict=True)):
                if len(at) or any(map(len, ends)):
                    halves = [y for e, (rows, keys) in zip(ends, x.sides, strict=True) for y in (keys[e], x.check[rows[e]])]
                    out.append((row["chunk"], p, _blob(np.array([len(at), *map(len, ends)]), x.name[at], x.check[at], x.doc[at], *halves)))
            if out:
                yield sent(out)

    def earliest(group: pd.DataFrame) -> pd.DataFrame:
        (name, check, doc, *halves), counts = _unpack(group["data"], "<u8,<u8,<i8 <u8,<u8 <u8,<u8")
        lead, of = _same(name, check)
        low = np.full(len(lead), _LAST)
        np.minimum.at(low, of, doc)
        said = [low[of] < doc]
        for keys, contexts in zip(halves[::2], halves[1::2], strict=True):
            some, _ = _same(keys, contexts)
            key, times = np.unique(keys[some], return_counts=True)
            said.append(times[np.searchsorted(key, keys)] > 1)
        # Back into the messages' order: each has a part of every list.
        numbers = np.array(counts)
        ends = np.cumsum(numbers, axis=0)
        flat = [np.concatenate([x[e - n : e] for x, e, n in zip(said, end, row, strict=True)]) for end, row in zip(ends.tolist(), counts, strict=True)]
        return answered(group, np.concatenate(flat).astype(np.uint8), numbers.sum(axis=1).tolist())

    joined = joined.join(hits, "chunk", "left")
    states = by_chunk(asked(joined, second).applyInPandas(earliest, message), 2)

    def known(row: dict, c: Chunk) -> Contexts:
        x = Contexts(row, c)
        x.hear(row)
        return x

    # 3. Contexts that are the first of their kind and share a half, as bytes, refined together with those that share it.
    def third(batches):
        for row, c in _chunks(batches, length, gram):
            x, out = known(row, c), []
            for p, ends in enumerate(zip(*x.open_routes, strict=True)):
                heads, texts = [], []
                for k, (e, (rows, _)) in enumerate(zip(ends, x.open, strict=True)):
                    start, left, size = c.contexts(x.lead[rows[e]], length, gram)
                    # Of each side only what windows that hold its half can cover.
                    cut = np.maximum(left - (side - half), 0) if k else np.zeros(len(e), np.int64)
                    start, left = start + cut, left - cut
                    size = size - cut if k else np.minimum(size, left + gram + side - half)
                    heads.append((x.doc[rows[e]], left, size))
                    texts += [c.data[s : s + n] for s, n in zip(start.tolist(), size.tolist(), strict=True)]
                if texts:
                    out.append((row["chunk"], p, _blob(np.array([len(texts)]), *map(np.concatenate, zip(*heads, strict=True))) + b"".join(texts)))
            if out:
                yield sent(out)

    def windows(group: pd.DataFrame) -> pd.DataFrame:
        """For each context a 64-bit mask: which windows, by their bytes left of the anchor, start in an earlier document."""
        (doc, left, size), counts = _unpack(group["data"], "<i8,<i8,<i8")
        data = b"".join(bytes(x[8 + 24 * n :]) for x, (n,) in zip(group["data"], counts, strict=True)) + bytes(length)
        base = np.cumsum(size) - size
        count = np.maximum(size - length + 1, 0)  # the windows of each context, all around the anchor
        of = np.repeat(np.arange(len(doc)), count)
        starts = base[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        mask = np.zeros(len(doc), np.uint64)
        if len(starts):
            bucket = refine(data, starts, length)
            shift = base[of] + left[of] - starts
            low = np.full(int(bucket.max()) + 1, _LAST)
            np.minimum.at(low, bucket, doc[of])
            again = low[bucket] < doc[of]
            np.bitwise_or.at(mask, of[again], np.uint64(1) << shift[again].astype(np.uint64))
        return answered(group, mask, [n for (n,) in counts])

    joined = joined.join(states, "chunk", "left")
    masks = by_chunk(asked(joined, third).applyInPandas(windows, message), 3)

    # 4. Windows become spans.
    def last(batches):
        for row, c in _chunks(batches, length, gram):
            x = known(row, c)
            start, left, size = c.contexts(x.rows, length, gram)
            edge = np.zeros(len(c.data) + 1, np.int32)
            # The whole context, where an earlier document has it: known of the chunk's first such document, so later ones have it too.
            mine = c.ids[c.doc[x.rows]]
            all_ = (x.earlier[x.of] | (mine > x.doc[x.of])) & (size >= length)
            np.add.at(edge, start[all_], 1)
            np.add.at(edge, start[all_] + size[all_], -1)
            mask = np.zeros(len(x.doc), np.uint64)
            # A part's answers stand for the left halves' contexts, then for the right ones'.
            for (rows, _), got in zip(x.open, _put_back(row["parts3"], row["answers3"], x.open_routes, "<u8"), strict=True):
                np.bitwise_or.at(mask, rows, got)
            some = np.flatnonzero(~all_ & (mask[x.of] != 0) & (mine == x.doc[x.of]))
            for shift in range(side + 1):
                on = some[(mask[x.of[some]] >> np.uint64(shift)) & np.uint64(1) > 0]
                begin = start[on] + left[on] - shift
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans, kept = [], []
            for s, e in zip(c.starts.tolist(), c.ends.tolist(), strict=True):
                own = gone[s:e]
                turns = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                spans.append(turns.reshape(-1, 2).tolist())
                kept.append(np.frombuffer(c.data, np.uint8)[s:e][~own].tobytes() if len(turns) else c.data[s:e])
            ids = [None if x_ == _LAST else x_ for x_ in c.ids.tolist()]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())
            found = [pa.array(y, k) for y, k in zip((ids, c.sizes.tolist(), spans, kept), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(found, names=["doc_id", "n_bytes", "spans", "kept"])

    joined = joined.join(masks, "chunk", "left")
    return joined.mapInArrow(last, "doc_id long, n_bytes long, spans array<array<long>>, kept binary"), table


def _settled(docs: DataFrame, columns, length: int, gram: int, parts: int | None, part_bytes: int) -> DataFrame:
    """The result's columns, written; the chunk table goes."""
    found, table = _kept(docs, length, gram, parts, part_bytes)
    try:
        return written(found.select(*columns), "suffix-result")
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, parts: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): each document's removed [start, stop) byte spans and the bytes that stay."""
    return _settled(docs, ["doc_id", "n_bytes", "spans", "kept"], length, gram, parts, part_bytes)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.col("n_bytes") - F.octet_length("kept")
    digests = ["doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]
    return _settled(documents(spark, sf_dir), digests, LENGTH, GRAM, None, PART_BYTES)


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
SQL: dict[str, str] = {}
