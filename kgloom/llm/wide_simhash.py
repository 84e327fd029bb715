"""SimHash near-dedup at a wide radius: what op1's grid does for 3 of 64 bits, for a given similarity of shingles.

Copies with a similarity of 0.8 differ in about 15 % of their fingerprints' bits: too far for slabs that may not miss
any, and too much noise in 64 bits. So fingerprints have `64 * words` bits, and the grid has segments of one bit, whose
counts are the bits themselves: a cell is spanned by `axes` segments of a seeded permutation of all of them, and
`rounds` permutations are cut into such cells. Two fingerprints that share any cell are held apart if their bit counts
by word are too far apart (Manhattan distance, the lower bound), then verified by the exact Hamming distance.

Fingerprints are of shingle sets, so that Jaccard similarity bounds the angle from above whatever the sets' sizes. The
radius holds 99.95 % of pairs at exactly 0.8, and with 13 axes and 76 cells 0.004 % of them share no cell by the same
model. Crowded cells are cut into blocks and every pair of blocks is compared. `grid_for` adds an axis to the cells for
each doubling of the rows, so that unlike pairs met grow no faster than they, and as many cells as keep the recall where
it was: the share of alike pairs that share no cell is `missed`, 1 in 10,000, at every size.

Fingerprints only propose. A spanning forest of the pairs within the radius joins whatever may belong together; its links
are verified by the exact Jaccard similarity of whole shingle sets. Where that takes a forest apart, the sets of all its
rows meet, in blocks of a bounded number of shingles, and a forest of all alike pairs is found among them; so no pair is
lost because a forest left it out, and no list of pairs is ever written. Sets of few
shingles have too coarse fingerprints: those of up to `few` meet by exact prefixes (two sets of similarity s share one
of the first n - ceil(s * n) + 1 of their sorted hashes) and are compared as sets there.

Defined results: as in simhash, but groups are the components of the pairs with a Jaccard similarity of at least
`similarity`; texts without words have the empty set, and are like each other only. Rows are told apart by their place in
a table that is written first, so rows with equal or null doc_ids are compared like any others.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import beside, chosen, eased, join_hot, written
from kgloom.llm.components import components
from kgloom.llm.simhash import bridges, met

SEED, WORDS, AXES, ROUNDS = 42, 4, 13, 4
FEW = 80
_PIECE = 1 << 14
_SMALL = 64


def radius(similarity: float, bits: int) -> int:
    """The differing bits that a pair of this Jaccard similarity stays within in 9,995 of 10,000 cases."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return round(bits * p + 3.29 * math.sqrt(bits * p * (1 - p)))


def _spread(h: np.ndarray, words: int) -> np.ndarray:
    """(n, words): a 64-bit hash made wider by a mixing step for each word."""
    out = np.empty((len(h), words), "<u8")
    for k in range(words):
        x = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def shingles(data: bytes, width: int = 5, seed: int = SEED) -> np.ndarray:
    """The sorted hashes of a whole text's distinct shingles."""
    parts = data.lower().split()
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, n)
    stop = np.cumsum(size + 1) - 1
    count = max(n - width + 1, 1)
    starts, stops = (stop - size)[:count].tolist(), stop[min(width, n) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, count))


def fingerprint_of(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The SimHash of a shingle set over `64 * words` bits."""
    ones = np.zeros(64 * words, np.int64)
    for k in range(0, len(hashes), _PIECE):
        bits = np.unpackbits(_spread(hashes[k : k + _PIECE], words).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")


def wide_fingerprint(data: bytes, width: int = 5, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The SimHash of a whole text's shingle set."""
    return fingerprint_of(shingles(data, width, seed), words)


def _lists(rows: list) -> pa.Array:
    return pa.array([None if x is None else x.view(np.int64) for x in rows], pa.list_(pa.int64()))


def wide_fingerprints(rows: DataFrame, width: int = 5, words: int = WORDS, few: int = FEW) -> DataFrame:
    """(row, doc_id, key, fp, few) of (row, doc_id, text) rows: the shingle set's SHA-256 and fingerprint, and the set itself if it has no more than `few` shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in eased(batches):
            sets = [shingles(x.as_py() or b"", width) for x in batch.column("text").cast(pa.binary())]
            keys = pa.array([hashlib.sha256(x.tobytes()).digest() for x in sets], pa.binary())
            small = [x if len(x) <= few else None for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), keys, _lists([fingerprint_of(x, words) for x in sets]), _lists(small)], names=["row", "doc_id", "key", "fp", "few"])

    texts = rows.select("row", "doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "row long, doc_id long, key binary, fp array<long>, few array<long>")


def shingle_sets(rows: DataFrame, of: DataFrame, width: int = 5) -> DataFrame:
    """(row, shingles) of those (row, text) rows that `of` has the numbers of. Texts stay where they are; the numbers come to them."""
    folder = beside(of, "wide-asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = chosen(folder)
        for batch in eased(batches):
            for k in np.flatnonzero(among(batch.column("row").to_numpy())).tolist():
                text = batch.column("text")[k].as_py() or ""
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(k, 1), _lists([shingles(text.encode(), width)])], names=["row", "shingles"])

    return rows.select("row", F.col("text").cast("string").alias("text")).mapInArrow(run, "row long, shingles array<long>")


def cell_masks(words: int = WORDS, axes: int = AXES, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """(cells, words): the bits that span each cell."""
    rng, bits = np.random.default_rng(seed), 64 * words
    picks = [order[k : k + axes] for order in (rng.permutation(bits) for _ in range(rounds)) for k in range(0, bits - axes + 1, axes)]
    flags = np.zeros((len(picks), bits), np.uint8)
    for row, pick in zip(flags, picks, strict=True):
        row[pick] = 1
    return np.packbits(flags, axis=1, bitorder="little").view("<u8")


def _near(fp: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Which of the pairs are near: the lower bound first, then the exact distance."""
    count = np.bitwise_count(fp).astype(np.int32)
    near = np.flatnonzero(np.abs(count[a] - count[b]).sum(axis=1) <= distance)
    exact = np.bitwise_count(fp[a[near]] ^ fp[b[near]]).sum(axis=1, dtype=np.int32) <= distance
    return near[exact]


def _forest(fp: np.ndarray, node: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs within the distance."""
    left, edges = np.arange(len(fp)), []
    while len(left):
        reach, left = [int(left[0])], left[1:]
        while reach and len(left):
            at = reach.pop()
            close = np.bitwise_count(fp[left] ^ fp[at]).sum(axis=1, dtype=np.int32) <= distance
            near, left = left[close], left[~close]
            edges += [(int(node[at]), int(node[k])) for k in near]
            reach += near.tolist()
    return edges


def _cells_links(start: np.ndarray, stop: np.ndarray, fp: np.ndarray, node: np.ndarray, mine: np.ndarray, distance: int) -> np.ndarray:
    edges: list[tuple[int, int]] = []
    size = stop - start
    if not len(start):
        return np.zeros((0, 2), np.int64)
    own = mine[: stop[-1]]
    large = (size > _SMALL) | (np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start))
    for s in range(2, _SMALL + 1):
        of = start[(size == s) & ~large]
        i, j = np.triu_indices(s, 1)
        step = max(1, (1 << 18) // len(i))
        for k in range(0, len(of), step):
            part = of[k : k + step]
            a, b = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
            near = _near(fp, a, b, distance)
            cell = near // len(i)
            once = np.bincount(cell, minlength=len(part)) == 1
            one = near[once[cell]]
            edges += zip(node[a[one]].tolist(), node[b[one]].tolist(), strict=True)
            for c in np.unique(cell[~once[cell]]).tolist():
                edges += _forest(fp[part[c] : part[c] + s], node[part[c] : part[c] + s], distance)
    for a, b in zip(start[large].tolist(), stop[large].tolist(), strict=True):
        edges += bridges(lambda x, y: _forest(x, y, distance), fp[a:b], node[a:b], mine[a:b])
    return np.array(edges, np.int64).reshape(-1, 2)


def _linker(distance: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell and pair of blocks; one may go on in the next batch."""
        held = None
        for batch in itertools.chain(batches, [None]):
            rows = held
            if batch is not None:
                rows = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4 + words)])
                rows = rows if held is None else np.concatenate([held, rows])
            if rows is None or not len(rows):
                continue
            edge = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            start, stop = np.concatenate([[0], edge]), np.concatenate([edge, [len(rows)]])
            if batch is not None:
                held, start, stop = rows[start[-1] :], start[:-1], stop[:-1]
            fp = np.ascontiguousarray(rows[:, 4:]).view(np.uint64)
            found = _cells_links(start, stop, fp, rows[:, 3], rows[:, 2], distance)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

    return run


def wide_links(nodes: DataFrame, distance: int, words: int = WORDS, axes: int = AXES, rounds: int = ROUNDS, block: int = 4096) -> DataFrame:
    """Distinct (fp, node) rows to (u, v) links that join all nodes found near; redundant links are left out. Fingerprints move once a cell."""
    masks = cell_masks(words, axes, rounds).view(np.int64)
    names = [f"f{k}" for k in range(words)]
    fps = [F.col("fp")[k].alias(f"f{k}") for k in range(words)]
    cells = nodes.select("node", *fps, F.explode(F.sequence(F.lit(1), F.lit(len(masks)))).alias("g"))
    of = [F.col(f"f{k}").bitwiseAND(F.element_at(F.lit(masks[:, k].tolist()), F.col("g"))) for k in range(words)]
    cells = cells.select(F.xxhash64("g", *of).alias("cell"), "node", *names)
    rows = met(cells, ["cell"], ["node", *names], block).select("cell", "pair", "mine", "node", *names)
    return rows.mapInArrow(_linker(distance, words), "u long, v long").distinct()


def _alike(common, a, b, similarity: float):
    """Whether the Jaccard similarity is reached, for sizes of the common part and of both sets."""
    return common * (1 + similarity) >= similarity * (a + b) - 1e-9


def _join_sets(sets: list[np.ndarray], rows: np.ndarray, part: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Joins the parts of alike sets among these rows, in `part`, and gives a link for each join."""
    size = np.array([len(sets[k]) for k in rows])
    owner, values = np.repeat(np.arange(len(rows)), size), np.concatenate([sets[k] for k in rows])
    order = np.argsort(values, kind="stable")
    owner, values = owner[order], values[order]
    edges = []
    for at, row in enumerate(rows.tolist()):
        other = part[rows] != part[row]
        if not other.any():
            break
        lo, hi = np.searchsorted(values, sets[row]), np.searchsorted(values, sets[row], "right")
        n = hi - lo
        places = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        common = np.bincount(owner[places], minlength=len(rows))
        for k in rows[other & (common > 0) & _alike(common, size, size[at], similarity)].tolist():
            if part[k] != part[row]:
                part[part == part[k]] = part[row]
                edges.append((row, k))
    return edges


def _set_forest(sets: list[np.ndarray], node: np.ndarray, label: np.ndarray, mine: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of a forest that joins all alike sets, beside what equal labels join already and, for rows from two blocks, what the blocks' own tasks give."""
    _, part = np.unique(label, return_inverse=True)
    two = mine != mine[0]
    for rows in (np.flatnonzero(two), np.flatnonzero(~two)) if two.any() else ():
        _join_sets(sets, rows, part, similarity)
    return [(int(node[a]), int(node[b])) for a, b in _join_sets(sets, np.arange(len(sets)), part, similarity)]


def _set_linker(similarity: float):
    """(cell, pair, mine, node, label, set) rows, sorted by cell and pair, to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((key, at, x) for batch in batches for *key, at, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), zip(*[batch.column(k).to_pylist() for k in (2, 3, 4)], strict=True), batch.column(5), strict=True))
        for _, group in itertools.groupby(rows, lambda r: r[0]):
            found = list(group)
            if len(found) > 1:
                mine, node, label = (np.array(x) for x in zip(*[r[1] for r in found], strict=True))
                edges = np.array(_set_forest([x.values.to_numpy() for *_, x in found], node, label, mine, similarity), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["u", "v"])

    return run


def few_links(nodes: DataFrame, similarity: float, block: int = 4096) -> DataFrame:
    """(few, node) rows to (u, v) links that join all alike sets; none is missed."""
    n = F.size("few")
    prefix = F.slice(F.array_sort("few"), F.lit(1), (n - F.ceil(n * F.lit(similarity) - F.lit(1e-9)) + 1).cast("int"))
    cells = nodes.where("few IS NOT NULL AND size(few) > 0").select(F.explode(prefix).alias("cell"), "node", "few")
    rows = met(cells, ["cell"], ["node", "few"], block).select("cell", "pair", "mine", "node", F.col("node").alias("label"), "few")
    return rows.mapInArrow(_set_linker(similarity), "u long, v long").distinct()


def apart_links(rest: DataFrame, rows: DataFrame, similarity: float, width: int = 5, block: int = 1 << 20) -> DataFrame:
    """(node, loose, label) rows to (u, v) links that join all alike sets of equal `loose`, beside what equal labels join. Pairs of blocks of about `block` shingles meet."""
    sets = shingle_sets(rows, rest.select(F.col("node").alias("row")), width)
    held = written(sets.join(rest, sets["row"] == rest["node"]).select("loose", "node", "label", "shingles"), "wide-apart-sets")
    sizes = written(held.groupBy("loose").agg(F.sum(F.size("shingles")).alias("n"), F.count("*").alias("rows")), "wide-apart-sizes")
    blocks = F.ceil(F.col("sizes.n") / F.lit(block)).cast("long")
    mine = F.pmod(F.xxhash64("node"), blocks)
    meets = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.least(mine, j) * blocks + F.greatest(mine, j))
    dealt = join_hot(held, sizes, ["loose"], "rows", "sizes").select(F.col("loose").alias("cell"), F.explode(meets).alias("pair"), mine.alias("mine"), "node", "label", "shingles")
    dealt = dealt.repartition("cell", "pair").sortWithinPartitions("cell", "pair", "node")
    return dealt.mapInArrow(_set_linker(similarity), "u long, v long").distinct()


def verified(links: DataFrame, rows: DataFrame, similarity: float, width: int = 5) -> DataFrame:
    """The links whose ends' whole shingle sets have this Jaccard similarity. Only texts that have a link are cut into shingles again. Ends are rows' numbers."""
    ends = links.select(F.col("u").alias("row")).unionByName(links.select(F.col("v").alias("row"))).distinct()
    sets = written(shingle_sets(rows, ends, width), "wide-sets")
    one, two = (sets.select(F.col("row").alias(c), F.col("shingles").alias(f"s{c}")) for c in "uv")
    common = F.size(F.array_intersect("su", "sv"))
    return links.join(one, "u").join(two, "v").where(_alike(common, F.size("su"), F.size("sv"), similarity)).select("u", "v").distinct()


def grid_for(rows: int, similarity: float, words: int = WORDS, missed: float = 0.0001) -> tuple[int, int]:
    """(axes, rounds): about 64 unlike rows a cell at any size, and so many cells that a pair of this similarity shares none in `missed` of all cases."""
    axes = min(max(AXES, math.ceil(math.log2(max(rows, 1))) - 6), 64 * words)
    same = (1 - math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi) ** axes
    cells = math.log(missed) / math.log1p(-same) if same < 1 else 1
    return axes, max(1, round(cells / (64 * words // axes)))


def _labelled(nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """The nodes with their component under a name."""
    return nodes.join(components(links), "node", "left").withColumn(name, F.coalesce("component", "node")).drop("component")


def alike_links(rows: DataFrame, nodes: DataFrame, similarity: float = 0.8, width: int = 5, words: int = WORDS, expect: int | None = None) -> DataFrame:
    """(fp, few, node) rows to verified links that join all nodes found alike; nodes are numbers of `rows`. `expect` takes the place of their count where the grid is chosen."""
    axes, rounds = grid_for(expect or nodes.count(), similarity, words)
    within = radius(similarity, 64 * words)
    forest = written(wide_links(nodes.select("fp", "node"), within, words, axes, rounds), "wide-forest")
    sure = written(verified(forest, rows, similarity, width).unionByName(few_links(nodes, similarity)), "wide-sure")
    # What the forest joined and the sets took apart again may hold alike pairs that the forest left out.
    both = _labelled(_labelled(nodes.select("node"), forest, "loose"), sure, "label")
    both = written(both, "wide-labels")
    apart = both.groupBy("loose").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n")).where("a < b")
    rest = written(join_hot(both, written(apart.select("loose", "n"), "wide-loose"), ["loose"], "n", "met").where("met IS NOT NULL").drop("met"), "wide-apart")
    return sure.unionByName(apart_links(rest, rows, similarity, width))


def _numbered(docs: DataFrame) -> DataFrame:
    return written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("whole")), "wide-rows")


def _groups(rows: DataFrame, similarity: float, width: int, words: int, expect: int | None) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, component) of every row, and (component, id, row, rows) of every component: its smallest doc_id, nulls last, the first row of it, and its number of rows."""
    texts = rows.select("row", F.col("whole.doc_id").cast("long").alias("doc_id"), F.col("whole.text").alias("text"))
    found = written(wide_fingerprints(texts, width, words), "wide-fingerprints")
    nodes = written(found.groupBy("key").agg(F.min("row").alias("node"), F.count("*").alias("rows"), F.first("fp").alias("fp"), F.first("few").alias("few")), "wide-nodes")
    joined = components(alike_links(texts, nodes.select("node", "fp", "few"), similarity, width, words, expect))
    of = written(nodes.join(joined, "node", "left").select("key", F.coalesce("component", "node").alias("component"), "rows"), "wide-components")
    each = written(join_hot(found.select("row", "doc_id", "key"), of, ["key"], "rows", "of").select("row", "doc_id", "of.component"), "wide-members")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    names = each.groupBy("component").agg(first, F.count("*").alias("rows")).select("component", F.col("first.doc_id").alias("id"), F.col("first.row").alias("row"), "rows")
    return each, written(names, "wide-names")


def similar_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5, words: int = WORDS, expect: int | None = None) -> DataFrame:
    """Every row's (doc_id, component_id)."""
    each, names = _groups(_numbered(docs), similarity, width, words, expect)
    return join_hot(each, names.select("component", F.col("id").alias("component_id"), "rows"), ["component"], "rows", "name").select("doc_id", "name.component_id")


def keep_first(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """One row of each group, with all its columns: of those with its smallest doc_id (nulls last) the first as the table is read."""
    rows = _numbered(docs)
    _, names = _groups(rows, similarity, width, WORDS, None)
    folder = beside(names.select("row"), "wide-kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = chosen(folder)
        for batch in eased(batches):
            yield batch.filter(pa.array(among(batch.column("row").to_numpy())))

    return rows.mapInArrow(run, rows.schema).select("whole.*")
