"""SimHash near-dedup by a grid range join over segment bit counts.

A text's fingerprint is the bitwise majority of the 64-bit hashes of its word shingles. A fingerprint is embedded as
the bit counts of its 32 two-bit segments: the Manhattan distance of two embeddings is at most the Hamming distance of
the fingerprints, so it bounds it from below. The grid: the 32 axes are cut into slabs; two embeddings within distance
d differ in at most d slabs, so they share the cell that is spanned by some `slabs - d` slabs. Fingerprints meet in the
cells of all such slab choices, are kept apart if the Manhattan distance exceeds d, and the rest is verified by the
exact Hamming distance.

With more fingerprints the axes are cut into more slabs, so that cells are spanned by more of them and unlike pairs that
meet grow no faster than the rows; any number of slabs finds exactly the same links.

Equal fingerprints are one node. Cells are cut into blocks of bounded size by a hash when they are crowded, and every
pair of blocks is a task's work of its own; from a block pair only a spanning forest of its links is emitted, never all
pairs. Only crowded cells are joined back, as a table that is written first. Components are then found by distributed
star rounds. Fingerprints and components that a two-thousandth of all rows have are broadcast to them.

Defined results: a null or blank text has fingerprint zero and links like any other; a text of fewer words than the
shingle's width is one shingle; rows of equal or null doc_ids link by their fingerprints like any others; a component is
named by its smallest doc_id that isn't null, and component_id is null where all its rows have null ids; an empty table
gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import documents, eased, join_hot, written
from kgloom.llm.components import components

SEED = 42
_EVEN = 0x5555555555555555
_PIECE = 1 << 16


def fingerprint(data: bytes, width: int = 3, seed: int = SEED) -> int:
    """The 64-bit SimHash of a whole text, unsigned."""
    words = data.lower().split()  # of bytes: A-Z and the six ASCII white-space characters only
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n <= width:
        return digest(joined, seed)
    size = np.fromiter(map(len, words), np.int64, n)
    stop = np.cumsum(size + 1) - 1
    starts, stops = (stop - size)[: n - width + 1].tolist(), stop[width - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, len(starts), _PIECE):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[k : k + _PIECE], stops[k : k + _PIECE], strict=True)], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in eased(batches):
            texts = batch.column("text").cast(pa.binary())
            fps = np.fromiter((fingerprint(x.as_py() or b"", width, seed) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """The bit counts of the 32 two-bit segments, each written as 0, 1 or 11: the Manhattan distance is then a popcount."""
    low, high = fp & np.uint64(_EVEN), (fp >> np.uint64(1)) & np.uint64(_EVEN)
    return (low | high) | ((low & high) << np.uint64(1))


def _embedded(column: str):
    low, high = F.col(column).bitwiseAND(F.lit(_EVEN)), F.shiftrightunsigned(column, 1).bitwiseAND(F.lit(_EVEN))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def cell_masks(distance: int, slabs: int) -> list[int]:
    """Bit masks of the slab choices that two embeddings within the distance can't all miss."""
    edges = [round(32 * k / slabs) for k in range(slabs + 1)]
    one = [((1 << 2 * b) - 1) ^ ((1 << 2 * a) - 1) for a, b in itertools.pairwise(edges)]
    return [sum(x) for x in itertools.combinations(one, slabs - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fp: np.ndarray, node: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs within the distance."""
    seg, left, edges = embed(fp), np.arange(len(fp)), []
    while len(left):
        reach, left = [int(left[0])], left[1:]
        while reach and len(left):
            at = reach.pop()
            near = left[np.bitwise_count(seg[left] ^ seg[at]) <= distance]  # the lower bound
            near = near[np.bitwise_count(fp[near] ^ fp[at]) <= distance]
            if len(near):
                edges += [(int(node[at]), int(node[k])) for k in near]
                reach += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)
    return edges


def bridges(forest, fp: np.ndarray, node: np.ndarray, mine: np.ndarray) -> list[tuple[int, int]]:
    """A forest's links; of rows from two blocks only those that join what the blocks' own forests, which their own tasks give, leave apart. So a group that fills many blocks gives about a link a row, not one a pair of blocks."""
    two = mine != mine[0]
    if not two.any():
        return forest(fp, node)
    root = list(range(len(fp)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for rows in (np.flatnonzero(two), np.flatnonzero(~two)):
        for a, b in forest(fp[rows], rows):
            root[find(a)] = find(b)
    out = []
    for a, b in forest(fp, np.arange(len(fp))):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.append((int(node[a]), int(node[b])))
    return out


def _linker(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; a cell may go on in the next batch."""
        held = None
        for batch in itertools.chain(batches, [None]):
            rows = None
            if batch is not None:
                rows = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)])
            if held is not None and rows is not None:
                rows = np.concatenate([held, rows])
            elif rows is None:
                rows = held
            if rows is None or not len(rows):
                continue
            new = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            start = np.concatenate([[0], new])
            stop = np.concatenate([new, [len(rows)]])
            if batch is not None:
                held, start, stop = rows[start[-1] :], start[:-1], stop[:-1]
            fp, node, mine = np.ascontiguousarray(rows[:, 3]).view(np.uint64), rows[:, 4], rows[:, 5]
            two = start[stop - start == 2]
            near = two[np.bitwise_count(embed(fp[two]) ^ embed(fp[two + 1])) <= distance]
            near = near[np.bitwise_count(fp[near] ^ fp[near + 1]) <= distance]
            edges = list(zip(node[near].tolist(), node[near + 1].tolist(), strict=True))
            for a, b in zip(start.tolist(), stop.tolist(), strict=True):
                if b - a > 2:
                    edges += bridges(lambda x, y: _forest(x, y, distance), fp[a:b], node[a:b], mine[a:b])
            found = np.array(edges, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

    return run


def slabs_for(rows: int, distance: int) -> int:
    """How many slabs keep cells at about 64 unlike embeddings each; an axis of a cell tells about 2.6 values apart. At least two for each differing bit."""
    slabs = 2 * distance
    while slabs < 32 and rows > 64 * 2.6 ** (32 * (slabs - distance) / slabs):
        slabs += 1
    return slabs


def met(cells: DataFrame, by: list[str], names: list[str], block: int) -> DataFrame:
    """(by, pair, mine, names) rows, dealt by cell and pair of blocks and sorted so; `node` is one of the names, `mine` the row's block. Only cells with
    more rows than a block, at most one in `block` of all rows, are joined back; that table is written first, so that the
    planner sees its size before it broadcasts it or not."""
    crowd = written(cells.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > block), "crowds")
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(block)).cast("long")
    mine = F.pmod(F.xxhash64("node"), blocks)
    # A block meets itself and each other block once, whichever side it comes from.
    meets = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.least(mine, j) * blocks + F.greatest(mine, j))
    found = cells.join(crowd, by, "left").select(*by, F.explode(meets).alias("pair"), mine.alias("mine"), *names)
    # Sorted by node too: a group that fills many cells has one star, whose links are the same in all of them.
    return found.repartition(*by, "pair").sortWithinPartitions(*by, "pair", "node")


def links(nodes: DataFrame, distance: int = 3, slabs: int | None = None, block: int = 4096) -> DataFrame:
    """Distinct (fp, node) rows to (u, v) links that join all nodes within the distance; redundant links are left out."""
    masks = cell_masks(distance, slabs or slabs_for(nodes.count(), distance))
    cells = nodes.withColumn("seg", _embedded("fp"))
    choice = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("grid"), F.col("seg").bitwiseAND(F.lit(_signed(m))).alias("cell")) for k, m in enumerate(masks)]))
    cells = cells.select(choice.alias("c"), "fp", "node").select("c.grid", "c.cell", "fp", "node")
    rows = met(cells, ["grid", "cell"], ["fp", "node"], block)
    return rows.select("grid", "cell", "pair", "fp", "node", "mine").mapInArrow(_linker(distance), "u long, v long").distinct()


def near_groups(docs: DataFrame, width: int = 3, distance: int = 3, seed: int = SEED) -> DataFrame:
    """Every row's (doc_id, fp, component_id)."""
    found = written(fingerprints(docs, width, seed), "fingerprints")
    # The fingerprint itself is the node, so that rows without an id link too.
    nodes = written(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "nodes")
    joined = components(links(nodes.select("fp", F.col("fp").alias("node")), distance))
    of = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", F.coalesce("component", "fp").alias("component"), "least", "rows")
    of = written(of, "node-components")
    names = written(of.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes")), "component-names")
    named = join_hot(of, names, ["component"], "nodes", "name").select("fp", "rows", "name.component_id")
    return join_hot(found, written(named, "node-names"), ["fp"], "rows", "name").select("doc_id", "fp", "name.component_id")


def keep_first(docs: DataFrame, width: int = 5, distance: int = 3) -> DataFrame:
    """One row of each group: of those with its smallest doc_id (nulls last) the first as the table is read."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("whole")), "simhash-rows")
    # Rows stand for documents here; what groups them is the fingerprint.
    groups = near_groups(rows.select(F.col("row").alias("doc_id"), "whole.text"), width, distance)
    order = rows.select("row", F.col("whole.doc_id").cast("long").alias("id"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")
    stay = groups.select(F.col("doc_id").alias("row"), "component_id").join(order, "row").groupBy("component_id").agg(first).select("first.row")
    return rows.join(stay, "row", "left_semi").select("whole.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
SQL: dict[str, str] = {}
