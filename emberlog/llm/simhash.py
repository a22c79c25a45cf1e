"""Near-duplicate documents by SimHash: a grid on per-segment bit counts finds the candidates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.storage import stage
from emberlog.llm.names import unused
from emberlog.llm.tokens import texts_of
from emberlog.operators.components import connected_components

SEED = 42
#: Fingerprints of a grid cell that one task compares at once; larger cells are compared in pairs of blocks.
CELL_ROWS = 32_768
#: Cells up to this size are compared all together, row i against i + 1, i + 2 and so on.
SMALL_CELL = 8
_LOW_BITS = 0x5555555555555555


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included.

    A-Z are lower-cased, words are split at ASCII white space; fewer words than a shingle has make one shingle of all
    of them, and no words give none.
    """
    found = text.encode().lower().split()
    if not found:
        return np.array([], np.uint64)
    joined = b" ".join(found)
    begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(begins, begins[min(words, len(found)) :])], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit ``b`` is set if it is in over half of the values; 0 without any."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def simhash(text: str, words: int = 3) -> int:
    """Fingerprint of a text: that of its :func:`shingle_hashes`."""
    return fingerprint_of(shingle_hashes(text, words))


def with_fingerprints(docs: DataFrame, words: int = 3, name: str = "fingerprint") -> DataFrame:
    """All columns of ``docs`` and the SimHash of ``text`` (null: empty) as a signed 64-bit column.

    A column of ``docs`` that is named ``name`` is replaced. Rows that repeat have equal fingerprints; no rows give none.
    """
    docs = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() != name.lower()))
    names, at = [*docs.columns, name], docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([simhash(x, words) for x in texts_of(batch.column(at))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], names)

    return docs.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + f", `{name}` long")


def segment_counts(fp: Column) -> Column:
    """The embedding: for each of 32 two-bit segments, its number of set bits in unary (00, 01, 11).

    The Manhattan distance of two points is the number of bits in which their codes differ, and never more than the
    Hamming distance of their fingerprints.
    """
    up = F.shiftrightunsigned(fp, 1)
    low = F.lit(_LOW_BITS)
    return fp.bitwiseOR(up).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(up).bitwiseAND(low), 1))


def grid_masks(radius: int) -> list[int]:
    """Masks of the grids: the 32 segments in ``2 * radius`` groups, each grid keeping half of the groups.

    Points at a Manhattan distance of ``radius`` or less differ in at most ``radius`` groups, so they are equal in all
    groups of one grid at least, and lie in one of its cells.
    """
    groups = [sum(3 << 2 * s for s in part.tolist()) for part in np.array_split(np.arange(32), 2 * radius)]
    return [sum(kept) for kept in combinations(groups, radius)]


def _link(e: np.ndarray, fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is within ``radius`` in one cell: a spanning forest, found breadth first."""
    links, left = [], np.arange(len(fp))
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(e[left] ^ e[x]) <= radius
            near[near] = np.bitwise_count(fp[left[near]] ^ fp[x]) <= radius
            hits = left[near]
            links += [(x, y) for y in hits]
            front.extend(hits)
            left = left[~near]
    return links


def _compare(radius: int):
    def edges_of(cells: np.ndarray, e: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``cells`` numbers the runs of equal keys, in order."""
        sizes = np.bincount(cells)
        small = sizes[cells] <= SMALL_CELL
        a, b = [], []
        for d in range(1, SMALL_CELL):
            i = np.flatnonzero(small[:-d] & (cells[:-d] == cells[d:])) if len(cells) > d else np.array([], np.int64)
            i = i[np.bitwise_count(e[i] ^ e[i + d]) <= radius]
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
            a.append(fp[i])
            b.append(fp[i + d])
        begins = np.concatenate([[0], np.cumsum(sizes)])
        for cell in np.flatnonzero(sizes > SMALL_CELL):
            own = slice(begins[cell], begins[cell + 1])
            if links := np.array(_link(e[own], fp[own], radius)).reshape(-1, 2).astype(np.int64).T.tolist():
                a.append(fp[own][links[0]])
                b.append(fp[own][links[1]])
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done(rows: np.ndarray) -> pa.RecordBatch:
            keys = rows[:4]
            new = np.concatenate([[0], np.any(keys[:, 1:] != keys[:, :-1], axis=0).astype(np.int64)])
            a, b = edges_of(np.cumsum(new), rows[4].view(np.uint64), rows[5].view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            if np.array_equal(held[0][:4, 0], held[-1][:4, -1]):
                continue  # one cell so far
            rows = np.concatenate(held, axis=1)
            last = np.flatnonzero(np.any(rows[:4] != rows[:4, -1:], axis=0))[-1] + 1
            held = [rows[:, last:]]
            yield done(rows[:, :last])
        if held:
            yield done(np.concatenate(held, axis=1))

    return run


def fingerprint_links(prints: DataFrame, radius: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``src, dst`` between distinct fingerprints (column ``fp``) so that the components are those of all links.

    Links are pairs at a Hamming distance of ``radius`` or less. Each fingerprint goes to one cell of each grid; a cell
    gives a spanning forest of its links and not all pairs. A cell of over ``cell_rows`` is split into blocks by hash,
    and each pair of blocks is compared in a task of its own.
    """
    points = prints.select("fp", segment_counts(F.col("fp")).alias("e"))
    masks = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in grid_masks(radius)))
    cells = points.select("fp", "e", F.posexplode(masks).alias("grid", "mask")).select("grid", F.col("e").bitwiseAND(F.col("mask")).alias("cell"), "e", "fp")
    large = stage(cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > cell_rows), "large-cells")
    rows = cells.select("grid", "cell", F.lit(0).alias("i"), F.lit(0).alias("j"), "e", "fp")
    if not large.isEmpty():
        blocks = F.ceil(F.col("n") / cell_rows).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        split = cells.join(large.withColumn("blocks", blocks), ["grid", "cell"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        split = split.select("grid", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "e", "fp")
        rows = rows.join(large, ["grid", "cell"], "left_anti").select(split.columns).union(split)
    key = ["grid", "cell", "i", "j"]
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(_compare(radius), "src long, dst long")


def _components(rows: DataFrame, radius: int) -> DataFrame:
    """``fp, component, component_id`` for each fingerprint of ``rows(doc_id, fp)``.

    ``component`` is a fingerprint that stands for it, ``component_id`` the smallest ``doc_id`` in it.
    """
    prints = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprints")
    linked = connected_components(fingerprint_links(prints, radius)).withColumnRenamed("node", "fp")
    named = prints.join(linked, "fp")
    ids = named.groupBy("component").agg(F.min("low").alias("id"))
    return prints.join(named.join(ids, "component").select("fp", "component", "id"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.coalesce("id", "low").alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text)``.

    Documents whose fingerprints differ in ``radius`` bits or fewer are linked; a component's id is the smallest
    ``doc_id`` in it (null if all are null). Equal texts share a fingerprint and are compared once. Null and empty texts
    have fingerprint 0. Rows that repeat stay; other columns are left out.
    """
    rows = stage(with_fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), words, "fp").select("doc_id", "fp"), "simhash")
    return rows.join(_components(rows, radius), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component of :func:`near_duplicates`, all columns as they were: that with the smallest ``doc_id``.

    Of rows that share it the first read stays; rows without a ``doc_id`` stay only if none of their component has one.
    Columns may have any names; no rows give none.
    """
    at, fp = unused(docs.columns, "row", "fp")
    rows = stage(with_fingerprints(docs.withColumn(at, F.monotonically_increasing_id()), words, fp), "simhash")
    narrow = stage(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp"), F.col(at).alias("row")), "simhash-ids")
    parts = narrow.join(_components(narrow.select("doc_id", "fp"), radius), "fp")
    first = parts.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("row").alias(at))
    return rows.join(first.select(at), at, "left_semi").select(*(f"`{c}`" for c in docs.columns))
