"""De-duplication by exact Jaccard similarity of five-word shingles. Who has to be compared is found by SimHash on grids of
segments' bit counts, the method of :mod:`emberlog.llm.simhash`, and by MinHash bands, as texts at 0.8 lie beyond its radius."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.storage import stage
from emberlog.llm.memory import give_back, small_batches
from emberlog.llm.names import unused
from emberlog.llm.prefilter import possible
from emberlog.llm.simhash import SEED, fingerprint_links, fingerprint_of, shingle_hashes
from emberlog.llm.tokens import texts_of
from emberlog.operators.components import connected_components

WORDS = 5
#: Two texts are near copies if they share at least so much of their shingles: numerator and denominator.
LEAST = (4, 5)
#: A pair at 0.8 exactly has none of 50 bands of 6 in common with a chance of (1 - 0.8^6)^50 = 2.5e-7; a closer one with less.
BANDS, BAND_ROWS = 50, 6
#: Values of which a sketch holds four bits each, and how many of them two sketches agree in at least if their texts may be
#: similar: at a similarity of 0.8 they agree in 104 with a deviation of 4.4, so fewer than 80 have a chance below 1e-7.
SKETCHED, ALIKE = 128, 80
#: Texts whose shingles a task holds at once.
PART_ROWS = 250
#: Texts of one band's group whose sketches one task compares at once; larger groups are compared in pairs of blocks.
CELL_ROWS = 2048
#: A group is compared in pairs of blocks: of so many texts (up to MANY_BLOCKS), and of so many shingles at most on average.
BLOCK_ROWS, MANY_BLOCKS, BLOCK_SHINGLES = 256, 16, 1_000_000
_FACTORS = np.random.default_rng(SEED).integers(1, 1 << 64, (2, BANDS * BAND_ROWS), np.uint64) | np.uint64(1)


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct XXH64 values of the shingles; words as in :func:`emberlog.llm.simhash.simhash`."""
    return np.unique(shingle_hashes(text, WORDS))


def bands_of(shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
    """One signed value per band, and a sketch.

    Two sets agree in a band with a chance of their Jaccard similarity to the power BAND_ROWS.
    """
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[i : i + 1024, None] * _FACTORS[0] + _FACTORS[1]).min(axis=0))
    rows = least.reshape(BANDS, BAND_ROWS)
    bits = (least[:SKETCHED] & np.uint64(15)).astype(np.uint8)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)], np.uint64).view(np.int64), (bits[::2] | bits[1::2] << 4).tobytes()


#: How many of a byte's two halves are zero.
_ZERO_HALVES = np.array([(x < 16) + (x % 16 == 0) for x in range(256)], np.uint8)


def _with_bands(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` and, under the five ``names``: a key (same for equal sets), the size of the set, its bands, its sketch and the
    text's fingerprint."""
    columns, at = [*docs.columns, *names], docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, PART_ROWS) for b in batches for i in range(0, b.num_rows, PART_ROWS)):
            hashes = [shingle_hashes(x, WORDS) for x in texts_of(batch.column(at))]
            prints, sets = pa.array(map(fingerprint_of, hashes), pa.int64()), [*map(np.unique, hashes)]
            keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            bands, sketches = zip(*map(bands_of, sets)) if sets else ((np.array([], np.int64),), ())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(np.concatenate(bands)))
            yield pa.RecordBatch.from_arrays([*batch.columns, keys, pa.array(list(map(len, sets)), pa.int32()), lists, pa.array(sketches, pa.binary()), prints], columns)
        give_back()

    return docs.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", " + ", ".join(f"`{n}` {t}" for n, t in zip(names, ("binary", "int", "array<bigint>", "binary", "long"))))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows that come sorted by their first ``keys`` columns, one group at a time: the other columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:keys]]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if batch.num_rows else ()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            own = batch.slice(a, b - a)
            if held and own.num_rows and any(held[0].column(k)[0] != own.column(k)[0] for k in range(keys)):
                yield pa.Table.from_batches(held).select(list(range(keys, batch.num_columns)))
                held = []
            held += [own] * (own.num_rows > 0)
    if held:
        yield pa.Table.from_batches(held).select(list(range(keys, held[0].num_columns)))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``src, dst`` for rows ``cell, i, j, node, sketch`` that come sorted: a spanning forest of sketches that agree."""
    out: list[tuple[int, int]] = []
    for group in _groups(batches, 3):
        nodes = group.column(0).to_numpy()
        sketches = np.frombuffer(b"".join(group.column(1).to_pylist()), np.uint8).reshape(len(nodes), -1)
        left = np.arange(len(nodes))
        while len(left):
            front, left = [left[0]], left[1:]
            while front and len(left):
                x = front.pop()
                near = _ZERO_HALVES[sketches[left] ^ sketches[x]].sum(axis=1) >= ALIKE
                out += [(nodes[x], y) for y in nodes[left[near]]]
                front.extend(left[near])
                left = left[~near]
        if len(out) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], ["src", "dst"])
            out = []
    yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], ["src", "dst"])
    give_back()


def similar(shared: np.ndarray, n: np.ndarray, m: int) -> np.ndarray:
    return LEAST[1] * shared >= LEAST[0] * (n + m - shared)


def _forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what is similar: a spanning forest, each text compared with all that it hasn't reached."""
    sizes = np.array(list(map(len, sets)))
    _, terms, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(terms, kind="stable")]
    ends = np.cumsum(often)
    begins, own = (ends - often).tolist(), np.concatenate([[0], np.cumsum(sizes)])
    ends, links, left = ends.tolist(), [], np.ones(len(sets), bool)
    for start in range(len(sets)):
        front = [start] if left[start] else []
        left[start] = False
        while front:
            x = front.pop()
            mine = terms[own[x] : own[x + 1]]
            mine = mine[often[mine] > 1].tolist()
            if not mine:
                continue
            shared = np.bincount(np.concatenate([owner[begins[t] : ends[t]] for t in mine]), minlength=len(sets))
            hits = np.flatnonzero(left & similar(shared, sizes, sizes[x])).tolist()
            left[hits] = False
            links += [(x, y) for y in hits]
            front += hits
    return links


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``src, dst`` for rows ``component, i, j, node, text`` that come sorted; one block pair is held at a time."""
    for group in _groups(batches, 3):
        nodes, sets = group.column(0).to_pylist(), [shingle_set(x) for x in texts_of(group.column(1))]
        links = _forest(sets) if len(sets) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([nodes[link[k]] for link in links], pa.int64()) for k in (0, 1)], ["src", "dst"])
    give_back()


def _blocks(n: Column, shingles: Column) -> Column:
    return F.greatest(F.least(F.ceil(n / BLOCK_ROWS), F.lit(MANY_BLOCKS)), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _in_blocks(rows: DataFrame, sizes: DataFrame, keys: list[str], blocks: Column) -> DataFrame:
    """``rows`` with ``i, j``: those of a group in ``sizes`` go to each pair of its blocks that holds their own, others to 0, 0."""
    split = rows.join(sizes.withColumn("blocks", blocks), keys).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own")))
    split = split.withColumn("other", F.explode(others))
    return split.select(*keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *(c for c in rows.columns if c not in keys))


def probable_links(nodes: DataFrame) -> DataFrame:
    """``src, dst`` of ``nodes(node, bands, sketch)`` that agree in a band and whose sketches agree in ALIKE values or more.

    Of each band's groups only a spanning forest comes out. Texts that share a passage, and by chance a band, so don't
    tie groups together that have no similar texts.
    """
    cells = nodes.select("node", F.explode("bands").alias("cell"))
    shared = stage(cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"), "near-copy-cells")
    # Most bands are of one text alone: neither they nor their texts' sketches are shuffled.
    own = stage(cells.filter(possible(shared, "cell")(F.col("cell"))).join(shared.select("cell"), "cell").select("cell", "node"), "near-copy-cells")
    sketches = nodes.select("node", "sketch").filter(possible(own.select("node").distinct(), "node")(F.col("node")))
    rows = own.join(sketches, "node").select("cell", "node", "sketch")
    large = shared.filter(F.col("n") > CELL_ROWS)
    dealt = rows.select("cell", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "sketch")
    if not large.isEmpty():
        blocks = F.ceil(F.col("n") / CELL_ROWS).cast("int")
        dealt = dealt.join(large, "cell", "left_anti").unionByName(_in_blocks(rows, large, ["cell"], blocks))
    key = ["cell", "i", "j"]
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_alike, "src long, dst long")


def print_links(nodes: DataFrame) -> DataFrame:
    """``src, dst`` of ``nodes(node, fp)``: links so that the components are those of fingerprints within the radius.

    For each fingerprint the least node stands, and the others with the same one are tied to it.
    """
    own = stage(nodes.select("node", "fp"), "near-copy-prints")
    prints = stage(own.groupBy("fp").agg(F.min("node").alias("low")), "near-copy-prints")
    same = own.join(prints, "fp").filter("node <> low").select(F.col("low").alias("src"), F.col("node").alias("dst"))
    links = fingerprint_links(prints.select("fp")).distinct()
    ends = links.join(prints.toDF("src", "a"), "src").join(prints.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return ends.unionByName(same)


def similar_links(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src, dst`` of ``nodes(node, n, bands, sketch, fp)`` so that the components are those of all pairs of similar texts.

    ``rows`` has their ``node, text``. In each component of :func:`print_links` and :func:`probable_links` all pairs are
    compared by exact similarity, a large one in pairs of blocks by hash.
    """
    loose = connected_components(print_links(nodes).unionByName(probable_links(nodes)))
    members = stage(loose.join(nodes.select("node", "n"), "node"), "near-copy-groups")
    sizes = members.groupBy("component").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    dealt = _in_blocks(members, sizes, ["component"], _blocks(F.col("texts"), F.col("shingles"))).select("component", "i", "j", "node")
    key = ["component", "i", "j"]
    rows = rows.filter(possible(members, "node")(F.col("node")))
    return dealt.join(rows, "node").select(*key, "node", "text").repartition(*key).sortWithinPartitions(*key).mapInArrow(_compare, "src long, dst long")


def _without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` isn't in ``gone(key)``: those that may be are shuffled to find out, the others stay where they are."""
    doubt = possible(gone, key)(F.col(key))
    return rows.filter(~doubt).unionByName(rows.filter(doubt).join(gone, key, "left_anti"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, all columns as they were: that with the smallest ``doc_id``.

    Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked; a group is all that
    links connect. Shorter texts are one shingle; null and empty texts are equal. Of rows that share the ``doc_id`` the
    first read stays; rows without one stay only if none of their group has one. No rows: none. Columns may have any
    names.
    """
    at, key, size, bands, sketch, fp = unused(docs.columns, "row", "key", "n", "bands", "sketch", "fp")
    with small_batches(docs.sparkSession):
        rows = stage(_with_bands(docs.withColumn(at, F.monotonically_increasing_id()), [key, size, bands, sketch, fp]), "near-copies")
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col(at).alias("row"))
    sets = rows.groupBy(key).agg(F.min(at).alias("node"), F.max(size).alias("n"), F.min(first).alias("first"))
    nodes = stage(sets.select("node", "n", "first"), "near-copy-sets")
    own = rows.select(F.col(at).alias("node"), F.col(bands).alias("bands"), F.col(sketch).alias("sketch"), F.col(size).alias("n"), F.col(fp).alias("fp"))
    # Of equal sets one row stands for all.
    own = _without(own, stage(own.select("node").join(nodes.select("node"), "node", "left_anti"), "near-copies-equal"), "node")
    linked = connected_components(similar_links(rows.select(F.col(at).alias("node"), F.col("text").cast("string").alias("text")), own))
    kept = nodes.join(linked, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("first").alias("first"))
    kept = stage(kept.select(F.col("first.row").alias(at)), "near-copies-kept")
    gone = stage(rows.select(at).join(kept, at, "left_anti"), "near-copies-gone")
    return _without(rows, gone, at).select(*(f"`{c}`" for c in docs.columns))
