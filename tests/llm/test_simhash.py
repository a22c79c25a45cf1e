import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from emberlog.llm.simhash import fingerprint_links, grid_masks, near_dedup, near_duplicates, segment_counts
from emberlog.operators.components import connected_components


def brute_print(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(values, radius):
    """Value -> all that it reaches."""
    left, parts = set(values), []
    while left:
        front = [left.pop()]
        part = set(front)
        while front:
            x = front.pop()
            near = {y for y in left if bin(x ^ y).count("1") <= radius}
            left -= near
            part |= near
            front += near
        parts.append(part)
    return {v: part for part in parts for v in part}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5), (7, None)] + [(2000, 2001 + i) for i in range(200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    near = {}
    for a, b in edges:
        if b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for x in sorted(near):
        front = [x] if x not in want else []
        while front:
            y = front.pop()
            if y not in want:
                want[y] = x
                front += near[y]
    assert got == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_every_link_within_the_radius_connects(spark):
    rnd = random.Random(4)
    values = set()
    for _ in range(40):
        x = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 3, 60])):
            values.add(x)
            for _ in range(rnd.randint(1, 4)):
                x ^= 1 << rnd.randrange(64)
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    want = brute_components(values, 3)
    for cell_rows in (32_768, 16):
        links = fingerprint_links(df, 3, cell_rows)
        rows = links.collect()
        assert all(bin((r.src ^ r.dst) & (1 << 64) - 1).count("1") <= 3 for r in rows)
        got = {r.node % (1 << 64): r.component % (1 << 64) for r in connected_components(links).collect()}
        for v in values:
            assert (got.get(v, v) in want[v]) and len({got.get(y, y) for y in want[v]}) == 1
    assert fingerprint_links(df.limit(0)).count() == 0


def test_embedding_is_a_lower_bound(spark):
    rnd = random.Random(6)
    values = [rnd.getrandbits(64) for _ in range(200)] + [0, (1 << 64) - 1]
    codes = [r.e % (1 << 64) for r in spark.createDataFrame([(signed(v),) for v in values], "fp long").coalesce(1).select(segment_counts(F.col("fp")).alias("e")).collect()]
    counts = [[bin(v >> 2 * s & 3).count("1") for s in range(32)] for v in values]
    for i in range(0, 200, 7):
        for j in range(200):
            manhattan = sum(abs(a - b) for a, b in zip(counts[i], counts[j]))
            assert bin(codes[i] ^ codes[j]).count("1") == manhattan <= bin(values[i] ^ values[j]).count("1")
    assert len(grid_masks(3)) == 20 and np.bitwise_or.reduce(np.array(grid_masks(3), np.uint64)) == (1 << 64) - 1


def documents():
    rnd = random.Random(8)
    rows = []
    for i in range(120):
        words = [f"w{rnd.randrange(900)}" for _ in range(rnd.choice([1, 2, 40, 300]))]
        rows.append((i, " ".join(words)))
        if i % 3 == 0:
            words[rnd.randrange(len(words))] = "Other"
            rows.append((500 + i, "\n".join(words)))
        if i % 4 == 0:
            rows.append((300 - i, rows[-1][1]))
    return rows + [(900, ""), (901, None), (901, None), (None, "  \n"), (None, "alone here you are"), (None, "alone here you are"), (950, "A b\tC"), (951, "a B c"), (952, "long " * 40_000), (953, "É x"), (954, "é x")]


def test_documents(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "'x' AS fingerprint").repartition(3)
    prints = {t: brute_print(t) for _, t in rows}
    parts = brute_components(set(prints.values()), 3)
    lowest = {}
    for key, text in rows:
        if key is not None:
            part = min(parts[prints[text]])
            lowest[part] = min(key, lowest.get(part, key))
    want = Counter((key, f"{prints[t]:016x}", lowest.get(min(parts[prints[t]]))) for key, t in rows)
    assert Counter(map(tuple, near_duplicates(docs).collect())) == want
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(min(parts[prints[r.text]]) for r in got) == sorted({min(p) for p in parts.values()})
    assert all(r.doc_id == lowest.get(min(parts[prints[r.text]])) for r in got)
    assert near_duplicates(docs.limit(0)).count() == 0 and near_dedup(docs.limit(0)).count() == 0
