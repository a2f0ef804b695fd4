from __future__ import annotations

import random

import numpy as np
import xxhash
from frames import ODD, empty, odd

from plyweave.llm.components import connected_components
from plyweave.llm.simhash import covering_masks, forest, keep_one, links, near_duplicates, text_fingerprint


def brute_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [words] if len(words) < 3 else [words[i : i + 3] for i in range(len(words) - 2)]
    values = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def components(nodes, near):
    seen = {}
    for start in sorted(nodes):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen[x] = start
                todo += [y for y in nodes if y not in seen and near(x, y)]
    return seen


def test_fingerprint_is_the_contracts():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 4, 7, 50, 300):
        text = "".join(rng.choice(["Aé", "b", "C\u0085", "日本"]) + rng.choice([" ", "\n", "\t \x0b", "  "]) for _ in range(n))
        assert text_fingerprint(text) == brute_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a bé c"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest("a bé c".encode(), 42)


def test_every_pair_within_the_radius_collides():
    rng = random.Random(3)
    for radius in (1, 2, 3):
        masks = covering_masks(list(range(64)), radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(2000):
            x = rng.getrandbits(64)
            y = x
            for bit in rng.sample(range(64), rng.randint(0, radius)):
                y ^= 1 << bit
            assert any((x ^ y) & m & (1 << 64) - 1 == 0 for m in masks)


def noisy(seed, groups=20, size=12):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        x = rng.getrandbits(64)
        for _ in range(size):
            y = x
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                y ^= 1 << bit
            out.append(y)
    return sorted(set(out))


def test_components_of_random_fingerprints(spark):
    fps = noisy(1)
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    want = components(set(range(len(fps))), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    df = spark.createDataFrame(rows, "fp long, rep long")
    for bucket in (16_384, 2):  # the small one deals large buckets anew
        got = {r["node"]: r["component"] for r in connected_components(links(df, 3, bucket)).collect()}
        assert {i: got.get(i, i) for i in range(len(fps))} == want


def test_forest_connects_without_pairs():
    fps = np.array(noisy(4, 3, 30), np.uint64)
    edges = forest(fps, 3)
    assert len(edges) < len(fps)
    ints = [int(x) for x in fps]
    want = components(set(range(len(ints))), lambda a, b: (ints[a] ^ ints[b]).bit_count() <= 3)
    near = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    assert components(set(range(len(ints))), lambda a, b: (a, b) in near) == want


def test_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = components(set(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicates(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    kept = {r["doc_id"] for r in keep_one(docs).collect()}
    assert kept == set(want.values())


def test_odd_rows(spark):
    got = near_duplicates(odd(spark)).collect()
    assert len(got) == len(ODD)
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in got if r["fingerprint"] == "0" * 16) == [(-1, 2), (2, 2), (3, 2), (4, 2)]
    assert [r["component_id"] for r in got if r["doc_id"] == 6] == [5]
    assert near_duplicates(empty(spark)).count() == 0
    kept = sorted((r["doc_id"] or -1) for r in keep_one(odd(spark)).collect())
    assert kept == [-1, -1, 1, 2, 5, 7] or kept == [-1, -1, 1, 1, 2, 5, 7]


def test_chain_of_edges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40, 70)] + [(3, 3), (5, 4), (4, 5), (None, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {i: 40 for i in range(40, 71)} | {3: 3, 4: 4, 5: 4}
    assert connected_components(edges.limit(0)).count() == 0


def test_far_texts_that_share_a_doc_id_keep_a_row_each(spark):
    a, b = ("".join(f"{w}{i} " for i in range(40)) for w in ("one", "two"))
    rows = [(1, a), (1, b), (1, b), (5, a), (6, b)]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, a), (1, b)]


def test_of_rows_with_one_id_and_text_the_same_one_stays(spark):
    rows = [(1, "one text of many words", f"s{i}", {"k": i}) for i in range(9)] + [(2, None, None, None)] * 3 + [(3, None, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, m map<string, int>")
    kept = [sorted(((r["doc_id"], r["text"], r["a.b"], r["m"]) for r in keep_one(docs.orderBy(o).repartition(n)).collect()), key=str) for o, n in (("`a.b`", 1), ("doc_id", 5))]
    assert kept[0] == kept[1]
    assert [r[:2] for r in kept[0]] == [(1, "one text of many words"), (2, None)] and kept[0][0] in rows
