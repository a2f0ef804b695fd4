from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from frames import ODD, empty, odd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plyweave.llm.packing import CapacityTree, best_fit_decreasing, pack_documents, pieces, salt_of


def one_by_one(lengths, capacity):
    """Best-fit decreasing piece by piece: how full the windows get."""
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in room if r >= n]
        if fit:
            room[room.index(min(fit))] -= n
        else:
            room.append(capacity - n)
    return sorted(capacity - r for r in room)


def placed(histogram, capacity):
    windows = defaultdict(list)
    for length, _, n, count, first, offset in best_fit_decreasing(histogram, capacity):
        for i in range(n):
            windows[first + i % count].append((offset + i // count * length, length))
    return windows


@given(st.lists(st.integers(1, 40), max_size=120))
@settings(deadline=None)
def test_plan_is_best_fit_decreasing(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    windows = placed(histogram, 40)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 40
    assert sorted(sum(p[1] for p in parts) for parts in windows.values()) == one_by_one(lengths, 40)
    assert sorted(p[1] for parts in windows.values() for p in parts) == sorted(lengths)


def test_tree_finds_the_tightest():
    rng, tree, held = random.Random(1), CapacityTree(50), [0] * 51
    for _ in range(500):
        c = rng.randint(0, 50)
        n = -1 if held[c] and rng.random() < 0.5 else 1
        tree.add(c, n)
        held[c] += n
        need = rng.randint(0, 50)
        assert tree.tightest(need) == next((i for i in range(need, 51) if held[i]), -1)


def check(rows, docs, capacity):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(int)
    for doc_id, text in docs:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), capacity):
            part = ids[at : at + capacity]
            want[doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    got = defaultdict(int)
    windows = defaultdict(list)
    for r in rows:
        got[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(sum(p[1] for p in parts) for parts in windows.values()) == one_by_one([k[2] for k, n in want.items() for _ in range(n)], capacity)


def test_round_trip_with_odd_texts(spark):
    texts = ["a  b", "a   b", " lead", "trail ", "x \n y\n\nz", "don't we'll", "<|endoftext|> in text", "tab\tand nbsp 　wide", "😀 é́ 中文", "a b " * 3000, "a\nb.\n" * 5000 + "c"]
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    docs = odd(spark).select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    check(pack_documents(docs, capacity=64).collect(), [(r[0], r[1]) for r in ODD] + rows, 64)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = pack_documents(docs)
    check(got.collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], 2048)


def test_ids_and_empty(spark):
    assert pack_documents(empty(spark)).count() == 0
    row = pack_documents(spark.createDataFrame([(1, "ab cd")], "doc_id long, text string"), with_ids=True).first()
    assert len(row["ids"]) == 4 * row["length"] and zlib.crc32(row["ids"]) == row["ids_crc32"]


def test_rows_without_ids_are_dealt_out(spark):
    """Equal rows without an id, and rows that share an id, are many rank groups, and windows are the same each time."""
    rows = [(None, "")] * 500 + [(None, f"w{i % 3}") for i in range(400)] + [(7, f"t{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    one, two = (sorted(map(tuple, pack_documents(docs, capacity=64).collect()), key=str) for _ in range(2))
    assert one == two
    check(pack_documents(docs, capacity=64).collect(), rows, 64)
    cut = pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), 64, 1)
    groups = cut.groupBy("length", F.pmod(salt_of(), F.lit(20))).count().collect()
    assert max(r["count"] for r in groups) < 120


def test_ids_are_the_tokenizers():
    from hypothesis import example

    from plyweave.llm.packing import _encoder

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = _encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))

    @given(st.lists(st.sampled_from(["word", "Ünï", "'s", "don't", ",", ".", "!", "..", "7", " ", "  ", "\n", "\n\n", "\t", " ", " ", "\r", "😀", "é́", "ª", "٣", "a", "x1"]), max_size=12))
    @settings(max_examples=1500, deadline=None)
    @example(["a", " ", "word", ",", "\n", ".", "\n", "\n", "a"])
    def same(parts):
        text = "".join(parts)
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text

    same()
