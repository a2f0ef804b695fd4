from __future__ import annotations

import random

from frames import ODD, empty, odd

from plyweave.llm.decontaminate import decontaminate, fingerprints, keep_clean, windows_of, words_of


def brute(docs, items, window=13):
    by_item = {}
    for item_id, text in items:
        w = words_of(text)
        n = min(window, len(w))
        if item_id is not None and text is not None and n:
            by_item.setdefault(item_id, set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for item_id, grams in by_item.items():
            for g in grams:
                for i in range(len(w) - len(g) + 1):
                    if tuple(w[i : i + len(g)]) == g:
                        hit |= set(range(i, i + len(g)))
                        found.add(str(item_id))
        out.append((doc_id, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], [str(i) for i in r["item_ids"]], r["contaminated"]) for r in df.collect()), key=str)


def random_case(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4 if seed % 2 else 60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 12, 13, 14, 30])))) for i in range(12)]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 2)):
            w = rng.choice(items)[1].split()
            a = rng.randint(0, max(0, len(w) - 13))
            parts.append((" -- " if rng.random() < 0.5 else ", ").join(w[a : a + rng.randint(10, 16)]).upper())
            parts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))))
        docs.append((i, " ".join(parts)))
    return docs, items


def test_random_texts_both_ways(spark):
    for seed in range(3):
        docs, items = random_case(seed)
        d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        want = brute(docs, items)
        assert rows(decontaminate(d, b)) == want
        assert rows(decontaminate(d, b, most_broadcast=0)) == want


def test_odd_rows(spark):
    items = [(1, "quick brown fox jumps over the lazy dog and runs into the wood"), (1, "zzz"), (2, None), (None, "the"), (3, ""), (4, "id"), (4, "id")]
    got = decontaminate(odd(spark), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == brute([(r[0], r[1]) for r in ODD], items)
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["contaminated"] for r in decontaminate(odd(spark), none).collect()} == {False}
    assert decontaminate(empty(spark), none).count() == 0


def test_filter_keeps_clean_rows(spark):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs into the wood")], "item_id long, text string")
    kept = keep_clean(odd(spark), items)
    assert kept.columns == odd(spark).columns
    assert kept.count() == len(ODD) - 2


def test_windows_and_their_fingerprints():
    rng = random.Random(5)
    for size, vocabulary in ((5, 9), (13, 9), (14, 2), (400, 3), (400, 500)):
        words = [b"w%d" % rng.randrange(vocabulary) for _ in range(size)]
        n = min(13, size)
        lengths = [n] if n < 13 else []
        found = windows_of(words, 13, 5, lengths)
        assert [(at, size, gram) for _, at, size, gram in found] == [(i, n, b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
        _, fps = fingerprints([words], 13, 5, lengths)
        assert {w[0] for w in found} == set(fps.astype("int64").tolist())
        some = {w[0] for w in found[::3]}
        assert windows_of(words, 13, 5, lengths, some) == [w for w in found if w[0] in some]
        # Equal windows have equal fingerprints wherever they stand.
        around = [b"x"] * 20 + words + [b"y"] * 20
        by_gram = {w[3]: w[0] for w in windows_of(around, 13, 5, lengths)}
        assert all(by_gram[gram] == fp for fp, _, _, gram in found)


def test_many_items_with_one_prompt(spark):
    """20,000 items begin alike: a document with that beginning meets each of its own windows once, not once for each item."""
    from pyspark.sql import functions as F

    prompt = "read the following question with care and choose the best of the answers given below"
    items = spark.range(20_000).select(F.col("id").alias("item_id"), F.concat(F.lit(prompt + " "), F.sha2(F.col("id").cast("string"), 224), F.lit(" more")).alias("text"))
    docs = spark.createDataFrame([(1, f"before it {prompt} and after"), (2, prompt.upper() + "!"), (3, "nothing of it")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate(docs, items).collect()}
    n = len(prompt.split())
    assert [(got[i]["n_hit"], got[i]["n_items"], got[i]["contaminated"]) for i in (1, 2, 3)] == [(n, 20_000, True), (n, 20_000, True), (0, 0, False)]
    assert got[1]["item_ids"] == sorted(range(20_000), key=str)
    words = words_of(f"before it {prompt} and after")
    fps = {w[0] for w in windows_of(words_of(prompt), 13, 5, [])}
    assert sum(len(w[3]) for w in windows_of(words, 13, 5, [], fps)) < 1500
