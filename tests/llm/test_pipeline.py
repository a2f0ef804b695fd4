from __future__ import annotations

from frames import empty, odd
from test_decontaminate import brute as brute_hits
from test_packing import check as check_windows
from test_simhash import brute_fingerprint, components

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from plyweave.llm import decontaminate as contamination
from plyweave.llm import line_dedup, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_registered():
    names = list(entry.queries())
    assert [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == []
    assert "pipeline" in names


def test_stages_take_effect_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if name != "packing" else {}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        if name == "toxicity":
            bad = toxicity.score(docs, toxicity.train(spark, docs, spark.read.parquet(f"{SF}/labels.parquet"))).filter("predicted = 1")
            assert {r["doc_id"] for r in after.collect()} == before.keys() - {r["doc_id"] for r in bad.collect()}
        elif name == "line_dedup":
            assert {r["doc_id"]: r["text"] for r in after.collect()} == {r["doc_id"]: r["text"] for r in line_dedup.remove_boilerplate(docs).collect()}
            assert after.count() == len(before)
        elif name == "simhash_near_dedup":
            assert {r["doc_id"] for r in after.collect()} == {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
        elif name == "decontamination":
            bad = contamination.decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated")
            assert {r["doc_id"] for r in after.collect()} == before.keys() - {r["doc_id"] for r in bad.collect()}
        else:
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in docs.collect()}
            break
        assert after.columns == columns
        counts.append(after.count())
        docs = after
    assert counts[0] > counts[1] >= counts[-1] > 0
    whole = pipeline.run(spark, SF)
    assert whole.count() == after.count()


def brute_force(docs, items, is_toxic):
    """What the stages before packing keep, by plain loops: {doc_id: text}."""
    kept = {i: (text, source) for i, text, source in docs if not is_toxic(i)}
    sites, first = {}, {}
    for i in sorted(kept):
        for pos, line in enumerate((kept[i][0] or "").split("\n")):
            if line.strip(" \t\n\v\f\r"):
                sites.setdefault(line, set()).add(kept[i][1])
                first.setdefault(line, (i, pos))
    spread = {line for line, found in sites.items() if len(found - {None}) >= 8}
    text = {}
    for i, (whole, _) in kept.items():
        lines = enumerate((whole or "").split("\n"))
        text[i] = None if whole is None else "\n".join(line for pos, line in lines if line not in spread or first[line] == (i, pos))
    fps = {i: brute_fingerprint(t) for i, t in text.items()}
    alone = set(components(set(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3).values())
    bad = {i for i, *_, contaminated in brute_hits([(i, text[i]) for i in alone], items) if contaminated}
    return {i: text[i] for i in alone - bad}


def test_run_against_brute_force(spark):
    """The whole pipeline's rows: scores are the machine's (see test_models), all else is counted by loops."""
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    toxic = {r["doc_id"] for r in toxicity.score(docs, toxicity.train(spark, docs, labels)).filter("predicted = 1").collect()}
    plain = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    left = brute_force(plain, [(r["item_id"], r["text"]) for r in items.collect()], toxic.__contains__)
    assert 0 < len(left) < len(plain) - len(toxic)
    check_windows(pipeline.run(spark, SF).collect(), list(left.items()), 2048)


def test_stages_take_odd_rows(spark):
    for docs in (odd(spark), empty(spark)):
        for _, stage in pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == odd(spark).columns
        assert pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
