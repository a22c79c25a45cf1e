"""The pipeline against brute force, stage by stage."""

import re

from tokenizers import Tokenizer

import corpus_pipeline
from emberlog.functions.storage import stage
from emberlog.llm.secrets import find_secrets
from emberlog.llm.tokens import DEFAULT_TOKENIZER
from test_decontaminate import brute as contaminated
from test_near_copies import brute as near_copies
from test_quality import brute as quality

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near-dedup", "decontamination", "secret scan", "packing"]
    steps = []
    for _, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, DATA), "test")
        steps.append(docs)
    good = {k: t for k, t in rows.items() if quality(t)[-1]}
    assert {r.doc_id: r.text for r in steps[0].collect()} == good
    keys = sorted(good)
    single = {keys[i]: good[keys[i]] for i in near_copies([(k, good[k]) for k in keys])}
    assert {r.doc_id: r.text for r in steps[1].collect()} == single and len(single) < len(good)
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (re.findall(r"\w+", t.lower()) for t in items)]
    near = {k: [t for t, s in zip(items, shingles) if any(tuple(w[i : i + 5]) in s for i in range(len(w) - 4))] for k, w in ((k, re.findall(r"\w+", t.lower())) for k, t in single.items())}
    clean = {k: t for k, t in single.items() if not any(contaminated(t, item) for item in near[k])}
    assert {r.doc_id: r.text for r in steps[2].collect()} == clean and len(clean) < len(single)
    spans = {r.doc_id: r.spans for r in find_secrets(steps[2]).collect()}
    redacted = {r.doc_id: r.text for r in steps[3].collect()}
    assert set(redacted) == set(clean)
    for k, text in redacted.items():
        assert (text == clean[k]) == (spans[k] == "") and ("[SECRET]" in text) == bool(spans[k])
    assert all(s.columns == ["doc_id", "text", "lang", "source", "n_chars"] for s in steps[:4])
    whole = Tokenizer.from_file(DEFAULT_TOKENIZER)
    sizes = {}
    for r in steps[4].collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {k: len(whole.encode(t, add_special_tokens=False).ids) + 1 for k, t in redacted.items()}
    last = corpus_pipeline.run(spark, DATA)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in last.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in steps[4].collect())


def test_odd_rows_through_all_stages(spark, tmp_path):
    good = " ".join(f"plain{i % 97} word{i % 61}" for i in range(400))
    rows = [(None, good + " one", "en", None), (5, good, "en", "a"), (5, good, "en", "b"), (None, None, None, None), (6, "", "en", "a"), (7, " ".join(f"x{i} y{i}" for i in range(150_000)), "de", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS n_chars", "2 AS __row", "3 AS row", "4 AS fp", "5 AS part", "6 AS n", "7 AS bands", "8 AS __alive")
    spark.createDataFrame([(1, "some benchmark item of seven words"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for given, ids in ((docs, [5, 7]), (docs.limit(0), [])):
        for _, function in corpus_pipeline.STAGES[:-1]:
            given = stage(function(spark, given, str(tmp_path)), "test")
            assert given.columns == docs.columns
        assert sorted(r.doc_id for r in given.select("doc_id").collect()) == ids
        packed = corpus_pipeline.STAGES[-1][1](spark, given, str(tmp_path))
        assert sorted(r.doc_id for r in packed.select("doc_id").distinct().collect()) == ids
