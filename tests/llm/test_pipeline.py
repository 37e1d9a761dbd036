"""run() against the stages by brute force, on the small documents."""

from __future__ import annotations

import random

import corpus_pipeline
import pandas as pd

from kerbside.llm import decontaminate, pieces

from .test_operators import brute_components, prose, repeated_runs

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_lines(texts):
    return [("".join(x for i, x in enumerate(own) if i not in gone) if gone else t, len(gone)) for t, (own, gone) in zip(texts, repeated_runs(texts), strict=True)]


def test_repeated_ids_lose_no_text(spark):
    rng = random.Random(1)
    a, b, c = (prose(rng, 30) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (None, a), (None, c), (2, c), (3, ""), (4, ""), (5, None), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    kept = corpus_pipeline.ngram_jaccard(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(1, a), (2, b), (2, c), (3, ""), (4, ""), (5, ""), (6, "")])


def test_stages_take_odd_tables(spark):
    texts = [None, "", " ", "one", "e" * 40_000, "a b c d e f g h i j k l. " * 3]
    odd = spark.createDataFrame([(None if i == 3 else i, t, None if i == 2 else "en", None, None) for i, t in enumerate([*texts, *texts])], DOCS)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "sentencepiece" or out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)


def test_pipeline(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    kept = [(i, t) for i, t in zip(docs.doc_id, docs.text, strict=True) if t and any(map(str.isalpha, t))]
    # equal texts keep the order of doc_id, which is how the first occurrence is chosen
    kept = [(i, new) for (i, _), (new, gone) in zip(kept, brute_lines([t for _, t in kept]), strict=True) if not gone or new.strip(" ")]
    names = brute_components([i for i, _ in kept], [t for _, t in kept])
    kept = [(i, t) for i, t in kept if names[i][1] == i]
    matcher = decontaminate.Matcher([(i, decontaminate.normal(t)) for i, t in zip(bench.item_id, bench.text, strict=True) if decontaminate.normal(t)])
    kept = {i: t for i, t in kept if not list(matcher.search(t))}
    rows = corpus_pipeline.run(spark, SF).collect()
    decoder = pieces.Encoder(rate=0.0)
    assert {r.doc_id: decoder.decode(r.ids) for r in rows} == kept
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "sentencepiece"]
