"""The stages one after another, each against a plain version of what it does to its own input."""

import corpus_pipeline as cp
from vigilflow.llm import catalogue, mixing, quality, secrets
from vigilflow.llm.common import store

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in cp.STAGES:
        out = store(stage(spark, docs, SF), "test-stage")
        if name != "pieces":
            assert out.columns == cp.COLUMNS
        have = docs.collect()
        if name == "quality":
            good = {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted}
            assert {r.doc_id for r in out.collect()} == good
            rated = {r.doc_id: r.quality for r in labels.collect()}
            assert not [i for i in rated if rated[i] == 1 and i in {r.doc_id for r in have} - good]
        elif name == "near-duplicates":
            from .test_minhash import brute

            want = brute([(r.doc_id, r.text, "s") for r in have])
            assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in want.items() if c == i}
        elif name == "secrets":
            spans = {}
            for r in secrets.find(docs).where("secret").collect():
                spans.setdefault(r.doc_id, set()).add((r.start, r.end))
            new = {r.doc_id: r.text for r in out.collect()}
            for r in have:
                t = r.text
                for a, b in sorted(spans.get(r.doc_id, ()), reverse=True):
                    t = t[:a] + "[SECRET]" + t[b:]
                assert new[r.doc_id] == t
        elif name == "mixing":
            n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
            assert n == {r.doc_id: r.taken // r.size for r in mixing.decide(docs).collect() if r.taken}
        else:
            import sentencepiece

            m = sentencepiece.SentencePieceProcessor(model_file=cp.MODEL)
            assert sorted((r.doc_id, list(r.ids)) for r in out.collect()) == sorted((r.doc_id, m.encode(r.text)) for r in have)
        docs = out


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in catalogue.QUERIES) == list(range(1, 14))
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
