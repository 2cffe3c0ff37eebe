import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from brute import components, contaminated, line_dedup, quality_counts, quality_verdicts
from spanloom.llm import pieces

SF = "/root/testdata/sf0.001"


def by_hand(docs, bench):
    """Every stage's rows (doc_id, text) in plain Python."""
    kept = quality_verdicts([((r.lang, r.source), quality_counts(r.text)) for r in docs])
    made = [sorted((r.doc_id, r.text) for r, k in zip(docs, kept, strict=True) if k)]
    after, _ = line_dedup(made[-1])
    made.append([(i, t) for (i, t), (_, before) in zip(after, made[-1], strict=True) if t == before or t.strip(" \t\n\x0b\x0c\r")])
    first, sets = components([t for _, t in made[-1]])
    made.append([x for k, x in enumerate(made[-1]) if first[k] == k or not sets[k]])
    bad = contaminated([t for _, t in made[-1]], bench)
    made.append([x for x, b in zip(made[-1], bad, strict=True) if not b])
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    made.append([(i, sp.encode(t)) for i, t in made[-1]])
    return made


@pytest.mark.parametrize("times", [1, 3])
def test_stages(spark, times, tmp_path):
    """Each stage against plain Python; with copies of the documents, whose lines and texts then all recur."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if times > 1:
        docs = docs.where("doc_id % 3 = 0").unionByName(docs.where("doc_id % 3 = 0").selectExpr("doc_id + 100000 AS doc_id", "concat(text, ' and more words') AS text", "lang", "source", "n_chars")).unionByName(docs)
        docs = docs.dropDuplicates(["doc_id"])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = by_hand(docs.collect(), bench)
    for (name, stage), rows in zip(corpus_pipeline.STAGES[:-1], want, strict=False):
        before, docs = docs, stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == before.columns, name
        got = docs.collect()
        assert sorted((r.doc_id, r.text) for r in got) == rows, name
        assert all(r.n_chars == len(r.text or "") for r in got) or name == "quality_rules"
    assert sorted((r.doc_id, list(np.array(r["ids"]))) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want[-1]
    assert all(want)
