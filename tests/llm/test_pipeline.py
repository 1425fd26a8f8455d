import zlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from caseflow.llm import exact_dedup, mixing, near_dedup, packing
from caseflow.sources.sinks import staged

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, FOLDER))
        assert docs.columns == columns
        kept.append(docs)
    clean, single, apart, mixed = kept
    assert 0.7 * before < clean.count() <= before
    assert single.count() == exact_dedup.find_copies(clean).filter("kept").count()
    assert exact_dedup.find_copies(single).filter("group_size > 1").count() == 0
    assert apart.count() == near_dedup.find_near_copies(single).filter("kept").count()
    assert near_dedup.find_near_copies(apart).filter("class_size > 1").count() == 0
    assert mixed.count() == mixing.mix(apart).selectExpr("sum(copies)").first()[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert rebuilt(packed.collect()) == Counter((r["doc_id"], r["text"] or "") for r in mixed.collect())


def rebuilt(pieces):
    """The documents that the pieces hold, each as often as it was packed."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows, sequences = {}, {}
    for p in pieces:
        ids = [int.from_bytes(p["ids"][i : i + 4], "little") for i in range(0, len(p["ids"]), 4)]
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(ids) == p["length"]
        rows.setdefault((p["row"], p["doc_id"], p["doc_tokens"]), []).append((p["start"], ids))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for held in sequences.values():
        ends = [a + n for a, n in sorted(held)]
        assert [a for a, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 2048
    found = Counter()
    for (_, doc_id, tokens), held in rows.items():
        ids = [i for _, part in sorted(held) for i in part]
        assert len(ids) == tokens and ids[-1] == packing.END_ID
        found[(doc_id, tokenizer.decode(ids[:-1], skip_special_tokens=False))] += 1
    return found


def test_run_is_its_stages(spark):
    docs = corpus_pipeline.documents(spark, FOLDER)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, FOLDER))
    found = rebuilt(corpus_pipeline.run(spark, FOLDER).collect())
    assert found == Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
