import struct

import pytest
from test_decontam import decontam
from test_line_rules import brute_verdicts, md5_60, normal
from test_simhash import brute_components, brute_fp
from test_suffixes import brute as brute_repeats
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm.queries import word_bpe_path


def brute(docs, items):
    """(doc_id, ids) by plain loops, stage by stage."""
    rows = [(d.doc_id, d.text, d.source) for d in docs]
    verdicts = brute_verdicts([(t, s) for _, t, s in rows], md5_60)
    rows = [r for r, v in zip(rows, verdicts) if v[2]]
    assert not any(v[0] for v in verdicts)  # no frequent lines in this small table
    fps = [brute_fp(t) for _, t, _ in rows]
    first = {}
    for r, c in zip(rows, brute_components(fps, 2)):
        first.setdefault(c, []).append(r)
    rows = [min(g) for g in first.values()]
    cut = brute_repeats([t.encode() for _, t, _ in rows], 200)
    rows = [(i, left.decode("utf-8", "ignore")) for (i, _, _), (left, _, _) in zip(rows, cut)]
    flat = lambda t: " " + " ".join(decontam.words_of(t)) + " "
    rows = [(i, t) for i, t in rows if not any(flat(x) in flat(t) for x in items)]
    library = Tokenizer.from_file(word_bpe_path())
    library.no_truncation()
    library.no_padding()
    return {i: library.encode(t, add_special_tokens=False).ids for i, t in rows}


def test_run_against_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    items = [r.text for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    want = brute(docs, items)
    got = corpus_pipeline.run(spark, sf_small).collect()
    assert len(got) == len(want) < len(docs)
    for r in got:
        assert bytes(r.token_ids) == struct.pack(f"<{len(want[r.doc_id])}I", *want[r.doc_id])
        assert r.n_tokens == len(want[r.doc_id])


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_the_columns_and_survive_awkward_rows(spark, documents, sf_small, k):
    name, stage = corpus_pipeline.STAGES[k]
    words = " ".join("".join(chr(97 + (i * 7 + j * 3) % 26) for j in range(i % 5 + 2)) + str(i) for i in range(400))
    d = documents([(1, words), (1, words), (2, None), (3, ""), (None, words + " x"), (4, "short"), (5, "ü " * 5000)])
    d = d.withColumn("quality", d.lang).withColumn("cut", d.lang).withColumn("overlaps", d.lang).withColumn("_k1", d.lang)
    got = stage(spark, d, sf_small)
    assert got.columns == d.columns, name
    assert got.schema.simpleString() == d.schema.simpleString()
    got.collect()
    assert stage(spark, d.limit(0), sf_small).count() == 0


def test_last_stage(spark, documents, sf_small):
    got = corpus_pipeline.tokenize(spark, documents(["a b", None]), sf_small).collect()
    assert sorted(r.n_tokens for r in got) == [0, 2]
