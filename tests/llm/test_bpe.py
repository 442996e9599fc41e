import hashlib
import json
import random
import struct

import pytest
from tokenizers import Tokenizer

from quarry.llm import bpe
from quarry.llm.queries import word_bpe_path

NASTY = ["", " ", "Σ ΣΑΣ ΟΔΟΣ", "İstanbul I", "é café", "<|endoftext|>hi<|startoftext|>there <|endoftext|>",
         "a\x1cb\x85c d\u2028e", "I'm they'll 'S 'RE don't", "日本語テキスト ひらがな", "🎉🎉 emoji👨‍👩‍👧", "x" * 3000,
         "1234567 ½ ²", "\0\1", "ǅ ﬁ ß ẞ", "ab̀́cd", "<|ENDOFTEXT|>", "힣 가각", "aaaaaaab" * 50, "\u200b\ufeff", "\u0558a",
         "lettersonly" * 9000]


@pytest.fixture(scope="module")
def both():
    path = word_bpe_path()
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    with open(path, encoding="utf-8") as f:
        return bpe.Vocabulary(json.load(f)), t


def test_encoding_equals_the_library(both):
    mine, library = both
    rng = random.Random(1)
    texts = list(NASTY)
    texts += ["".join(rng.choice("etaoinshrdlu'.-1é ") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 0x24f), rng.randint(0x370, 0xd7ff), rng.randint(0xe000, 0x1ffff)]))
                      for _ in range(20)) for _ in range(400)]
    want = library.encode_batch(texts, add_special_tokens=False)
    for x, (ids, decoded), e in zip(texts, mine.encode_batch(texts), want):
        assert ids == struct.pack(f"<{len(e.ids)}I", *e.ids), x[:50]
        assert decoded == library.decode(e.ids, skip_special_tokens=False) == mine.decode(e.ids), x[:50]


def test_pair_check_equals_exact_merging(both):
    v, _ = both
    import numpy as np

    rng = random.Random(2)
    ids = [i for i in range(len(v.tokens)) if v.length[i]]
    inner = {i: t for t, i in v.ids.items()}
    start = [i for i in ids if max(inner[i]) < "\u0100"]  # a word's end has nothing after it
    keys = np.array([rng.choice(start) << 32 | rng.choice(ids) for _ in range(4000)])
    want = [v.merged(inner[k >> 32] + inner[k & 0xFFFFFFFF]) == [inner[k >> 32], inner[k & 0xFFFFFFFF]]
            for k in keys.tolist()]
    assert v.compatible(keys).tolist() == want and 0 < sum(want) < len(want)


def test_long_merging_equals_short(both):
    v, _ = both
    rng = random.Random(3)
    for _ in range(200):
        w = "".join(rng.choice("aabcehinrst") for _ in range(rng.randint(2, 45))) + chr(256 + ord("s"))
        assert v.merged_long(w) == v.merged(w)


def test_forgetting_changes_nothing(both):
    v, _ = both
    texts = ["the quick brown fox", "jumps <|endoftext|> over"]
    before = v.encode_batch(texts)
    v.forget()
    assert v.encode_batch(texts) == before


def test_rows_and_columns(documents):
    d = documents([(1, "a b"), (1, "a b"), (None, None), (2, "")]).withColumnRenamed("lang", "n_tokens")
    got = bpe.encode(d, word_bpe_path())
    assert got.columns == ["doc_id", "text", "source", "n_chars", "token_ids", "n_tokens", "decoded"]
    assert sorted((r.n_tokens, r.decoded) for r in got.collect()) == [(0, ""), (0, ""), (2, "a</w> b</w>"), (2, "a</w> b</w>")]
    assert bpe.encode(documents([]), word_bpe_path()).count() == 0


def test_query_against_the_library(spark, sf_small, both):
    from quarry.llm.queries import op8_bpe

    _, library = both
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    for r in op8_bpe(spark, sf_small).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
