import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, learn, order=2):
    """(n_tokens, n_known, N, base, score) per row of (id, text)."""
    cut = [[*WORD.findall((t or "").translate(UPPER)), None] for _, t in rows]
    uni, grams, ctx = Counter(), Counter(), Counter()

    def runs(ws):  # (context, word) of all lengths at every token
        padded = ["<s>"] * (order - 1) + ws
        return [[(tuple(padded[i - k:i]), padded[i]) for k in range(1, order)] for i in range(order - 1, len(padded))]

    for (i, _), ws in zip(rows, cut):
        if learn(i):
            uni.update(ws)
            for token in runs(ws):
                grams.update(token)
                ctx.update(c for c, _ in token)
    n, v = sum(uni.values()), len(uni)
    p = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    out = []
    for ws in cut:
        base = sum(math.log10(p(w)) for w in ws)
        score = sum(math.log10((sum(lm.LIFT ** k * grams[g] for k, g in enumerate(token)) + lm.MU * p(w))
                               / (sum(lm.LIFT ** k * ctx[g[0]] for k, g in enumerate(token)) + lm.MU))
                    for token, w in zip(runs(ws), ws))
        out.append((len(ws), sum(uni[w] > 0 for w in ws), n, base, score))
    return out


def close(got, want, order=2):
    assert got.n_tokens == want[0] and got.n_known == want[1]
    assert got.base_score == pytest.approx(want[3], abs=1e-6, rel=1e-9)
    assert got.score == pytest.approx(want[4], abs=1e-6 + want[0] * lm.STEP / (2 if order == 2 else 1))


@pytest.mark.parametrize("n,top", [(0, 1), (1, 2**63 + 5), (1000, 2**64 - 1), (1000, 1200), (300, 40)])
def test_elias_fano(n, top):
    rng = random.Random(n)
    values = np.array(sorted({rng.randrange(top) for _ in range(n)}), dtype=np.uint64)
    raw = np.frombuffer(lm.EliasFano.encode(values), dtype=np.uint8)
    ef, end = lm.EliasFano.read(raw, 0)
    assert end == len(raw)
    assert ef.get(np.arange(len(values))).tolist() == values.tolist()
    probe = np.array([*values.tolist(), *(rng.randrange(2**64) for _ in range(200)), 0, 2**64 - 1], dtype=np.uint64)
    place = {x: i for i, x in enumerate(values.tolist())}
    assert ef.find(probe).tolist() == [place.get(x, -1) for x in probe.tolist()]


def corpus():
    rng = random.Random(9)
    words = ["the"] * 60 + ["of"] * 30 + [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))) for i in range(150)]
    rows += [(150, None), (151, ""), (152, " \n "), (153, "The THE the É é"), (153, "again"), (None, "w1 of the w2"),
             (200, "of the " * 500), (201, "of the " * 500), (202, rows[3][1]), (202, rows[3][1])]
    return rows


@pytest.mark.parametrize("shard_tokens,order", [(3_000_000, 2), (1200, 2), (3_000_000, 3), (1200, 3), (1200, 4)])
def test_against_brute_force(documents, monkeypatch, shard_tokens, order):
    rows = corpus()
    if shard_tokens < 10_000:
        monkeypatch.setattr(lm, "CHUNK_BYTES", 2000)
    learn = lambda i: i is not None and i % 3 != 1
    got, facts = lm.fit_score(documents(rows), F.col("doc_id") % 3 != 1, shard_tokens=shard_tokens, order=order)
    want = brute(rows, learn, order)
    assert facts["train_tokens"] == want[0][2]
    assert shard_tokens > 10_000 or (facts["shards"] > 3 and facts["hot"] >= 2)
    got = sorted(got.collect(), key=lambda r: (r.id is None, r.id, r.n_tokens))
    both = sorted(zip(rows, want), key=lambda x: (x[0][0] is None, x[0][0], x[1][0]))
    assert [r.id for r in got] == [x[0][0] for x in both]
    for r, (_, w) in zip(got, both):
        close(r, w, order)


def test_empty_tables_and_no_training_rows(documents):
    got, facts = lm.fit_score(documents([]), F.lit(True))
    assert got.count() == 0 and facts["train_tokens"] == 0
    got, _ = lm.fit_score(documents(["a b", None]), F.lit(False))
    assert sorted((r.n_tokens, r.n_known, r.base_score, round(r.score, 2)) for r in got.collect()) == [
        (1, 0, 0.0, 0.0), (3, 0, 0.0, 0.0)]


def test_model_sums_to_one():
    rows = [(i, t) for i, t in enumerate(["a b a", "b b c", "c"])]
    cut = [[*t.split(), None] for _, t in rows]
    vocabulary = {w for ws in cut for w in ws}
    n = sum(map(len, cut))
    uni, bi = Counter(w for ws in cut for w in ws), Counter(p for ws in cut for p in zip(["<s>", *ws], ws))
    for v in ("a", "b", "<s>", "never"):
        c = {w: bi[v, w] for w in vocabulary}
        total = sum(c[w] + lm.MU * lm.unigram(uni[w], n, len(vocabulary)) for w in vocabulary)
        total += lm.MU * lm.unigram(0, n, len(vocabulary))  # all unseen words together
        assert total / (sum(c.values()) + lm.MU) == pytest.approx(1)


def test_query_against_brute_force(spark, sf_small):
    from quarry.llm.queries import ORDER, op10_trie_lm

    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    rows = [(d.doc_id, d.text) for d in docs]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    want = {i: w for (i, _), w in zip(rows, brute(rows, lambda i: not held(i), ORDER))}
    got = op10_trie_lm(spark, sf_small).collect()
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        close(r, want[r.doc_id], ORDER)
        assert r.held_out == held(r.doc_id) and r.train_tokens == want[r.doc_id][2]
