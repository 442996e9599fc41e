import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from quarry.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, phrase string, Count long"


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
        words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
        if words:
            yield words


def brute_counts(docs, depth):
    f = defaultdict(Counter)
    for _, text, lang in docs:
        for ws in pieces(text):
            for k in range(1, depth + 1):
                f["und" if lang is None else lang].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    return f


def brute(docs, min_count=10, depth=3, share=50, top=2000):
    out = []
    for lang, f in brute_counts(docs, depth).items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        cand = {g: c for g, c in f.items() if len(g) > 1 and c >= min_count}
        rows = []
        for g, a in cand.items():
            inside = [c for h, c in cand.items() if len(h) > len(g)
                      and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if any(100 * c >= share * a for c in inside):
                continue
            score, k = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, n, -s) for i, (s, a, p, le, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def random_docs(rng, n, words=14):
    vocab = ["a", "B", "the", "of", "é", "Ünder", "x\x1fy", "日本", " ", "o'k", "(z)", "-"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", " ; "]
    docs = []
    for i in range(n):
        t = "".join(rng.choice(vocab[:rng.randrange(3, 12)]) + rng.choice(marks) for _ in range(rng.randrange(words)))
        docs.append((i, rng.choice([t, t, t, t + ". the of a" * 3, None, ""]), rng.choice(["en", "en", "de", None, "und", ""])))
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(*d, "p", 1) for d in docs], SCHEMA)


def test_against_brute_force(spark):
    docs = random_docs(random.Random(1), 400)
    got = C.collocations(frame(spark, docs), shard_bytes=300)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(docs) != []


@pytest.mark.parametrize("depth", [2, 4])
def test_other_depths_and_limits(spark, depth):
    docs = random_docs(random.Random(2), 200)
    got = C.collocations(frame(spark, docs), min_count=5, depth=depth, share=70, top=9)
    assert sorted(map(tuple, got.collect())) == brute(docs, 5, depth, 70, 9)


def test_long_texts_are_cut_and_counted_once(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice(["a", "b", "c", "d,"]) for _ in range(6_000)) + "x" * 9000
    docs = [(1, long, "en"), (2, "a b. c", "en"), (1, long, "en"), (3, "y" * 50_000, "de")]
    got = {(r.lang, tuple(r.phrase.split(" ")) if r.phrase else ()): r["count"]
           for r in C.gram_counts(frame(spark, docs), min_count=1, shard_bytes=4000).collect() if r["count"]}
    want = {(lang, g): c for lang, f in brute_counts(docs, 3).items() for g, c in f.items()}
    want |= {(lang, ()): sum(c for g, c in f.items() if len(g) == 1) for lang, f in brute_counts(docs, 3).items()}
    assert got == want


def test_scores_pass_64_bits(spark, monkeypatch):
    big = 9 * 10**11
    rows = [("en", "", 0, 5 * big), ("en", "a", 1, big), ("en", "b", 1, big + 7), ("en", "a b", 2, big - 1)]
    monkeypatch.setattr(C, "gram_counts", lambda docs, *a, **k: spark.createDataFrame(rows, C.GRAMS))
    r, = C.collocations(frame(spark, [(1, "a", "en")])).collect()
    assert r.score == 1000000 * (big - 1) ** 2 // (big * (big + 7)) and r.n == 5 * big


def test_index_extends_both_ways():
    import numpy as np

    ids = np.array([1, 2, 1, 3, 0, 2, 1, 3, 3, 0, 1], np.int32)
    found = [dict(zip(zip(*[w.tolist() for w in words], strict=True), count.tolist(), strict=True))
             for words, count in C.grams_of(ids, 4, 3)]
    runs = [[1, 2, 1, 3], [2, 1, 3, 3], [1]]
    for k in range(3):
        assert found[k] == Counter(tuple(r[i:i + k + 1]) for r in runs for i in range(len(r) - k))


def test_no_words(spark):
    docs = [(1, None, "en"), (2, "", None), (3, " .,\n", "de")]
    assert C.collocations(frame(spark, docs)).count() == 0 == C.collocations(frame(spark, docs).limit(0)).count()


def test_query_matches_its_sql(spark, sf_small):
    from quarry.llm.queries import ORACLES, QUERIES
    from quarry.plans.verify import digest, duck_connection

    got = QUERIES["op13_collocations"](spark, sf_small)
    rel = duck_connection(sf_small).execute(ORACLES["op13_collocations"])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(got.columns)
    rows = [tuple(r) for r in got.collect()]
    assert rows and digest(got.columns, rows) == digest(cols, rel.fetchall())


def test_phrases_travel_packed_by_bucket():
    names = [b"", b"a", b"bb", b"c"]
    shard = {"ids": C.pack(np.array([1, 2, 3, 0, 1, 2, 1, 2])), "names": names, "lang": "en", "sign": 1}

    got = C.shard_grams(shard, {k: np.packbits(np.ones(16, bool)).tobytes() for k in range(4)}, 3, 4)
    assert got.column_names == ["bucket", "grams"] and len(set(got["bucket"].to_pylist())) == got.num_rows <= 4
    both = [C.summed(pa.concat_tables([got, got]).filter(pc.equal(pa.concat_tables([got, got])["bucket"], k)), 4)
            for k in set(got["bucket"].to_pylist())]
    found = {(r["phrase"], r["words"]): r["count"] for t in both for r in t.to_pylist()}
    # every phrase was counted twice; those under four are gone, the number of words stays
    assert found == {("", 0): 14, ("a", 1): 6, ("bb", 1): 6, ("a bb", 2): 6}
