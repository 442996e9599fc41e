import random

import numpy as np
import pytest
import xxhash

from quarry.llm import simhash
from quarry.llm.graph import components


def brute_fp(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, max_bits):
    """Smallest place reachable by links of at most max_bits."""
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= max_bits:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def clustered(rng, n, centres, flips):
    base = [rng.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < n:
        x = rng.choice(base)
        for _ in range(rng.randint(0, flips)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_fingerprint_matches_definition():
    texts = ["", "one", "Two words", "A b\tc\nd  e", "É é Straße " * 9, "x " * 400, None]
    got = simhash.simhashes([(t or "").encode() for t in texts], 3)
    assert [int(x) for x in got] == [brute_fp(t) for t in texts]


@pytest.mark.parametrize("max_bits", [0, 1, 2, 3])
def test_index_forest_equals_brute_force(max_bits):
    rng = random.Random(max_bits)
    fps = clustered(rng, 300, 8, 5)
    place = simhash.GrayIndex(np.array(fps, dtype=np.uint64), np.zeros(len(fps), np.int64)).forest(max_bits)

    def root(i):
        while place[i] != i:
            i = int(place[i])
        return i
    want = brute_components(fps, max_bits)
    groups = {}
    for i, w in enumerate(want):
        groups.setdefault(w, set()).add(root(i))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


@pytest.mark.parametrize("cap", [16384, 4])
@pytest.mark.parametrize("max_bits", [1, 2])
def test_links_do_not_depend_on_the_root_cap(spark, cap, max_bits):
    rng = random.Random(5)
    fps = clustered(rng, 250, 6, 4)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = dict(map(tuple, simhash.link_fingerprints(df, max_bits, cap).collect()))
    want = brute_components(fps, max_bits)
    classes = {}
    for f, w in zip(signed, want):
        classes.setdefault(w, []).append(f)
    assert got == {f: min(c) for c in classes.values() if len(c) > 1 for f in c}


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (3, 4)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_of_awkward_rows(documents):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(5, long), (3, long), (9, ""), (8, None), (None, long), (1, "alone here now"), (5, long), (2, " \n ")]
    got = simhash.near_duplicates(documents(rows)).collect()
    assert sorted(((r.id, r.component_id) for r in got), key=str) == sorted(
        [(5, 3), (3, 3), (9, 2), (8, 2), (None, 3), (1, 1), (5, 3), (2, 2)], key=str)
    assert simhash.near_duplicates(documents([])).count() == 0


def test_keep_one_keeps_columns_and_one_row_of_each_group(spark, documents):
    long = " ".join(f"w{i}" for i in range(300))
    d = documents([(5, long), (3, long), (3, long), (9, ""), (8, None), (None, long), (1, "alone here now")])
    d = d.withColumn("fp", d.doc_id * 2).withColumn("_k1", d.lang)
    got = simhash.keep_one(d)
    assert got.columns == d.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 8]


def test_query_against_brute_force(spark, sf_small):
    from quarry.llm.queries import op1_simhash

    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [brute_fp(r.text) for r in docs]
    want = {r.doc_id: (f"{f:016x}", docs[c].doc_id) for r, f, c in zip(docs, fps, brute_components(fps, 2))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash(spark, sf_small).collect()}
    assert got == want
