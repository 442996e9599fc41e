import random
from itertools import combinations

import numpy as np
import pytest

from quarry.llm import decontam

RNG = random.Random(7)
VOCAB = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 8))) for _ in range(3000)]


def prose(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def brute(texts, items, min_words=13, similarity=0.8):
    """Items that lie over each text somewhere with a long enough similar run."""
    out = []
    for t in texts:
        tw, hits = decontam.words_of(t or ""), set()
        for i, x in items:
            xw = decontam.words_of(x or "")
            need = min(min_words, len(xw))
            if len(xw) < decontam.LEAST:
                continue
            for d in range(-len(xw), len(tw)):
                eq = [0 <= d + k < len(tw) and tw[d + k] == xw[k] for k in range(len(xw))]
                lo, hi = max(0, -d), min(len(xw), len(tw) - d)
                if any(sum(eq[a:b]) >= similarity * (b - a) - 1e-9
                       for a in range(lo, hi) for b in range(a + need, hi + 1)):
                    hits.add(i)
                    break
        out.append(hits)
    return out


@pytest.mark.parametrize("n", range(5, 13))
def test_short_masks_hit_what_the_check_accepts(n):
    for k in range(n + 1):
        if (n - k) >= 0.8 * n - 1e-9:
            for gone in combinations(range(n), k):
                assert any(not set(gone) & {s + c for c in m} for m in decontam.SHORT for s in range(n - m[-1])), gone


def test_query_finds_every_replaced_word(spark, documents, tmp_path):
    """Items of 5 to 14 words with any one word replaced, through the registered query."""
    from quarry.llm.queries import op4_decontam

    items = [(n, prose(n)) for n in range(5, 15)] + [(99, "".join(chr(0x4E00 + 7 * i) for i in range(20)))]
    rows = [(0, prose(300))]
    for n, x in items[:-1]:
        for k in range(n):
            w = x.split()
            w[k] = "changed"
            rows.append((1000 * n + k, f"{prose(20)} {' '.join(w)} {prose(20)}"))
    rows += [(2, "前" + items[-1][1].replace(chr(0x4E00 + 70), "x") + "后"), (3, items[-1][1][:9])]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: list(r.item_ids) for r in op4_decontam(spark, str(tmp_path)).collect()}
    assert got == {i: [99] if i == 2 else [i // 1000] if i >= 1000 else [] for i, _ in rows}


def test_ids_of_any_type(spark, documents):
    x = prose(20)
    d = documents([(1, x), (2, prose(30))])
    for kind, ids in (("string", ["it2", None, "it1"]), ("long", [5, None, 4]), ("date", [None])):
        bench = spark.createDataFrame([(i, x) for i in ids], f"item_id {kind}, text string")
        for part in (1_000_000, 20):
            got = {r.doc_id: [o.item_id for o in r.overlaps] for r in decontam.mark(d, bench, part_words=part).collect()}
            assert got == {1: sorted(i for i in ids if i is not None) + [None], 2: []}
        assert [r.doc_id for r in decontam.clean(d, bench).collect()] == [2]


@pytest.mark.parametrize("n,k", [(13, 2), (16, 3)])
def test_masks_hit_every_way_to_replace_words(n, k):
    for gone in combinations(range(n), k):
        assert any(not set(gone) & {s + c for c in m} for m in decontam.MASKS for s in range(n - m[-1]))


def test_against_brute_force(spark, documents):
    items = [(i, prose(RNG.randint(14, 40))) for i in range(12)] + [(20, prose(5)), (21, prose(6)), (22, "too few words"),
                                                                    (23, None), (24, ""), (25, prose(9))]
    items.append((26, items[0][1]))
    texts = [prose(60) for _ in range(20)] + [None, "", prose(8000)]
    for i, x in items:
        if x:
            w = x.split()
            texts.append(f"{prose(15)} {x.upper()}, {prose(9)}")
            texts.append(" ".join(w[:RNG.randint(3, len(w))]))
            for _ in range(3):
                y = list(w)
                for p in RNG.sample(range(len(y)), min(len(y), RNG.randint(1, 4))):
                    y[p] = RNG.choice(VOCAB)
                texts.append(f"{prose(5)}\n{' '.join(y)}\t{prose(5)}")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts, items)
    for part in (1_000_000, 60):
        got = decontam.mark(documents(texts).withColumnRenamed("lang", "overlaps"), bench, part_words=part).collect()
        seen = {r.doc_id: {o.item_id for o in r.overlaps} for r in got}
        missed = [(i, w - seen[i]) for i, w in enumerate(want) if not seen[i] <= w or len(w - seen[i])]
        assert not missed, missed
    assert sum(map(bool, want)) > 20


def test_clean_keeps_columns_and_clean_rows(spark, documents):
    item = prose(30)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    d = documents([(1, prose(50)), (1, prose(50)), (None, None), (2, f"x {item} y"), (3, item[:20])]).withColumnRenamed(
        "lang", "overlaps")
    got = decontam.clean(d, bench)
    assert got.columns == d.columns
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 1, 3]
    assert decontam.clean(d, bench.limit(0)).count() == 5
    assert decontam.clean(d.limit(0), bench).count() == 0


def test_query_against_verbatim_search(spark, sf_small):
    from quarry.llm.queries import op4_decontam

    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").select("item_id", "text").collect()]
    flat = lambda t: " " + " ".join(decontam.words_of(t)) + " "
    want = {d.doc_id: sorted(i for i, x in items if flat(x) in flat(d.text)) for d in docs}
    got = {r.doc_id: list(r.item_ids) for r in op4_decontam(spark, sf_small).collect()}
    assert got == want and np.any([bool(x) for x in want.values()])


def test_words_do_not_depend_on_the_pattern():
    texts = ["", "A b-c é1 ü", "x 前后 ab后c", "ไทย a", "“quoted” words", "\u0dff\u0e00"]
    for t in texts:
        assert decontam.words_of(t) == decontam._WORD.findall(t.lower())
    assert decontam.words_of("ab后c 前") == ["ab", "后", "c", "前"]
