import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from quarry.llm import suffixes


def brute(texts, length):
    """(bytes left, removed, runs) of each text, by counting all windows."""
    starts = defaultdict(int)
    for t in texts:
        for i in range(len(t) - length + 1):
            starts[t[i:i + length]] += 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if starts[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        left = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((left, sum(gone), runs))
    return out


@pytest.mark.parametrize("data", [b"", b"a", b"aaaa" * 30, b"abcab\0\0\0" * 20 + b"\0", bytes(range(256)) * 3,
                                  b"mississippi" * 13])
def test_suffix_array_and_prefixes(data):
    rng = random.Random(1)
    for x in (data, data + bytes(rng.choice(b"ab") for _ in range(200))):
        arr = np.frombuffer(x, dtype=np.uint8)
        sa = suffixes.suffix_array(arr)
        assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
        want = [0] * len(x)
        for j in range(1, len(x)):
            a, b = x[sa[j - 1]:], x[sa[j]:]
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            want[j] = n
        assert suffixes.common_prefixes(arr, sa).tolist() == want


def test_every_window_has_one_anchor_and_equal_windows_share_it():
    rng = random.Random(2)
    block = bytes(rng.choice(b"abcd ") for _ in range(300))
    texts = [block + b"x" * 150, b"", b"yy" + block, b"ab" * 200, bytes(rng.randrange(256) for _ in range(500)), b"s" * 199]
    length = 100
    who, s, n, h, c = suffixes.anchors(texts, length)
    seen = {}
    for w, a, k, v in zip(who.tolist(), s.tolist(), n.tolist(), h.tolist()):
        for i in range(a, a + k):
            assert (w, i) not in seen
            seen[w, i] = v
    assert set(seen) == {(w, i) for w, t in enumerate(texts) for i in range(len(t) - length + 1)}
    by = defaultdict(set)
    for (w, i), v in seen.items():
        by[texts[w][i:i + length]].add(v)
    assert all(len(x) == 1 for x in by.values())


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, long = prose(90), prose(400)
    docs = [prose(rng.randint(1, 200)) for _ in range(25)]
    docs += [prose(40) + passage + prose(rng.randint(0, 50)) for _ in range(8)]
    for _ in range(40):  # near copies: one word changed, each in its place
        w = long.split()
        w[rng.randrange(len(w))] = rng.choice(words) + "X"
        docs.append(" ".join(w))
    docs += ["echo " * 150, "", "a" * 700, "b" * 199, passage, passage, None]
    return docs


@pytest.mark.parametrize("spans", [2000, 3])
def test_against_brute_force(spark, documents, spans):
    texts = corpus(spans)
    want = brute([(t or "").encode() for t in texts], 200)
    got = suffixes.remove_repeats(documents(texts), anchor_spans=spans, shard_bytes=20_000).collect()
    assert len(got) == len(texts)
    for r in got:
        left, gone, runs = want[r.doc_id]
        assert (bytes(r.cut.left), r.cut.n_removed, r.cut.n_spans, r.cut.n_bytes) == (
            left, gone, runs, len((texts[r.doc_id] or "").encode())), r.doc_id


def test_awkward_rows(spark, documents):
    long = " ".join(f"w{i}" for i in range(30000))
    d = documents([(1, long), (None, "zé" * 150), (1, "other " + "q" * 30), (2, "short"), (2, "short"), (3, None)])
    d = d.withColumn("cut", d.lang).withColumn("_k1", d.doc_id)
    got = suffixes.clean(d)
    assert got.columns == d.columns
    rows = {(r.doc_id, r.text, r.n_chars, r.cut) for r in got.collect()}
    assert rows == {(1, long, len(long), "en"), (None, "", 0, "en"), (1, "other " + "q" * 30, 36, "en"),
                    (2, "short", 5, "en"), (3, None, None, "en")}
    assert got.count() == 6
    assert suffixes.remove_repeats(documents([])).count() == 0


def test_query_against_brute_force(spark, sf_small):
    from quarry.llm.queries import op9_suffixes

    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: (w[1], w[2], hashlib.sha256(w[0]).hexdigest())
            for d, w in zip(docs, brute([d.text.encode() for d in docs], 200))}
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in op9_suffixes(spark, sf_small).collect()}
    assert got == want


def test_replacement_characters_of_the_text_stay(documents):
    same = "ü" + "".join(chr(97 + i * 7 % 26) for i in range(230)) + "ü"
    d = documents([(1, f"a\ufffd\ue000b\ue000 {same} \ufffdz"), (2, f"{same[1:-1]}")])
    got = {r.doc_id: r.text for r in suffixes.clean(d, length=200).collect()}
    assert got == {1: "a\ufffd\ue000b\ue000 üü \ufffdz", 2: ""}
