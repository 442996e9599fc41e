import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from quarry.llm import line_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered))


def normal(line):
    return re.sub(r"[\x20\x09\x0B-\x0D]+", " ", re.sub("[1-9]", "0", line.lower())).strip(" ")


def brute_verdicts(rows, hash_line, min_docs=20, share=0.05, left_share=0.2):
    """kept and removed words of (text, host) rows by the module's definition."""
    per, docs = defaultdict(set), defaultdict(set)
    for text, host in rows:
        words = WORD.findall(text or "")
        if not words:
            continue
        pairs = {xxh(b, xxh(a)) for a, b in zip(words, words[1:])} or {xxh(words[0])}
        sig = tuple(sorted(map(signed, pairs))[:8])
        docs[host or ""].add(sig)
        for n in map(normal, text.split("\n")):
            if n:
                per[host or "", hash_line(n)].add(sig)
    often = {k for k, sigs in per.items() if len(sigs) > min_docs and len(sigs) > share * len(docs[k[0]])}
    out = []
    for text, host in rows:
        n, _, _, _, rep = brute_counts(text)
        gone = sum(len(normal(x).split(" ")) for x in (text or "").split("\n")
                   if normal(x) and (host or "", hash_line(normal(x))) in often)
        failed = n < 50 or 100 * rep > 50 * n
        out.append((gone, failed, not failed and (n - gone) * 100 >= n * int(100 * left_share)))
    return out


def xxh(word, seed=42):
    return xxhash.xxh64_intdigest(word.encode(), seed)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def md5_60(line):
    import hashlib

    return int(hashlib.md5(line.encode()).hexdigest()[:15], 16)


def sample():
    rng = random.Random(3)
    words = ["w%d" % i for i in range(5000)] + ["a#b", "é|ü", "x<y>"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(None, "a"), ("", "a"), (" \n\t ", "b"), ("one", None), ("a b c a b c", "b"), ("x " * 300, "a"),
            ("p q r s " * 2 + "t u v", "b"), ("  lead\x0b\x0ctail  \n\n", "b")]
    menu = ["Page 11 of  77: Read More"] + [" ".join(f"m{k}{j}" for j in "abcdefghijkl") for k in "vwxyz"]
    for i in range(10, 199):
        lines = [prose(rng.randint(1, 25)) for _ in range(rng.randint(4, 12))]
        if i % 2:
            lines += [menu[0].replace("11", str(i)), *menu[1:]]
        if i % 16 == 1:
            lines = [*menu, f"tiny {i}"]
        rows.append(("\n".join(lines), "a" if i % 5 else None))
    rows += [("\n".join(prose(12) for _ in range(6)), "c")] * 40  # exact copies count once
    return rows


def test_counts_and_verdicts_against_brute_force(documents):
    rows = sample()
    got = line_rules.judge(documents([(i, t, h) for i, (t, h) in enumerate(rows)])).collect()
    want = brute_verdicts(rows, md5_60)
    assert len(got) == len(rows) and any(w[0] for w in want) and any(not w[1] and not w[2] for w in want)
    for r in got:
        q = r.quality
        assert tuple(q[c] for c in line_rules.COUNTS) == brute_counts(rows[r.doc_id][0]), rows[r.doc_id]
        assert (q.n_removed_words, q.base_failed, q.kept) == want[r.doc_id], rows[r.doc_id]


def test_documents_of_common_words_count_one_by_one(documents):
    rng = random.Random(5)
    common = ["are", "the", "and", "of"] + ["c%d" % i for i in range(150)]
    foot = [" ".join(f"foot{k}{j}" for j in "abcdefghij") for k in "xyz"]
    rows = []
    for i in range(300):  # every text holds every common word; 40 and 12 hold a line, 100 are half boilerplate
        words = [*common, *rng.choices(common, k=60)]
        rng.shuffle(words)
        lines = [" ".join(words[j:j + 12]) for j in range(0, len(words), 12)]
        lines += ([foot[0]] if i < 40 else []) + ([foot[1]] if 40 <= i < 52 else []) + (
            [f"{foot[2]} {k}x" for k in "abcdefghijklmnopqrst"] if 200 <= i else [])
        rows.append(("\n".join(lines), "h"))
    rows += rows[45:46] * 30  # exact copies count once
    per, texts = defaultdict(set), {t for t, _ in rows}
    for t in texts:
        for n in set(map(normal, t.split("\n"))):
            per[n].add(t)
    often = {n for n, held in per.items() if len(held) > 20 and len(held) > 0.05 * len(texts)}
    assert foot[0] in often and foot[1] not in often and len(often) == 21
    got = line_rules.judge(documents([(i, t, h) for i, (t, h) in enumerate(rows)])).collect()
    for r in got:
        assert r.quality.n_removed_words == sum(len(n.split(" ")) for n in map(normal, r.text.split("\n")) if n in often)


def test_near_copies_share_signatures(documents):
    rng = random.Random(4)
    base = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(12)) for _ in range(10)]
    rows = []
    for i in range(200):
        lines = list(base)
        lines[rng.randrange(10)] += f" edit{i}"
        rows.append((i, "\n".join(lines), "host"))
    for i in range(300):
        rows.append((1000 + i, "\n".join(" ".join("".join(rng.choices("ijklmnop", k=6)) for _ in range(12)) for _ in range(6)), "host"))
    judged = line_rules.judge(documents(rows), share=0.1)
    assert judged.filter("quality.kept").count() == 500


def test_query_against_brute_force(spark, sf_small, documents, tmp_path):
    """The given table, and below it the rows above, which hold frequent lines."""
    from quarry.llm.queries import op7_line_rules

    own = documents([(10_000 + i, t, h) for i, (t, h) in enumerate(sample())])
    given = spark.read.parquet(f"{sf_small}/documents.parquet")
    given.select("doc_id", "text", "source").unionByName(own.select("doc_id", "text", "source")).write.parquet(
        str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).collect()
    want = dict(zip([d.doc_id for d in docs], brute_verdicts([(d.text, d.source) for d in docs], md5_60)))
    text = {d.doc_id: d.text for d in docs}
    got = op7_line_rules(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and any(w[0] for w in want.values())
    for r in got:
        assert tuple(r[c] for c in line_rules.COUNTS) == brute_counts(text[r.doc_id])
        assert (r.n_removed_words, r.base_failed, r.kept) == want[r.doc_id]


def test_clean_cuts_lines_and_keeps_columns(documents):
    rows = sample()
    d = documents([(i, t, h) for i, (t, h) in enumerate(rows)])
    d = d.withColumn("quality", d.lang).withColumn("_text", d.lang)
    got = line_rules.clean(d)
    assert got.columns == d.columns
    kept = {i for i, w in enumerate(brute_verdicts(rows, md5_60)) if w[2]}
    out = got.collect()
    assert {r.doc_id for r in out} == kept
    for r in out:
        assert not any(normal(x).startswith("mva mvb") for x in r.text.split("\n")) or rows[r.doc_id][1] != "a"
        assert r.n_chars == len(r.text) and r.quality == "en"
    assert line_rules.clean(documents([])).count() == 0


@pytest.mark.parametrize("rows", [[(1, "x y\nx y"), (1, "x y\nx y")], [(None, "a " * 60)]])
def test_repeated_rows_and_null_ids(documents, rows):
    got = line_rules.judge(documents(rows)).collect()
    assert [tuple(r.quality[c] for c in line_rules.COUNTS) for r in got] == [brute_counts(t) for _, t in rows]


def test_plan_has_no_python(spark, sf_small):
    from quarry.llm.queries import op7_line_rules

    plan = op7_line_rules(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
