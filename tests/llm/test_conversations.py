import hashlib
import itertools
import random
import zlib

import pytest

from quarry.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, n long, audit string, Kind string"


def damaged(rows):
    """The damage of the contract, row by row."""
    out = []
    for conv, turn, role, text in rows:
        key = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if key == 1:
            text = ""
        if key == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        out += [] if key == 0 else [(conv, turn, "user" if key == 4 else role, text)] * (2 if key == 3 else 1)
    return out


def faults(rows):
    """(flags of each row, counts) by reading the rows once."""
    flags, seen, count = [], set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        flags.append(fault)
        if fault:
            count[fault] += 1
    return flags, count


def brute(rows):
    """Plain dynamic programme over (rows read, roles so far as a state), no agenda."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    flags, count = faults(rows)
    states = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def closed(best):  # any number of inserts
        for _ in range(4):
            for q, (c, a) in list(best.items()):
                for r in "ua":
                    if r in states[q] and (c + 3, a + "I") < best.get(states[q][r], (c + 4, "")):
                        best[states[q][r]] = (c + 3, a + "I")
        return best

    best = closed({"": (0, "")})
    for (_, _, role, _), fault in zip(rows, flags, strict=True):
        new = {}
        extra = 3 if fault == "truncated" else 0
        for q, (c, a) in best.items():
            options = [(c + 4, a + "D", q)]
            if fault not in ("blank", "duplicate"):
                if role[:1] in states[q]:
                    options.append((c + extra, a + "K", states[q][role[:1]]))
                options += [(c + 3 + extra, a + "R", states[q][r]) for r in "ua" if r in states[q]]
            for c2, a2, q2 in options:
                if q2 not in new or (c2, a2) < new[q2]:
                    new[q2] = (c2, a2)
        best = closed(new)
    cost, audit = min(best[q] for q in ("", "a") if q in best)
    length = len(audit) - audit.count("D")
    todo, out = iter(rows), []
    for e in audit:
        row = None if e == "I" else next(todo)
        if e == "D":
            continue
        place = ("user", "assistant")[(len(out) - length % 2) % 2]
        out.append((row[2] if e == "K" else place, row[3] if row else ""))
    initials = "".join(r[:1] for r, _ in out)
    assert initials in ("", "s" * (length % 2) + "ua" * (length // 2))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(x[2][:1] + y[2][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(rows))
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
            hashlib.sha256(text.encode()).hexdigest())


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in damaged(rows) if r[0] == conv]
        out[conv] = brute(own) if own else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return out


def query(spark, tmp_path, rows, schema=SCHEMA):
    from quarry.llm.queries import op11_repair

    width = len(schema.split(","))
    data = [(*r, *[None] * (width - 4)) for r in rows]
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op11_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    seen = {r[0]: tuple(r[1:]) for r in got.collect()}
    return seen


def random_rows(rng, convs, longest):
    rows = []
    for conv in range(convs):
        turns = rng.sample(range(longest * 2), rng.randrange(1, longest + 1))
        for t in turns:
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "ux", None])
            text = rng.choice(["One.", "Two!", "Three? \n", "cut", "", " \t", "é.", "Four...", None, f"text {t}."])
            rows.append((conv, rng.choice([t, t, t, None]), role, text))
    return rows


def test_query_against_brute_force(spark, tmp_path):
    rows = random_rows(random.Random(1), 120, 9)
    assert query(spark, tmp_path, rows) == expected(rows)


def test_long_and_copied_conversations(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(C, "BLOCK", 8)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), f"Turn {t % 90}.") for t in range(700)]
    rows += [(8, 5, "user", "Same.")] * 300 + [(8, 6, "assistant", "cut")] * 2 + [(9, None, "user", "x" * 300_000)]
    rows += [(None, 1, "user", "A."), (None, 2, "assistant", "B."), (10, 2**62, "user", "A."), (10, -2**62, "assistant", "B.")]
    assert query(spark, tmp_path, rows) == expected(rows)


def test_every_small_conversation():
    """The agenda against the plain programme, in one span and as joined pieces."""
    options = [("u", 0), ("a", 0), ("s", 0), ("t", 3), ("u", 3), ("D", 1), ("D", 2)]
    for n in range(1, 5):
        for steps in itertools.product(options, repeat=n):
            whole = C.lightest([list(steps)])
            assert whole == C.lightest([[s] for s in steps])
            cut = n // 2
            parts = [C.lightest([list(p)], range(4), whole=False) for p in (steps[:cut], steps[cut:]) if p]
            assert whole == C.lightest(parts)
            rows = []
            for k, (initial, weight) in enumerate(steps):
                rows += [(0, k, "", "")] * weight if initial == "D" else [(0, k, initial, f"{k}" + "" if weight else f"{k}.")]
            assert whole == brute(rows)[5:7]


def test_pieces_of_many_tasks(spark):
    """A conversation that the ranges cut gives what one task gives."""
    rng = random.Random(3)
    rows = [(1, t // 2, rng.choice(["user", "assistant", "system"]), f"Turn {t % 70}" + ".?x"[t % 3]) for t in range(400)]
    rows += [(2, 1, "user", "A."), (2, 2, "assistant", "B."), (0, 3, "user", "C.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done, repaired = C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        shas = {r.conv_id: r.sha256 for r in C.digests(repaired).collect()}
        for r in done.collect():
            assert (*tuple(r)[1:], shas[r.conv_id]) == brute([x for x in rows if x[0] == r.conv_id])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("schema", ["conv_id string, turn string, role string, text string"])
def test_ids_of_other_types(spark, tmp_path, schema):
    rows = [("a", "2", "user", "x."), ("a", "10", "assistant", "y."), ("b", "one", "user", "cut")]
    got = query(spark, tmp_path, rows, schema)
    want = expected([(c, int(t), r, x) for c, t, r, x in rows if t != "one"])
    assert {k: v for k, v in got.items() if k != "b"} == want and got["b"][0] == 0


def test_empty_table(spark, tmp_path):
    assert query(spark, tmp_path, []) == {}


def test_registered_table(spark, sf_small):
    from quarry.llm.queries import op11_repair

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r[1:]) for r in op11_repair(spark, sf_small).collect()} == expected(rows)
