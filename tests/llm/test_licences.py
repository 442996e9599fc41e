import random
import re

from quarry.llm import licences

TEXT = """Copyright (c) 2019 Some One
Permission is hereby granted to any organisation, free of charge, to use this
software; the authorised licencee's behaviour is non-binding.

THE SOFTWARE IS PROVIDED "AS IS"."""


def known(spark):
    more = spark.createDataFrame([("toy", TEXT), ("toy-2", TEXT.lower()), ("empty", ""), ("none", None)],
                                 "licence_id string, text string")
    return more.unionByName(licences.known_licences(spark))


def test_whole_texts_and_lines(spark, documents):
    other = TEXT.replace("2019 Some One", "2024 A. N. Other").replace("organisation", "organization").replace(
        "licencee", "licensee").replace("behaviour", "behavior").replace("non-binding", "non binding").replace(
        "\n", " \r\n").upper()
    rows = [(1, TEXT), (2, other), (3, TEXT + "\nand more"), (4, "prose\n  released under the mit licence!\nprose"),
            (5, None), (6, ""), (7, "..."), (7, "..."), (8, "Copyright 2020 me"), (None, "All rights reserved"),
            (9, "x " * 200_000 + "\nAll rights reserved.")]
    d = documents(rows).withColumnRenamed("lang", "whole_text")
    got = licences.scan(d, known(spark))
    assert got.columns == ["doc_id", "text", "source", "n_chars", "licences", "whole_text"]
    seen = sorted(((r.doc_id, tuple(r.licences), tuple(r.whole_text)) for r in got.collect()), key=str)
    assert seen == sorted([
        (1, ("toy", "toy-2"), ("toy", "toy-2")), (2, ("toy", "toy-2"), ("toy", "toy-2")), (3, (), ()),
        (4, ("MIT",), ()), (5, (), ()), (6, (), ()), (7, (), ()), (7, (), ()), (8, (), ()),
        (None, ("proprietary",), ("proprietary",)), (9, ("proprietary",), ())], key=str)


def test_full_texts_and_notices_in_running_text(spark, documents):
    by_name = {p.stem: p.read_text() for p in licences.TEXTS.glob("*.txt")}
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0"} <= set(by_name)
    names = sorted(by_name)
    rows = [(i, " ".join(by_name[n].split()) if "opyright (" not in by_name[n] else by_name[n]) for i, n in enumerate(names)]
    rows += [(100, "The MIT License (MIT)\n\nCopyright (c) 2020 me\n\n" + by_name["MIT"].replace("\n", "\n  ")),
             (101, "Copyright 2021 me\n" + by_name["MIT"] + "\nand more"),
             (102, "This file is licensed under the\n   Apache License,\nVersion 2.0. See there."),
             (103, "prose, released under the MIT license. More prose"), (104, "SPDX-License-Identifier: MIT-0"),
             (105, "unreleased under the MIT license."), (106, by_name["Apache-2.0"].split("APPENDIX")[0]),
             (107, "BSD 2-Clause License\n\nCopyright (c) 2012, A B\nAll rights reserved.\n\n"
                   + by_name["BSD-2-Clause"].replace("1.", "*", 1).replace("2.", "*", 1))]
    got = {r.doc_id: (list(r.licences), list(r.whole_text))
           for r in licences.scan(documents(rows), licences.known_licences(spark)).collect()}
    for i, n in enumerate(names):
        assert n in got[i][0] and got[i][1] == [n], n
    assert got[107][1] == ["BSD-2-Clause"] and got[100] == (["MIT"], ["MIT"]) and got[106][1] == ["Apache-2.0"]
    assert got[102] == (["Apache-2.0"], []) and got[103] == (["MIT"], [])
    assert [got[i] for i in (101, 104, 105)] == [([], [])] * 3


def test_sentences_are_found_by_their_anchors(spark, documents):
    """Against plain search: sentences of one to nine words that share most of their runs."""
    rng = random.Random(2)
    words = ["use", "of", "this", "file", "granted", "under", "terms"]
    some = sorted({" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(60)} - {"of", "use", "this"})
    table = [(f"s{i}", s.capitalize() + ".") for i, s in enumerate(some)] + [("twin", some[0].upper() + " .")]
    texts = [" ".join(rng.choices([*words, "x", "y.", "z\n"], k=rng.randint(0, 60))) for _ in range(120)] + [some[3], None]
    got = licences.scan(documents(texts), spark.createDataFrame(table, "licence_id string, text string")).collect()
    assert len(got) == len(texts)
    hits = 0
    for r in got:
        running = f" {' '.join(re.findall('[a-z]+', r.text or ''))} "
        want = {f"s{i}" for i, s in enumerate(some) if f" {s} " in running} | ({"twin"} if f" {some[0]} " in running else set())
        assert r.licences == sorted(want), r.text
        hits += len(want)
    assert hits > 200


def test_sql_knows_full_texts_and_running_notices(spark, documents, tmp_path):
    """Every known row with changed wrapping, and notices inside lines and over line breaks."""
    import duckdb

    from quarry.llm.queries import ORACLES, op5_licences

    rows = [r.text for r in licences.known_licences(spark).collect()]
    rows += ["Copyright 2020 me\n" + "\n  ".join(t.upper().split("\n")) for t in rows]
    rows += [f"prose {t} prose" for ts in licences.NOTICES.values() for t in ts]
    rows += ["this is licensed under the\n Apache License,\nVersion 2.0. See", "all rights\nreserved", "", None, "un" + rows[0]]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(ORACLES["op5_licences"]).fetchall())
    got = sorted(tuple(r) for r in op5_licences(spark, str(tmp_path)).collect())
    assert got == want and sum(r[3] for r in got) > 100 and sum(r[1] > 0 for r in got) > 130


def test_empty_tables(spark, documents):
    assert licences.scan(documents([]), known(spark)).count() == 0
    got = licences.scan(documents(["All rights reserved."]), known(spark).limit(0)).collect()
    assert [(list(r.licences), list(r.whole_text)) for r in got] == [([], [])]


def test_plan_has_no_python(spark, sf_small):
    from quarry.llm.queries import op5_licences

    plan = op5_licences(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Arrow", "Python", "NestedLoop", "Cartesian"))
