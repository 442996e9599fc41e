import pytest
import xxhash

from quarry.llm import urls
from quarry.llm.queries import ORACLES, URL_RULES


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len((h + p).encode()), h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and host and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


URLS = [None, "", "no scheme", "http://", "http://example.com", "http://example.com/", "HTTP://WWW.Example.COM/en/x",
        "http://a.example.com/en/?q=/fr/", "https://x.net/fr", "https://x.net/fr/", "https://net/es/a#b",
        "http://notexample.com/en/a", "http://example.com?x=/en/", "http://u@example.com/en/", "a://b://c.net/fr/",
        "http://example.com/en/\nsecond", "http://é.com/ü/", "http://.com/", "http://com/", "x" * 5000 + "://y.net/es/" + "z" * 9000]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS + URLS[:5])], "page_id long, url string, rule string")
    got = urls.filter_urls(df, URL_RULES)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    for r in got.collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, URL_RULES), r.url
    assert urls.filter_urls(df.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in urls.filter_urls(df, []).collect()} == {"allow"}


def test_many_rules_and_path_prefixes(spark, tmp_path):
    rules = [(f"h{i}.org", f"/{'p' * (i % 9)}", "block" if i % 2 else "allow") for i in range(2000)]
    names = [f"http://s.h{i}.org/{'p' * (i % 11)}/x" for i in range(0, 2300, 7)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(names)], "page_id long, url string")
    for r in urls.filter_urls(df, rules).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, rules)


def test_equal_digests_are_told_apart(monkeypatch, tmp_path):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda s, *a: len(s) % 3)
    path = tmp_path / "r"
    path.write_bytes(urls.compile_rules(URL_RULES + [("zet", "/es/", "block")]))
    array = urls.RuleArray(str(path))
    assert array.judge([b"net", b"zet", b"ket"], [b"/es/1"] * 3) == [("net/es/", "block"), ("zet/es/", "block"), None]


@pytest.mark.parametrize("name", ["op5_licences", "op6_urls"])
def test_queries_match_their_sql(spark, sf_small, name):
    from quarry.llm.queries import QUERIES
    from quarry.plans.verify import digest, duck_connection

    got = QUERIES[name](spark, sf_small)
    rel = duck_connection(sf_small).execute(ORACLES[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(got.columns)
    rows = [tuple(r) for r in got.collect()]
    assert digest(got.columns, rows) == digest(cols, rel.fetchall())
