"""Registered queries of this subpackage and their DuckDB SQL.

Each query applies one operator to its whole table and derives the contract's columns
from the operator's results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, conversations, decontam, gam, licences, line_rules, lm, mtree, simhash, suffixes, urls, warc
from .common import fold_of, table

#: The URL rules of the registered query: (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: Words of the language model's longest sequences.
ORDER = 3


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    d = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return d.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id")


def op2_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    s = gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda i: fold_of(i) == 0)
    return s.select(F.col("id").alias("doc_id"), (fold_of(F.col("id")) == 0).alias("held_out"), "score",
                    (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to WARC archives and read them back."""
    got = warc.round_trip(table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that every document holds a passage of."""
    d = decontam.mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", (F.size("overlaps") > 0).alias("contaminated"),
                    F.col("overlaps.item_id").alias("item_ids"),
                    F.coalesce(F.array_max("overlaps.words"), F.lit(0)).alias("overlap_words"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that every document names or is."""
    d = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), licences.known_licences(spark))
    return d.select("doc_id", F.size("licences").alias("n_licences"), F.array_join("licences", ",").alias("licences"),
                    (F.size("whole_text") > 0).alias("whole_text"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page url."""
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of every document."""
    q = line_rules.judge(table(spark, sf_dir, "documents"))
    return q.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in
                                [*line_rules.COUNTS, "n_removed_words", "base_failed", "kept"]])


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, digested, and the decoded text, digested."""
    e = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), word_bpe_path())
    return e.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
                    F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated 200-byte strings."""
    c = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return c.select("doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans",
                    F.sha2("cut.left", 256).alias("kept_sha256"))


def op10_trie_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document; one fold is held out of the training."""
    s, facts = lm.fit_score(table(spark, sf_dir, "documents"), fold_of(F.col("doc_id")) != 1, order=ORDER)
    return s.select(F.col("id").alias("doc_id"), (fold_of(F.col("id")) == 1).alias("held_out"), "n_tokens", "n_known",
                    F.lit(facts["train_tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of the repaired text of every damaged conversation."""
    rows = table(spark, sf_dir, "conversations")
    done, repaired = conversations.repair(conversations.damage(rows))
    ids = rows.select(F.col("conv_id").alias("c")).distinct()
    same = F.col("c").eqNullSafe(F.col("conv_id"))
    got = ids.join(done, same, "left").drop("conv_id").join(conversations.digests(repaired), same, "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return got.select(F.col("c").alias("conv_id"), *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in counts],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows by integer inner product for every query vector."""
    rows = mtree.scaled(table(spark, sf_dir, "embeddings"), scale=64)
    return mtree.top_k(rows, F.col("vec_id") % 20 == 0, k=20)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two and three words of every language."""
    got = collocations.collocations(table(spark, sf_dir, "documents"), min_count=10, depth=3, share=50, top=2000)
    return got.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash, "op2_gam": op2_gam, "op3_warc": op3_warc, "op4_decontam": op4_decontam, "op5_licences": op5_licences,
    "op6_urls": op6_urls, "op7_line_rules": op7_line_rules, "op8_bpe": op8_bpe,
    "op9_suffixes": op9_suffixes, "op10_trie_lm": op10_trie_lm, "op11_repair": op11_repair,
    "op12_mtree": op12_mtree, "op13_collocations": op13_collocations,
}

def _licence_sql() -> str:
    line = "lower(x)"
    for old, new in licences.SPELLINGS:
        line = f"regexp_replace({line}, '{old}', '{new.replace('$', chr(92))}', 'g')"
    line = f"trim(regexp_replace({line}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

    def canon(text):
        kept = f"list_filter(string_split({text}, chr(10)), lambda x: NOT regexp_matches(lower(x), '{licences.COPYRIGHT}'))"
        return f"list_filter(list_transform({kept}, lambda x: {line}), lambda x: x <> '')"

    def joined(lines):
        text = f"array_to_string({lines}, ' ')"
        for old, new in licences.SPELLINGS:
            if " " in old:
                text = f"regexp_replace({text}, '{old}', '{new}', 'g')"
        return text

    def values(rows):
        return "(VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows) + ")"

    notices = values((k, t) for k, ts in licences.NOTICES.items() for t in ts)
    texts = values((f.stem, f.read_text(encoding="utf-8")) for f in sorted(licences.TEXTS.glob("*.txt")))
    titles = values((k, t) for k, ts in licences.TITLES.items() for t in ["", *ts])
    end = "END OF TERMS AND CONDITIONS"
    return f"""
WITH notices AS (SELECT id, text FROM {notices} v(id, text)),
full_texts AS (SELECT id, text FROM {texts} v(id, text)),
bodies AS (SELECT id, text FROM full_texts
           UNION ALL SELECT id, substr(text, 1, strpos(text, '{end}') - 1) FROM full_texts WHERE contains(text, '{end}')
           UNION ALL SELECT id, substr(text, 1, strpos(text, '{end}') + {len(end) - 1}) FROM full_texts WHERE contains(text, '{end}')
           UNION ALL SELECT id, regexp_replace(text, '(?m)^\\s*[0-9]\\.', '*', 'g') FROM full_texts WHERE starts_with(id, 'BSD')),
titles AS (SELECT id, title FROM {titles} v(id, title)),
wholes AS (SELECT id, text FROM notices UNION ALL SELECT id, text FROM bodies
           UNION ALL SELECT id, title || chr(10) || text FROM bodies JOIN titles USING (id)
           UNION ALL SELECT id, title || chr(10) || 'All rights reserved.' || chr(10) || text FROM bodies JOIN titles USING (id)),
canon AS (SELECT id, text, {canon('text')} AS lines FROM wholes),
known AS (SELECT DISTINCT id, md5({joined('lines')}) AS digest FROM canon),
sentences AS (SELECT DISTINCT id, ' ' || {joined('lines')} || ' ' AS sentence FROM canon
              WHERE len(lines) = 1 AND ends_with(rtrim(text), '.')),
d AS (SELECT doc_id, {canon("coalesce(text, '')")} AS lines FROM documents),
u AS (SELECT doc_id, true AS whole, md5({joined('lines')}) AS digest FROM d WHERE len(lines) > 0
      UNION ALL SELECT doc_id, false, md5(x) FROM (SELECT doc_id, unnest(lines) AS x FROM d)),
hits AS (SELECT DISTINCT doc_id, whole, id FROM u JOIN known USING (digest)
         UNION SELECT doc_id, false, id FROM (SELECT doc_id, ' ' || {joined('lines')} || ' ' AS running FROM d) r
               JOIN sentences ON contains(running, sentence)),
per AS (SELECT doc_id, list_sort(list(DISTINCT id)) AS ids, bool_or(whole) AS whole FROM hits GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ids), 0)::INTEGER AS n_licences, coalesce(array_to_string(ids, ','), '') AS licences,
       coalesce(per.whole, false) AS whole_text
FROM d LEFT JOIN per USING (doc_id)"""


def _url_sql() -> str:
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return f"""
WITH r AS (SELECT page_id, coalesce({rest}, '') AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(rh, rp, rv) AS (VALUES {rules}),
m AS (SELECT page_id, host, path, rh || rp AS rule, rv FROM p LEFT JOIN rules
      ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM m
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1"""


#: Phrases counted from word lists, cut by list slices; products are HUGEINT.
COLLOCATION_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?' || chr(11) || chr(12) || chr(13) || chr(9),
           'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 9) || ' ') AS t FROM documents),
p AS (SELECT lang, unnest(string_split(t, chr(10))) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split(piece, ' '), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
      UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
      UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1),
                                       lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
c AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f FROM c WHERE k > 1 AND f >= 10),
halves AS (SELECT lang, k, phrase, f, i, array_to_string(ws[1:i], ' ') AS p1, array_to_string(ws[i + 1:k], ' ') AS p2
           FROM cand JOIN (VALUES (1), (2)) s(i) ON i < k),
cut AS (SELECT x.lang, x.k, x.phrase, x.f AS a, x.i, le.f AS l, ri.f AS r, 1000000 * x.f * x.f // (le.f * ri.f) AS score
        FROM halves x JOIN c le ON le.lang = x.lang AND le.phrase = x.p1
        JOIN c ri ON ri.lang = x.lang AND ri.phrase = x.p2),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
inner_pairs AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, f
                FROM cand WHERE k = 3),
covers AS (SELECT lang, phrase, max(f) AS longer FROM inner_pairs GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN covers USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""

#: All pairs of queries and rows; their vectors have one length.
SEARCH_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e, row_number() OVER () AS row_no
           FROM embeddings WHERE embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row_no, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.row_no <> c.row_no WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20"""

ORACLES: dict[str, str] = {"op5_licences": _licence_sql(), "op6_urls": _url_sql(), "op12_mtree": SEARCH_SQL,
                           "op13_collocations": COLLOCATION_SQL}
