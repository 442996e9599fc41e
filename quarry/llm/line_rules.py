"""Quality rules over whole texts, with cross-document line frequency (native).

Base rules are counted inside each row; line frequency needs the corpus. Lines are
normalised (lower case, digits made 0, words joined by one space) and hashed. Per host
the distinct documents of a line are counted, and a line above both limits (``min_docs``
documents and ``share`` of the host's documents) is removed wherever the host has it. A
document that keeps less than ``left_share`` of its words is depleted and rejected.

*Distinct* documents: a document is known by a signature of its whole text, the ``SKETCH``
smallest hashes of its 2-word shingles. Exact copies have equal ones, near copies mostly do
(two texts with a share J of common shingles with about J ** SKETCH), and documents that
share common words or some lines differ: of pages that are half boilerplate about one in
250 counts as a copy, of pages that are nine tenths boilerplate 43 %. Without this a text
that a site merely holds many copies of would look like boilerplate, and no copy of it
would be left.

Scale: the counts are pre-aggregated (line, document signature) pairs, so a line that a
third of all documents hold is spread over as many keys as it has documents before it is
counted with partial sums. A removed line is in more than ``share`` of its host's
documents, so a host has at most (its lines per document) / ``share`` of them: one short
array per host. Documents are never shuffled by text or line.

Nulls: a null text has no words (and fails the base rules); null hosts form one host.
Empty and blank texts have zero counts. Repeated rows are judged alike, and count once.
Empty tables give empty results. No Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, col, free_name, staged

BLANKS = " \t\n\x0b\x0c\r"
#: Fixed value: hashes in a document's signature.
SKETCH = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often it is used."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK + "+"))


def window_hashes(words: Column) -> Column:
    """Hash of the 3-word window that ends at each word from the third on (bound array)."""
    return F.transform(F.sequence(F.lit(2), F.size(words) - 1), lambda i: F.xxhash64(
        F.get(words, i - 2), F.get(words, i - 1), F.get(words, i)))


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more (``words``: a bound array).

    Most texts repeat no window, which a set of the hashes tells. In others the hashes are
    sorted with their places; a window repeats if a neighbour has its hash, and adds the
    words that the repeated window before it doesn't cover.
    """
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("struct<h:bigint,i:int>")

    def places(hashes):
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return bind(pairs, lambda s: F.array_sort(F.transform(F.filter(F.arrays_zip(
            s.alias("x"), F.concat(F.array(none), s).alias("p"),
            F.concat(F.slice(s, 2, F.size(s)), F.array(none)).alias("n")),
            lambda z: z["x"].isNotNull() & (F.coalesce(z["x"]["h"] == z["p"]["h"], F.lit(False))
                                            | F.coalesce(z["x"]["h"] == z["n"]["h"], F.lit(False)))),
            lambda z: z["x"]["i"])))

    def covered(hashes):
        return F.aggregate(places(hashes), F.struct(zero.alias("n"), F.lit(-3).alias("last")), lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])

    several = bind(window_hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero)
                   .otherwise(covered(h)))
    return F.when(F.size(words) < 4, zero).otherwise(several)


def base_counts(text: Column) -> Column:
    """Struct of COUNTS for one text (null counts as empty)."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = bind(words_of(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeat_words(w).alias("n_repeat_words")))
    n_dup = bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    n_symbols = (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long")
    return bind(of_words, lambda w: F.struct(
        w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), n_symbols.alias("n_symbols"),
        n_dup.alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words")))


def normal_lines(text: Column) -> Column:
    """The lines, lower case, digits made 0, words joined by one space; blank ones empty."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[1-9]", "0")
    t = F.regexp_replace(t, r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")
    return F.transform(F.split(t, "\n"), lambda x: F.btrim(x))


def line_hash(line: Column) -> Column:
    """The first 60 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("bigint")


def signature(text: Column) -> Column:
    """Hash of the SKETCH smallest hashes of the text's 2-word shingles; null without words."""
    def shingles(w):
        return F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(
            F.get(w, i), F.get(w, i + 1)))).when(F.size(w) == 1, F.array(F.xxhash64(w[0])))

    least = F.slice(F.sort_array(F.array_distinct(bind(words_of(text), shingles))), 1, SKETCH)
    return bind(least, lambda x: F.when(x.isNotNull(), F.xxhash64(x)))


def frequent_lines(docs: DataFrame, text_col: str, host_col: str, min_docs: int, share: float,
                   identity=signature) -> DataFrame:
    """(host, frequent): per host the hashes of the lines above both limits.

    Documents with equal ``identity(text)`` count once."""
    host = F.coalesce(col(host_col).cast("string"), F.lit("")).alias("host")
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    d = docs.select(host, identity(text).alias("sig"),
                    F.array_distinct(F.transform(F.filter(normal_lines(text), lambda x: x != ""), line_hash)).alias("hs"))
    d = staged(d.filter(F.col("sig").isNotNull()), "line-hashes")
    total = d.select("host", "sig").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    seen = d.select("host", "sig", F.explode("hs").alias("h")).distinct()
    lines = seen.groupBy("host", "h").agg(F.count("*").alias("n"))
    often = lines.filter(F.col("n") > min_docs).join(total, "host").filter(F.col("n") > F.col("docs") * F.lit(share))
    return staged(often.groupBy("host").agg(F.collect_list("h").alias("frequent")), "frequent-lines")


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_docs: int = 20,
          share: float = 0.05, left_share: float = 0.2, min_words: int = 50, max_repeat: float = 0.5,
          only_kept: bool = False, identity=signature) -> DataFrame:
    """``docs`` with one struct column ``quality``: COUNTS, n_removed_words, base_failed,
    depleted, kept, and frequent (the host's frequent lines). A column of that name is
    replaced. With ``only_kept`` the rejected documents go."""
    freq = frequent_lines(docs, text_col, host_col, min_docs, share, identity)
    keep = [col(c) for c in docs.columns if c.lower() != "quality"]
    h, f, t = (free_name(docs, x) for x in ("_host", "_frequent", "_text"))
    d = docs.select(*keep, col(text_col).cast("string").alias(t),
                    F.coalesce(col(host_col).cast("string"), F.lit("")).alias(h))
    # one row per host that has such lines; its written table tells Spark if it can be sent
    d = d.join(freq.select(F.col("host").alias(h), F.col("frequent").alias(f)), h, "left")
    zero = F.lit(0).cast("bigint")
    gone = F.when(col(f).isNull(), zero).otherwise(F.aggregate(
        F.filter(normal_lines(col(t)), lambda x: (x != "") & F.array_contains(col(f), line_hash(x))), zero,
        lambda acc, x: acc + F.size(F.split(x, " "))))

    def verdict(b):
        c, left = b["c"], b["c"]["n_words"] - b["gone"]
        failed = (c["n_words"] < min_words) | (c["n_repeat_words"] * 100 > c["n_words"] * int(100 * max_repeat))
        depleted = left * 100 < c["n_words"] * int(100 * left_share)
        return F.struct(*[c[x].alias(x) for x in COUNTS], b["gone"].alias("n_removed_words"),
                        failed.alias("base_failed"), depleted.alias("depleted"), (~failed & ~depleted).alias("kept"),
                        b["f"].alias("frequent"))

    q = bind(F.struct(base_counts(col(t)).alias("c"), gone.alias("gone"), col(f).alias("f")), verdict)
    if only_kept:  # a filter would be pushed below the projection and compute it all twice
        q = F.explode(F.filter(F.array(q), lambda x: x["kept"]))
    return d.select(*keep, q.alias("quality"))


def without_lines(text: Column, frequent: Column) -> Column:
    """``text`` without the lines whose hash is in ``frequent``."""
    return F.array_join(F.transform(F.filter(
        F.arrays_zip(F.split(text, "\n").alias("line"), normal_lines(text).alias("normal")),
        lambda z: ~F.array_contains(frequent, line_hash(z["normal"]))), lambda z: z["line"]), "\n")


def clean(docs: DataFrame, **how) -> DataFrame:
    """The documents that are kept, without frequent lines; columns as in ``docs``.

    ``n_chars``, where there is one, follows the text.
    """
    text_col = how.get("text_col", "text")
    q = free_name(docs, "_q")
    d = judge(docs.withColumnsRenamed({c: q for c in docs.columns if c.lower() == "quality"}), only_kept=True, **how)
    cut, left = F.col("quality.n_removed_words") > 0, without_lines(col(text_col), F.col("quality.frequent"))
    new = []
    for c in docs.columns:
        old = col(q if c.lower() == "quality" else c)
        if c == text_col:
            old = F.when(cut, left).otherwise(old)
        elif c == "n_chars":
            old = F.when(cut, F.length(left).cast(docs.schema[c].dataType)).otherwise(old)
        new.append(old.alias(c))
    return d.select(*new)
