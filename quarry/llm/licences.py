"""Licence scan by canonical digests.

A text is brought to a canonical form line by line: lower case, copyright lines dropped,
equivalent spellings unified, everything but letters and digits made one blank. The
digest of the entire canonical text is joined by hash with the digests of the known
licences (a table of any size), so a document that is a licence is found however it is
wrapped, punctuated or spelt. The digests of its single lines are looked up in the same
join, so that one-line notices inside a text are found as well. Notices that are a sentence
(one line that ends with a full stop) are also looked for in the running text, over line
breaks and inside lines: each is known by its anchor, a run of up to three words that few
sentences share, and the same join looks up the runs of words of every text. A text is then
searched for the sentences of the anchors it holds and for no others. Other one-line texts,
as SPDX identifiers, must be a line: MIT is not MIT-0.

All of it is native. The licences may be a table of any size: Spark sends it to the tasks if
its written size is small and shuffles hashes otherwise. Only hits are grouped per document.

Null and empty texts, and lines without a letter or digit, hold no licence. Repeated rows
are judged alike. Licences with equal canonical texts are all reported. Empty tables give
empty or licence-free results.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, free_name, staged

#: Pattern and replacement of equivalent spellings (lower case).
SPELLINGS = [
    ("licenc", "licens"),                                  # licence, licenced
    ("sub[- ]licens", "sublicens"),
    ("non[- ]", "non"),                                    # non-infringement, non-commercial
    ("is(ation|ing|ed|e)", "iz$1"),                        # organisation, authorised
    ("(behavi|fav|hon|lab)our", "$1or"),
    ("https://", "http://"),
    ("copyright holder", "copyright owner"),
]

#: Fixed value: a copyright line.
COPYRIGHT = r"^[^\p{L}\p{N}]*(copyright|\(c\)|©)[^\n]*[0-9]{4}"

#: One-line notices by which a text names its licence.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "proprietary": ["All rights reserved."],
}

#: Words of a sentence's anchor.
ANCHOR = 3

#: Full texts without title and copyright lines, one file a licence.
TEXTS = Path(__file__).parent / "licence_texts"

#: What stands above the full texts of short licences.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License"],
    "ISC": ["ISC License", "The ISC License"],
}


def full_texts() -> list[tuple[str, str]]:
    """(licence_id, text): every shipped licence in its usual spellings."""
    out = []
    for path in sorted(TEXTS.glob("*.txt")):
        name, text = path.stem, path.read_text(encoding="utf-8")
        end = re.search(r"END OF TERMS AND CONDITIONS", text)
        bodies = [text, *([text[:end.start()], text[:end.end()]] if end else [])]
        if name.startswith("BSD"):  # clauses with numbers or other marks
            bodies.append(re.sub(r"(?m)^\s*[0-9]\.", "*", text))
        for body in bodies:
            for title in ["", *TITLES.get(name, [])]:
                out += [(name, f"{title}\n{body}")]
                if name in TITLES:  # below the copyright line
                    out += [(name, f"{title}\nAll rights reserved.\n{body}")]
    return out


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text that hold anything, in order."""
    def line(x):
        x = F.lower(x)
        for old, new in SPELLINGS:
            x = F.regexp_replace(x, old, new)
        return F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))

    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~F.lower(x).rlike(COPYRIGHT))
    return F.filter(F.transform(lines, line), lambda x: x != "")


def joined(lines: Column) -> Column:
    """Canonical lines as one text; spellings of two words may be wrapped between them."""
    text = F.array_join(lines, " ")
    for old, new in SPELLINGS:
        if " " in old:
            text = F.regexp_replace(text, old, new)
    return text


def md5(x: Column) -> Column:
    return F.md5(x.cast("binary"))


def word_windows(lines: Column, lengths: list[int]) -> Column:
    """Hashes of all runs of ``lengths`` words in the running text, each once."""
    def run(w, k):
        return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(
            *[F.get(w, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))

    words = F.array(F.split(joined(lines), " "))
    return F.transform(words, lambda w: F.array_distinct(F.concat(*[run(w, k) for k in lengths])))[0]


def digests(text: Column, lengths: list[int]) -> Column:
    """Array of (whole, h, digest): the entire canonical text first, then its lines, then
    (digest null) the windows of ``lengths`` words of its running text."""
    def entry(whole, h, digest):
        return F.struct(F.lit(whole).alias("whole"), h.alias("h"), digest.alias("digest"))

    def rows(x):
        found = [F.transform(F.array(joined(x)), lambda t: entry(True, F.xxhash64(t), md5(t))),
                 F.transform(x, lambda y: entry(False, F.xxhash64(y), md5(y)))]
        if lengths:
            found.append(F.transform(word_windows(x, lengths), lambda h: entry(False, h, F.lit(None).cast("string"))))
        return F.when(F.size(x) > 0, F.concat(*found))

    return F.transform(F.array(canonical_lines(text)), rows)[0]


def anchored(sentences: DataFrame) -> DataFrame:
    """(h, k, line, ids): every sentence under the hash of its anchor, the run of ``ANCHOR``
    words that the fewest sentences hold (all its words, where it has fewer)."""
    words = F.split("line", " ")
    k = F.least(F.size(words), F.lit(ANCHOR))
    runs = sentences.select("line", "ids", k.alias("k"), F.explode(F.coalesce(*[
        F.when(k == n, word_windows(F.array("line"), [n])) for n in range(1, ANCHOR + 1)])).alias("h"))
    rare = runs.groupBy("h").agg(F.count("*").alias("n"))
    best = F.min(F.struct("n", "h", "k", "ids")).alias("best")
    return runs.join(rare, "h").groupBy("line").agg(best).select("best.h", "best.k", "line", "best.ids")


def known_licences(spark: SparkSession) -> DataFrame:
    """The built-in table (licence_id, text): notices and full texts."""
    return spark.createDataFrame([(k, t) for k, ts in NOTICES.items() for t in ts] + full_texts(), "licence_id string, text string")


def scan(docs: DataFrame, licences: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``licences`` (sorted ids found in its lines or as a whole) and
    ``whole_text`` (ids of licences that are the entire document). Columns with these
    names are replaced."""
    line = F.transform(canonical_lines(F.col("text")), lambda x: joined(F.array(x)))
    sentences = licences.filter(F.rtrim("text").endswith(".") & (F.size(line) == 1)).groupBy(line[0].alias("line")).agg(
        F.collect_set("licence_id").alias("ids"))
    anchors = staged(anchored(sentences), "licence-anchors")
    lengths = sorted(r["k"] for r in anchors.select("k").distinct().collect())  # at most ANCHOR numbers
    whole = digests(F.col("text"), [])[0]
    known = licences.select("licence_id", whole["h"].alias("h"), whole["digest"].alias("digest"))
    known = known.filter("digest IS NOT NULL").groupBy("h", "digest").agg(F.collect_set("licence_id").alias("ids"))
    known = staged(known.select("h", "digest", F.lit(None).cast("string").alias("line"), "ids").unionByName(
        anchors.select("h", F.lit(None).cast("string").alias("digest"), "line", "ids")), "licences")
    keep = [col(c) for c in docs.columns if c.lower() not in ("licences", "whole_text")]
    key, body = free_name(docs, "_key"), free_name(docs, "_body")
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    of_text = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"))
    found = docs.select(of_text.alias("key"), F.explode(digests(text, lengths)).alias("d")).select("key", "d.*")
    same = (found["h"] == known["h"]) & found["digest"].eqNullSafe(known["digest"])
    hits = found.join(known, same).select("key", "whole", "line", "ids").distinct()
    sure = F.flatten(F.collect_set(F.when(F.col("line").isNull(), F.col("ids"))))
    per = staged(hits.groupBy("key").agg(
        sure.alias("sure"), F.flatten(F.collect_set(F.when(F.col("whole"), F.col("ids")))).alias("whole"),
        F.collect_set(F.when(F.col("line").isNotNull(), F.struct("line", "ids"))).alias("open")), "licence-hits")
    old = [c for c in docs.columns if c.lower() in ("licences", "whole_text")]
    d = docs.select(*[col(c) for c in docs.columns], of_text.alias(key), text.alias(body)).drop(*old).join(
        per.select(F.col("key").alias(key), F.struct("sure", "whole", "open").alias(per_name := free_name(docs, "_per"))),
        key, "left")
    none, per_ = F.array().cast("array<string>"), col(per_name)
    # only texts with an anchor are searched, and only for the sentences of their anchors
    proven = F.when(F.size(per_["open"]) > 0, inside(col(body), per_["open"])).otherwise(none)
    ids = F.array_sort(F.array_distinct(F.concat(per_["sure"], proven)))
    return d.select(*keep, F.coalesce(ids, none).alias("licences"),
                    F.coalesce(F.array_sort(F.array_distinct(per_["whole"])), none).alias("whole_text"))


def inside(text: Column, sentences: Column) -> Column:
    """Ids of the ``sentences`` (line, ids) that the running text holds."""
    running = F.concat(F.lit(" "), joined(canonical_lines(text)), F.lit(" "))
    held = F.transform(F.array(running), lambda r: F.filter(
        sentences, lambda s: r.contains(F.concat(F.lit(" "), s["line"], F.lit(" ")))))[0]
    return F.flatten(F.transform(held, lambda s: s["ids"]))
