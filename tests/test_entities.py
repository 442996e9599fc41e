"""F02 and F24 on texts with hand-written results."""

import html

from pyspark.sql import functions as F

from quarry.functions import text as T

DECODED = [
    ("plain", "plain"), ("", ""), ("&", "&"), ("&&amp;&", "&&&"), ("&amp;nbsp;", "&nbsp;"), ("&amp;amp;", "&amp;"),
    ("a &lt;b&gt; c", "a <b> c"), ("&eacute;&Eacute;", "éÉ"), ("&EACUTE;", "&EACUTE;"), ("&amp", "&amp"), ("&bogus;", "&bogus;"),
    ("&quot;&apos;&#39;&#x27;", "\"'''"), ("&#8364;&#x20AC;&#X20ac;", "€€€"), ("&#128512;", "😀"), ("&#00065;", "A"),
    ("&#;&#x;&#xZ;&#12a;", "&#;&#x;&#xZ;&#12a;"), ("&#13;&#0;&#11;&#128;", "&#13;&#0;&#11;&#128;"),
    ("&#xD800;&#xFFFE;&#x1FFFF;&#xFDD0;", "&#xD800;&#xFFFE;&#x1FFFF;&#xFDD0;"), ("&#x110000;&#99999999999;", "&#x110000;&#99999999999;"),
    ("&NotEqualTilde;&fjlig;", "≂̸fj"), ("&nbsp;&#xFEFF;&Tab;", " ﻿\t"), ("x&semi;y&comma;", "x;y,"),
]

NORMALIZED = [
    (None, ""), ("  a\t b ", "a b"), ("&nbsp;&zwj;&#8203;", ""), ("&#13;", "&#13;"), ("&#xE000;&shy;", ""), ("R&amp;D", "R&D"),
    ("&lt;&nbsp;&gt;", "< >"), ("a​b", "a b"), ("\x07x⁠y", "xy"), ("&amp;nbsp;", "&nbsp;"), ("　&emsp;é", "é"),
]


def test_decoded(spark):
    df = spark.createDataFrame(DECODED, "given string, want string")
    for r in df.select("given", "want", T.decode_entities("given").alias("got")).collect():
        assert r.got == r.want, r.given


def test_every_name(spark):
    names = sorted(T.entity_table())
    assert len(names) == 2125
    df = spark.createDataFrame([(f"<&{n};>",) for n in names], "t string")
    for r in df.select("t", T.decode_entities("t").alias("got")).collect():
        assert r.got == html.unescape(r.t)


def test_normalized(spark):
    df = spark.createDataFrame(NORMALIZED, "given string, want string")
    for r in df.select("given", "want", T.normalize_text("given").alias("got"), T.has_visible_text(F.col("given")).alias("v")).collect():
        assert (r.got, r.v) == (r.want, r.want != ""), r.given
