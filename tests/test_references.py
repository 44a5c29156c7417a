"""Character references against the standard library's reading of them."""

import html
import random

from feedloom.sources.pages import decode_entities
from pyspark.sql import functions as F

CASES = [
    "&copy 2020", "&copy; 2020", "&nbsp", "&ltb", "&lt;b&gt;", "&notit;", "&notin;", "&notinx", "&amp;lt;", "&ampamp", "&unknown; &x", "& & &&amp", "&#150; &#x96;",
    "&#128;&#129;&#159", "&#0; &#x0", "&#13;&#10;", "&#1;&#11;&#31;x", "&#55296;", "&#x110000;", "&#99999999999999;", "&#xFFFFFFFFFF", "&#00000000065;", "&#x0000000041;",
    "&#65 &#65x", "&#xfdd0;|&#xfffe;|&#x1ffff;", "&#;", "&#x;", "&Auml&ouml;", "&AMP", "&CounterClockwiseContourIntegral;", "&fjlig;", "a&sup2b", "", "no reference",
]


def test_references(spark):
    rng = random.Random(4)
    parts = ["&", "#", "x", "X", ";", "amp", "lt", "copy", "not", "in", "65", "150", "0", "fffe", " ", "é", "a", "1"]
    texts = CASES + ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(600)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", decode_entities(F.col("t")).alias("out")).collect()
    bad = [(r["t"], r["out"], html.unescape(r["t"])) for r in got if r["out"] != html.unescape(r["t"])]
    assert not bad, bad[:10]


def test_the_query_knows_what_its_sql_knows(spark, tmp_path):
    """A reference cut off before its semicolon, or of another name, stays in the query as in its SQL."""
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    texts = ["and &amp", "a &ampp b&am", "&amp;lt; &lt;b&gt; &quot;&#39;&apos;&nbsp;&copy;&middot;", "&eacute; &#38; &copy 1 &amp;&amp", "none", "", None]
    spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(oracle_sql()["s02_html_to_text"]).fetchall()
    got = [tuple(r) for r in queries()["s02_html_to_text"](spark, str(tmp_path)).select("page_id", "out").collect()]
    assert sorted(got) == sorted(want)
