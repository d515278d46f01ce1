import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from attestra.functions.entities import unescaped
from attestra.sources import html as pages


def test_references_are_read_as_the_standard_library_reads_them(spark):
    r = random.Random(9)
    parts = ["&", "&#", "&#x", "&amp;", "&lt;b&gt;", "&nbsp;", "&copy", "&copy2", "&notit;", "&notin;", "&#8212;", "&#x2014;", "&#X2014", "&#0;", "&#128;", "&#x81;", "&#55296;", "&#xFFFE;", "&#x1F600;", "&#99999999999999;", "&#1114112;", "&#11;", "&#009;", "&AMP", "&unknown;", "text", " ", ";", "é", "😀", "&amp;lt;", "&#38;amp;"]
    parts += [f"&{n}" for n in r.sample(sorted(html5), 60)]
    texts = ["".join(r.choices(parts, k=r.randint(0, 8))) for _ in range(3000)] + [None, "x" * 10000 + "&euro;"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {x["i"]: x["u"] for x in d.select("i", unescaped(F.col("t")).alias("u")).collect()}
    wrong = [(t, got[i]) for i, t in enumerate(texts) if got[i] != (None if t is None else html.unescape(t))]
    assert not wrong, wrong[:5]


def test_lines_of_pages_are_unescaped(spark):
    d = spark.createDataFrame([("<h1>A &#x2014; B&copy</h1><p>x &eacute;&nbsp;y &amp;lt;</p>",)], "html string")
    assert d.select(pages.lines(F.col("html")).alias("l")).first()["l"] == ["A — B©", "x é y &lt;"]
