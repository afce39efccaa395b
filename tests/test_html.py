"""Golden pages for the markup scan."""

from pyspark.sql import functions as F

from larder.functions.html import page_text

GOLDEN = [
    ("<p>Protein</p><p>24<b>g</b></p>", "Protein 24 g"),
    ("a<!-- x > y --> b <!-- never <p>closed", "a b"),
    ('<a title="2 > 1" href=\'x>y\'>link</a> end', "link end"),
    ('<a title="odd>text</a>"quoted"', 'text "quoted"'),
    ("<p>open <b", "open"), ("<p>open <b class=", "open"), ("<div <p>two</p>", "two"),
    ("<script>if (a < b && b > c) { x = '</p>' }</script>t", "t"), ("t<SCRIPT src=x>never closed", "t"), ("<style>p>a{}</style >t", "t"),
    ("<head><title>no</title></head><body>yes</body>", "yes"), ("<head><title>no<body class=x>yes", "yes"), ("<header>kept</header>", "kept"),
    ("1 < 2 & 3 > 2 <3", "1 < 2 & 3 > 2 <3"), ("<!DOCTYPE html><?xml v?><![CDATA[x]]>t", "t"),
    ("&lt;b&gt; &amp;lt; &#65;&#x42;&#X1F600; &#0; &#xD800; &#9999999; &nope; &amp &copy;", "<b> &lt; AB😀 � � � &nope; &amp ©"),
    ("caf&eacute;&nbsp;au&#160;lait", "café au lait"), ("", ""), (None, ""), ("  plain \n text\t ", "plain text"),
    ("<a " + 'x="y" ' * 400 + ">many</a>" + "z" * 5000, "many " + "z" * 5000),
]


def test_golden_pages(spark):
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(GOLDEN)], "n int, html string")
    got = {r.n: r.text for r in rows.select("n", page_text(F.col("html")).alias("text")).collect()}
    for i, (html, text) in enumerate(GOLDEN):
        assert got[i] == text, html
