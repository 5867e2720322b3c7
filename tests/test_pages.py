from pyspark.sql import functions as F

from foliant.operators import pages as op


def meta(spark, html, url="http://h.example/x"):
    return op.page_metadata(spark.createDataFrame([(1, url, html)], "page_id BIGINT, url STRING, html STRING")).first()


def ld(text):
    return f'<script type="application/ld+json">{text}</script>'


def test_attribute_forms(spark):
    m = meta(spark, "<META content='A &amp; B' NAME='citation_title'/><meta name=citation_doi content=10.1234/u>")
    assert (m.title, m.doi) == ("A & B", "10.1234/u")
    m = meta(spark, '<meta name="citation_title" content="a > b"><!-- <meta name="citation_doi" content="10.1234/c"> -->')
    assert (m.title, m.doi) == ("a > b", None)
    m = meta(spark, "<script>var s = '<meta name=\"citation_title\" content=\"no\">';</script>")
    assert m.title == ""


def test_entities(spark):
    m = meta(spark, '<meta name="citation_title" content="a&#8211;b&#x2014;c &#39;q&#39; &lt;i&gt; &amp;#65; &#xD800; &#; &#99999999;">')
    assert m.title == "a–b—c 'q' <i> &#65; &#xD800; &#; &#99999999;"


def test_first_tag_counts(spark):
    m = meta(spark, '<meta name="citation_title" content=""><meta name="citation_title" content="second">')
    assert m.title == ""
    m = meta(spark, '<meta name="citation_author" content=""><meta name="citation_author" content="B">')
    assert m.authors == ["B"]
    m = meta(spark, '<meta name="citation_title"><meta property="og:title" content="OG">')
    assert m.title == "OG"


def test_highwire_rules(spark):
    m = meta(spark, '<meta name="citation_isbn" content="978-0 1x"><meta name="citation_journal_title" content="J">')
    assert (m.isbn, m.document_type, m.journal) == ("97801X", "article", "J")
    m = meta(spark, '<meta name="citation_isbn" content="1"><meta name="citation_book_title" content="Bk"><meta name="citation_journal_title" content="J">')
    assert (m.document_type, m.journal) == ("book", "Bk")
    m = meta(spark, '<meta name="citation_firstpage" content="3"><meta name="citation_lastpage" content="9">')
    assert m.pages == "3–9"
    assert meta(spark, '<meta name="citation_lastpage" content="9">').pages == ""


def test_dublin_core_spellings(spark):
    html = '<meta name="dc.creator" content="low"><meta name="DC.CREATOR" content="UP"><meta name="DC.creator" content="given">'
    assert meta(spark, html).authors == ["given", "low", "UP"]
    m = meta(spark, '<meta name="DC.TITLE" content="up"><meta name="dc.title" content="low"><meta name="DC.date" content="May 2001">')
    assert (m.title, m.year) == ("low", 2001)


def test_linked_data(spark):
    m = meta(spark, ld("{bad") + ld('[{"@type":"Book","name":"no"},{"@type":"Article","name":"yes","author":{"name":"A"}}]'))
    assert (m.title, m.authors, m.document_type) == ("yes", ["A"], "article")
    m = meta(spark, ld('{"@type":"Book","headline":"H","publisher":{"name":"P"},"author":[{"name":"A"},"x",{"name":""}]}'))
    assert (m.title, m.journal, m.authors, m.document_type) == ("H", "P", ["A"], "book")
    m = meta(spark, ld('{"@type":"Article","identifier":[{"propertyID":"isbn","value":"97-8 x"},"q"],"url":"http://p/pdf/1"}'))
    assert (m.isbn, m.document_type, m.pdf_url, m.open_access) == ("978X", "book", "http://p/pdf/1", False)
    m = meta(spark, ld('[{"@type":"Book"}]') + ld('{"@type":"CreativeWork","name":"second","datePublished":1999}'))
    assert (m.title, m.year) == ("second", 1999)
    m = meta(spark, '<meta name="citation_doi" content="10.1234/d">' + ld('{"@type":"Article","identifier":[{"@type":"ISBN","value":"1"}]}'))
    assert (m.isbn, m.document_type) == (None, "article")  # a known DOI leaves the identifier list unread


def test_marks_inside_scripts_and_styles(spark):
    hidden = '<script>if (a) x = "<!-- </style>";</script>'
    m = meta(spark, hidden + ld('{"@type":"Article","name":"seen"}') + "<!-- end -->")
    assert m.title == "seen"
    assert meta(spark, "<!-- " + ld('{"@type":"Article","name":"old"}') + " -->" + ld('{"@type":"Article","name":"new"}')).title == "new"
    assert meta(spark, hidden + '<meta name="citation_title" content="T"><!-- x -->').title == "T"


def test_url_doi_is_last(spark):
    assert meta(spark, "<p>", "http://h.example/10.1234/u.").doi == "10.1234/u"
    assert meta(spark, '<meta name="DC.identifier" content="10.1234/d">', "http://h.example/10.1234/u").doi == "10.1234/d"


def test_recorded_answers(spark):
    cases = [
        (302, "/LOGIN", "", False), (301, "/new", "", True), (401, "", "application/pdf", False), (403, "", "", False),
        (200, "", "text/html", False), (200, "", "application/pdf; x", True), (404, "", "", True), (None, "", "", False),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i INT, s INT, l STRING, t STRING, want BOOLEAN")
    got = rows.select("i", "want", op.document_url_ok(F.col("s"), F.col("l"), F.col("t")).alias("ok")).collect()
    assert all(r.ok == r.want for r in got)
    kind = lambda u, t: spark.createDataFrame([(u, t)], "u STRING, t STRING").select(op.url_kind(F.col("u"), F.col("t"))).first()[0]
    assert [kind("a.PDF", None), kind("a", "application/pdf;x"), kind("a.pdf?x", "text/html")] == ["pdf", "pdf", "landing_page"]
