from pyspark.sql import functions as F

from foliant.functions import ids, naming
from foliant.operators import identifiers as op

FT = "id BIGINT, page_texts ARRAY<STRING>, xmp_title STRING, xmp_author STRING, xmp_subject STRING, xmp_keywords STRING, file_name STRING"


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first().r


def doc(spark, pages, **meta):
    row = (1, pages, meta.get("title"), meta.get("author"), meta.get("subject"), meta.get("keywords"), "a.pdf")
    return spark.createDataFrame([row], FT)


def doi(spark, pages, **meta):
    return op.extract_doi(doc(spark, pages, **meta)).first().doi


def test_doi_tiers(spark):
    assert doi(spark, ["x\n(10.1234/ab.(c))."]) == "10.1234/ab.(c"  # trailing brackets always go
    assert doi(spark, ["a", "b", "see 10.5555/p3"]) == "10.5555/p3"
    assert doi(spark, ["a", "b", "c", "10.5555/p4"]) is None
    assert doi(spark, ["a"], subject="doi:10.1/x 10.7777/s;", keywords="10.8888/k") == "10.7777/s"
    assert doi(spark, ["a"], subject="none", keywords="10.8888/k") == "10.8888/k"
    late = "\n".join(["line"] * 100 + ["10.1234/late"])
    assert doi(spark, [late]) == "10.1234/late"  # the whole first page is the second tier
    assert doi(spark, ["first", late]) is None
    assert doi(spark, ["10.1234/)"]) == "10.1234/"  # an empty suffix passes
    assert doi(spark, []) is None


def test_normalise_doi(spark):
    f = lambda v: one(spark, v, ids.normalise_doi)
    assert f(" https://dx.doi.org/10.1234/a.b. ") == "10.1234/a.b"
    assert f("doi:10.1234/a") == "10.1234/a"
    assert f("10.12/short") is None
    assert f(None) is None


def test_isbn(spark):
    f = lambda *p: op.extract_isbn(doc(spark, list(p))).first().isbn
    assert f("ISBN-13: 978-0-306-40615-7") == "9780306406157"
    assert f("isbn 0-306-40615-x") == "030640615X"
    assert f("bare 9780306406157 here") == "9780306406157"
    assert f("9780306406157", "ISBN 0306406152") == "0306406152"  # the labelled one is better
    assert f("nothing") is None
    assert one(spark, ["0-1", "978-2"], ids.pick_isbn, "array<string>") == "9782"
    assert one(spark, ["0-1", "1-1"], ids.pick_isbn, "array<string>") == "01"
    assert one(spark, [], ids.pick_isbn, "array<string>") is None


def test_title_and_year(spark):
    f = lambda v: one(spark, v, ids.candidate_title)
    assert f("short\n  A title of enough length \nAnother title, as long..") == "A title of enough length"
    assert f("a title that is long one\nb title that is long two") == "a title that is long one"  # first wins a tie
    assert f("x" * 40) == ""
    assert f("\n".join(["ab"] * 20 + ["a line that comes too late"])) == ""
    assert one(spark, "in 1799, 18999 and 2024", ids.parse_year) == 2024
    assert one(spark, "", ids.parse_year) is None
    assert one(spark, " <p>a <b>c</b></p> ", ids.strip_markup) == "a c"


def test_guess(spark):
    g = lambda **m: op.guess_metadata(doc(spark, ["x"], **m)).first()
    assert (g(title="UNTITLED").title, g(title=None).metadata_source) == ("a.pdf", "filename")
    row = g(title=" Real ", author="W")
    assert (row.title, row.authors, row.metadata_source, row.needs_review) == ("Real", ["W"], "xmp", True)
    assert g(title="Real").authors == []


def test_naming(spark):
    f = lambda v: one(spark, v, naming.author_short, "array<string>")
    assert f([]) == "Unknown"
    assert f(["Doe, J", "B", "C"]) == "Doe et al"
    assert f(["Jane Doe", "B"]) == "Jane"
    safe = one(spark, " a/b:" + "x" * 90, naming.fs_safe)
    assert safe == "a_b_" + "x" * 75
    assert one(spark, safe, naming.fs_safe) == safe
    path = spark.range(1).select(
        naming.destination_path("/lib", F.lit("s.pdf"), F.lit("crossref"), F.lit(" "), F.lit(0), F.array(F.lit("A, B")), F.lit("{year}"))
    ).first()[0]
    assert path == "/lib/Unsorted/Unknown/A (Unknown) {year}.pdf"
    assert one(spark, "/else/x.pdf", lambda c: naming.mirror_path(c, "/lib", "/b")) is None
    assert one(spark, "/lib/j/x.pdf", lambda c: naming.mirror_path(c, "/lib", "/b")) == "/b/j/x.pdf"
