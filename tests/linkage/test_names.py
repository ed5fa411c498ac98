import pytest
from pyspark.sql import functions as F

from foliate.functions import names, numbers
from foliate.functions import text as T

NUMBERS = {
    "Tin Fox #7.cbz": "7", "Tin Fox #070.cbz": "70", "Tin Fox #12.25 (1987).cbz": "12.25", "Tin Fox #4b.cbz": "4b", "Tin Fox #9/2 x.cbz": "9/2", "Tin Fox issue 33 - Rust.cbr": "33", "Tin Fox ISSUE #08.cbz": "8",
    "Tin Fox Annual 3.cbz": "3", "Tin Fox annual - Snow.cbz": "Annual", "Tin Fox special #12.cbz": "12", "Special Tin Fox.cbz": "Special", "Tin Fox (FCBD).cbz": "FCBD", "preview of Tin Fox.cbz": "Preview",
    "Tin Fox oneshot 5.cbz": "One-Shot", "Tin Fox Annual #6 #2.cbz": "6", "Tin Fox-0044.cbz": "44", "Tin Fox 5 (1999).cbz": "", "Tin Fox 00.cbz": "0", "Tin Fox #10½.cbz": "0.5", "Tin Fox #20½.cbz": "0.5", "#½ Tin Fox.cbz": "0.5",
}
COLLECTED = {
    "Tin Fox compendium.cbz": True, "gn Tin Fox.cbr": True, "Tin Fox (Hardcover).cbz": True, "Tin Fox, Masterworks 2.cbz": True, "Tin Foxgn.cbz": False, "Tin Fox tpbs.cbz": False, "Tin Fox volume 3.cbz": False,
}
ODD = ["", ".cbz", "/", "//", "a" * 255 + ".cbz", "../../etc/passwd", "'; DROP TABLE x; --.cbz", "日本語 #1.cbz", "\x00\x01.cbz", "🙂 (2016).cbz", "((((", "#", "#a", "v", "(2016)", None, "Tin Fox #001 #002 (1999) [2001].cbz"]


def parse(spark, paths):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "file_id long, path string")
    return {r["path"]: r for r in names.parse_filename(df).collect()}


def test_numbers(spark):
    got = parse(spark, list(NUMBERS))
    assert {p: got[p]["issue_number"] for p in NUMBERS} == NUMBERS


def test_collected(spark):
    got = parse(spark, list(COLLECTED))
    assert {p: got[p]["is_tpb"] for p in COLLECTED} == COLLECTED


def test_series_year_volume(spark):
    want = {
        "/c/Tin Fox (1987)/Tin Fox #001 - Rust.cbz": ("Tin Fox", 1987, ""),
        "/c/x/Tin Fox v02 #3 [1999].cbz": ("Tin Fox", 1999, "2"),
        "/tmp/Tin Fox Preview (2004).cbz": ("Tin Fox Preview", 2004, ""),
        "/c/x/Tin Fox Annual #2.cbz": ("Tin Fox Annual", 0, ""),
        "/c/Ember/#001.cbz": ("Ember", 0, ""),
        "/c/x/Tin Fox vol 000 #1.cbz": ("Tin Fox", 0, "1"),
    }
    got = parse(spark, list(want))
    assert {p: (got[p]["series_name"], got[p]["year"], got[p]["volume"]) for p in want} == want


def test_never_fails(spark):
    assert len(parse(spark, ODD)) == len(ODD)


def test_order(spark):
    for given, want in ((["3", "1", "2", "0", "0.5", "1.5"], ["0", "0.5", "1", "1.5", "2", "3"]), (["1B", "1A", "1"], ["1", "1A", "1B"]), (["Omnibus", "2", "Annual", "x", "", "Special #1"], ["2", "Annual", "Special #1", "Omnibus", "x", ""])):
        df = spark.createDataFrame([(x,) for x in given], "raw string").withColumn("o", numbers.issue_order(F.col("raw")))
        assert [r["raw"] for r in df.orderBy("o.numeric", "o.suffix").collect()] == want


@pytest.mark.parametrize("a,b,same", [("001", "1", True), ("1", "1A", False), ("Annual #2", "annual 2", True), ("Special", "One-Shot", True), ("", "", False), ("½", "0.5", True), ("x", "y", True), ("1.5", "1", False)])
def test_same_issue(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(numbers.same_issue(numbers.issue_number(F.col("a")), numbers.issue_number(F.col("b")))).first()[0] is same


def test_text_forms(spark):
    df = spark.createDataFrame([("The a X-Men: Pokémon_1",)], "t string")
    r = df.select(T.title_form(F.col("t")), T.key_form(F.col("t")), T.mask(F.lit("abcdefghijkl")), T.redact(F.lit("http://x?api_key=1&b=2")), T.url_list(F.lit('["http://a","x"]'))).first()
    assert tuple(r) == ("x men pokémon_1", "a x men pokémon 1", "abcd...ijkl", "http://x?api_key=REDACTED&b=2", ["http://a"])
