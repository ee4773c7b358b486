from decimal import Decimal

from pyspark.sql import functions as F

from sluice.functions import html as H
from sluice.functions import locale as L


def test_numbers_with_decimal_commas(spark):
    rows = [("1.000",), ("1,5",), ("R$ 0,30",), ("1.234.567,89",), ("none",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in df.select(L.number(F.col("t"))).collect()] == [Decimal("1000.00"), Decimal("1.50"), Decimal("0.30"), Decimal("1234567.89"), None, None]


def test_ranges(spark):
    rows = [("60-70%",), ("60–75%",), ("R$ 1,5-2",), ("~35%",), ("",), (None,)]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, "t string").select(L.span(F.col("t"), "decimal(5,1)")).collect()]
    d = Decimal
    assert got == [(d("60.0"), d("70.0"), False), (d("60.0"), d("75.0"), False), (d("1.5"), d("2.0"), False), (d("35.0"), d("35.0"), True), (None, None, False), (None, None, False)]


def test_visibility_follows_the_root(spark):
    df = spark.createDataFrame([("es",), ("pt",), (None,)], "lang string")
    show = lambda root: [r[0] for r in df.where(H.visible(F.col("lang"), root)).collect()]
    assert show("es") == ["es", None] and show("pt") == ["pt", None] and show("xx") == ["es", None]


def test_empty_choice_is_unset(spark):
    df = spark.createDataFrame([("",), ("pt",), (None,)], "s string")
    assert [r[0] for r in df.select(H.wanted_language(F.col("s"))).collect()] == ["es", "pt", "es"]


def test_message_links_decode_mixed_escapes(spark):
    df = spark.createDataFrame([("https://m.example.com/send?text=Ol%C3%A1%20é+ção",)], "l string")
    assert df.select(H.message_of(F.col("l"))).first()[0] == "Olá é ção"
    made = df.select(H.message_link("https://m.example.com/send?text=", F.lit("a b&c=é"))).first()[0]
    assert spark.createDataFrame([(made,)], "l string").select(H.message_of(F.col("l"))).first()[0] == "a b&c=é"


def test_visible_text_skips_scripts(spark):
    html = '<html lang="fr"><style>p{}</style><script>var t="</p>";</script><!-- <p>no</p> --><p>one<br>two</p></html>'
    row = spark.createDataFrame([(html,)], "h string").select(H.visible_text(F.col("h")), H.lang(F.col("h"))).first()
    assert tuple(row) == ("one two", "fr")
