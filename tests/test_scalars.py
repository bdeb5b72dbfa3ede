from pyspark.sql import functions as F

from merchloom.functions import money, text, units, url


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("r")).orderBy("i")
    return [r.r for r in rows.collect()]


def test_money(spark):
    assert column(spark, ["$1,299.00", "1.299,00 €", "1 299,50", "Free", None, "1,299", "12,5", "1.234.567", "-3.5"], money.parse_money) == [1299.0, 1299.0, 1299.5, None, None, 1299.0, 12.5, 1234567.0, -3.5]
    assert column(spark, ["4999", "49.99"], lambda c: money.parse_money(c, True)) == [49.99, 49.99]
    assert column(spark, ["£95.00", "€89", "Price: 100", "A$5", "10 CHF"], money.currency_from) == ["GBP", "EUR", None, "USD", "CHF"]
    assert column(spark, ["yes", "Out of stock", "maybe", None], money.parse_bool) == [True, False, None, None]
    assert column(spark, [249.0, 18.5, None, 100.0], money.shortest, "double") == ["249", "18.5", "", "100"]


def test_units(spark):
    rows = spark.createDataFrame([(25.0, "lb"), (1.0, None), (2.0, "stone"), (1.5, "KG ")], "w double, u string").select(units.to_kilograms(F.col("w"), F.col("u")).alias("k"), units.to_centimetres(F.lit(18.0), F.lit("in")).alias("c")).collect()
    assert [r.k for r in rows] == [11.339809, 0.001, None, 1.5] and rows[0].c == 45.72


def test_urls(spark):
    assert column(spark, ["https://WWW.Shop.com/products/X/?utm_campaign=a&b=2#frag", "http://a.b", "Not A URL "], url.normalize_url) == ["https://shop.com/products/X?b=2", "https://a.b/", "not a url"]
    assert column(spark, ["<shop.com/x>", "ftp://a.b", "nope", "https://A.B"], url.coerce_url) == ["https://shop.com/x", None, None, "https://a.b/"]
    assert column(spark, ["https://cdn.x.com/a_800x800.jpg?v=1", "https://www.x.com/a-300x200.PNG"], url.image_identity) == ["cdn.x.com/a.jpg", "x.com/a.png"]
    assert column(spark, ["https://s.com/en/products/a%20b?x=1", "https://s.com/"], url.product_handle) == ["a b", None]
    base = F.lit("https://s.com/a/b.html?q=1")
    assert column(spark, ["//x.y/z", "/r", "c.png", "../d", "mailto:x", "", None], lambda c: url.absolute_url(c, base)) == ["https://x.y/z", "https://s.com/r", "https://s.com/a/c.png", "https://s.com/d", None, None, None]


def test_text(spark):
    assert column(spark, ["=1+1", 'a"b', " x", "-5", None, "plain", "a,b"], text.csv_cell) == ["'=1+1", '"a""b"', '" x"', "'-5", "", "plain", '"a,b"']
    assert column(spark, ["Élan  Vital!", "it's", None], lambda c: text.slugify(c)) == ["elan-vital", "its", None]
    assert column(spark, ["a\xa0 b ", "  ", None], text.clean_text) == ["a b", None, None]
    assert column(spark, ["HTTP 503", "getaddrinfo ENOTFOUND", "AbortError", "x"], text.error_code) == ["SERVER_ERROR", "DNS_FAILED", "TIMEOUT", "UNKNOWN"]
    assert column(spark, ["On backorder", "Sold Out", "In stock", "", None], text.stock_from_text) == ["on_backorder", "out_of_stock", "in_stock", "unknown", "unknown"]
    bad = column(spark, ["<p><b><i><u><s><em>x", "<p>ok</p>", "<script>", None], text.malformed_html)
    assert bad[0] and bad[1] is None and "script" in bad[2] and bad[3] is None
