"""Value tables of the scalar rules."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import outcomes, prices, sellers, urls
from shelfmark.operators import products, reviews

SHOP = "https://www.amazon.com"


def check(column, fn, cases, kind="string"):
    got = column(fn, [case[0] for case in cases], kind)
    assert list(zip([c[0] for c in cases], got)) == [tuple(c) for c in cases]


def grouped(number: int, mark: str) -> str:
    return f"{number:,}".replace(",", mark)


def test_amount(column):
    """Whole numbers of every length with and without cents, in both ways of writing, with something around them."""
    rng, cases = random.Random(11), []
    for digits in range(1, 8):
        whole, cents = rng.randrange(10 ** (digits - 1), 10**digits), rng.randrange(100)
        exact, round_ = Decimal(f"{whole}.{cents:02d}"), Decimal(f"{whole}.00")
        for before, after in (("", ""), ("£ ", ""), ("", "\u00a0kr"), ("ab", "?")):
            cases += [(f"{before}{grouped(whole, ',')}.{cents:02d}{after}", exact), (f"{before}{whole}{after}", round_)]
            cases += [(f"{before}{grouped(whole, '.')},{cents:02d}{after}", exact), (f"{before}{grouped(whole, ',')}{after}", round_)]
    cases += [("7.654", Decimal("7654.00")), ("\u0667.\u0665\u0660", Decimal("7.50"))]
    cases += [(text, None) for text in ("", None, "gratis", "kr", "4.5.6", "8.25 9.75", "3,1,4")]
    check(column, prices.amount, cases)


def test_discount_is_exact(spark):
    rows = [("29,99 €", "39,99 €"), ("$29.00", "$100.00"), ("$5", "$5"), ("$0", "$5"), (None, "$5"), ("$9", "$8"), ("CDN$ 5", "CDN$ 10")]
    from shelfmark.operators.deals import with_discount

    table = spark.createDataFrame(rows, "now string, before string")
    out = with_discount(table, "now", "before").select("savings_amount", "discount_percentage", "is_on_sale").collect()
    assert [tuple(row) for row in out] == [
        ("€10.00", "25%", True),
        # Deliberately not 28 %: binary fractions make 71 of 100 a little less than 71.
        ("$71.00", "71%", True),
        (None, None, False),
        (None, None, False),
        (None, None, False),
        (None, None, False),
        ("$5.00", "50%", True),
    ]


def test_discount_percent_of_29(spark):
    from shelfmark.operators.deals import with_discount

    table = spark.createDataFrame([("$71.00", "$100.00")], "now string, before string")
    # 29 of 100: floats give 28.999..., hence 28; whole cents give 29.
    assert with_discount(table, "now", "before").first()["discount_percentage"] == "29%"


# The currency markers a valid price has on exactly one side.
MARKERS = ["US$", "CDN$", "MX$", "R$", "$", "£", "€", "¥", "₹", "zł", "Rp", "RM"]


def test_price_is_valid(column):
    """One marker on one side of a number, for every marker and shape of number; anything else is not a price."""
    rng = random.Random(12)
    whole, cents = rng.randrange(1_000, 999_999), rng.randrange(10, 100)
    numbers = [str(whole), f"{whole}.{cents}", f"{grouped(whole, ',')}.{cents}", f"{grouped(whole, '.')},{cents}", f"{whole},{cents}", grouped(whole, ",")]
    wrong = [f"{whole}.{cents}7", f"{cents},{whole}", "x", ""]
    good = [f"{m}{gap}{n}" for m in MARKERS for gap in ("", " ", "\u00a0") for n in numbers]
    good += [f"{n} {m}" for m in MARKERS for n in numbers]
    bad = [f"{m}{n}" for m in MARKERS for n in wrong] + [f"{m}{n}{m}" for m in MARKERS for n in numbers] + numbers
    bad += [None, " ", f"{grouped(whole, '.')} €", f"XY${cents}"]
    check(column, prices.price_is_valid, [(v, True) for v in good] + [(v, False) for v in bad])


def test_rating_is_valid(column):
    """A number up to five with at most one decimal: alone, of five, over five, or after one word."""
    numbers = [f"{n / 10:.1f}" for n in range(1, 51, 7)] + [str(n) for n in range(6)]
    shapes = ["{} out of 5", "{}", "{}/5", "Stars {}", "Score: {}", "Score : {} / 5", "  {} "]
    good = [shape.format(n) for shape in shapes for n in numbers]
    bad = [shape.format(n) for shape in shapes for n in ("5.1", "9", "2.34", "two", "")]
    bad += [None, "3 out of", "3 out of 4", "3 out of 5.0", "3 out of five", "3 / 6"]
    check(column, prices.rating_is_valid, [(v, True) for v in good] + [(v, False) for v in bad if v is None or v.strip()])


def test_normalize_rating(column):
    check(
        column,
        prices.normalize_rating,
        [
            ("4,7 von 5 Sternen", "4.7 out of 5"),
            ("4,70 von 5 Sternen", "4.7 out of 5"),
            ("4,7 sur 5 étoiles", "4.7 out of 5"),
            ("4.5 out of 5 stars", "4.5 out of 5"),
            ("5 out of 5 stars", "5 out of 5"),
            ("4.7 OUT OF 5", "4.7 out of 5"),
            ("3 di 5 stelle", "3 out of 5"),
            ("4.", "4."),
            ("4.7", "4.7"),
            ("7.25", "7.25"),
            ("4,7", None),
            ("6 out of 5", None),
            ("4 out of 50", None),
            ("Not a rating", None),
            ("", None),
            (None, None),
        ],
    )


def test_rating_ties_round_like_binary_floats(column):
    values = [f"{cent / 100:.2f}" for cent in range(0, 501)] + ["4.650", "4.6500001", "4.749"]
    got = column(prices.normalize_rating, [f"{v} out of 5" for v in values])
    assert got == [f"{float(v):.1f} out of 5" for v in values]


def test_urls(column):
    check(
        column,
        urls.clean_url,
        [
            *((f"{SHOP}/dp/Q5T8ZK31LM?{param}=7&keep={n}", f"{SHOP}/dp/Q5T8ZK31LM?keep={n}") for n, param in enumerate(urls.TRACKING_PARAMS)),
            (f"{SHOP}/gp/product/Q5T8ZK31LM", f"{SHOP}/gp/product/Q5T8ZK31LM"),
            (f"{SHOP}/dp/Q5T8ZK31LM/ref=zz_9?keep=1", f"{SHOP}/dp/Q5T8ZK31LM?keep=1"),
            ("https://other.shop/p?ref=1&keep=2", "https://other.shop/p?ref=1&keep=2"),
            (f"{SHOP}:99/dp/Q5T8ZK31LM?ref=1", f"{SHOP}:99/dp/Q5T8ZK31LM"),
            (f"{SHOP}/dp/X?a=1&ref_=2&b=&c#top", f"{SHOP}/dp/X?a=1&b=&c#top"),
            (f"{SHOP}/dp/X?pf%5Frd%5Fr=1&keep=a%20b", f"{SHOP}/dp/X?keep=a%20b"),
            (f"{SHOP}/dp/X?a=1&a=2&bad%zz=1", f"{SHOP}/dp/X?a=1&a=2&bad%zz=1"),
            (f"{SHOP}/ref=x/dp/Y", f"{SHOP}/ref=x/dp/Y"),
            ("not a url", "not a url"),
            ("", ""),
            (None, None),
        ],
    )
    check(
        column,
        urls.marketplace_domain,
        [
            (f"{SHOP}/s?k=tea", "amazon.com"),
            ("https://amazon.co.jp", "amazon.co.jp"),
            ("https://user:pw@WWW.Amazon.DE:443/dp", "amazon.de"),
            ("https://smile.amazon.com/x", "amazon.com"),
            ("https://example.com", "amazon.com"),
            ("bad url with spaces", "amazon.com"),
        ],
    )
    check(
        column,
        urls.known_domain,
        [
            ("https://shop.amazon.nl/b/7", "amazon.nl"),
            ("https://amazon.com.au:8443/x", "amazon.com.au"),
            ("https://notamazon.de/x", None),
            ("https://example.com/x", None),
            ("", None),
        ],
    )
    check(
        column,
        urls.url_asin,
        [
            (f"{SHOP}/x/dp/q5t8zk31lm/y", "Q5T8ZK31LM"),
            ("https://shop/gp/product/7777777777", "7777777777"),
            ("https://x/GP/AW/D/b012345678", "B012345678"),
            ("https://shop/dp/short", None),
            ("", None),
            (None, None),
        ],
    )
    check(column, urls.page_asin, [("/product/b012345678", "B012345678"), ("/DP/B012345678", None), ("/dp/B0123456789X", "B012345678")])
    check(column, urls.output_key, [("/dp/B012345678", "B012345678"), ("/gp/product/B012345678", "B012345678"), ("/dp/b012345678", "product"), ("/x", "product")])


def test_first_known_domain(column):
    lists = [["https://example.com", "https://www.amazon.de/a", "https://amazon.fr"], ["https://example.com"], [], None]
    assert column(urls.first_known_domain, lists, "array<string>") == ["amazon.de", None, None, None]


def test_domain_locale(column):
    check(column, urls.domain_locale, [("amazon.de", "de-DE"), ("amazon.com", None), (None, None)])
    check(column, urls.domain_timezone, [("amazon.co.jp", "Asia/Tokyo")])
    assert len(urls.DOMAINS) == 20


def test_asin_is_valid(column):
    rng = random.Random(13)
    signs = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    good = ["".join(rng.choices(signs, k=10)) for _ in range(20)]
    bad = [None, ""] + [v[:-1] for v in good[:3]] + [v + "x" for v in good[:3]] + [v[:6] + sign + v[7:] for v, sign in zip(good, "-_ é/#")]
    check(column, urls.asin_is_valid, [(v, True) for v in good] + [(v, False) for v in bad])


def test_search_url(column):
    from urllib.parse import quote_plus

    terms = ["noise cancelling", "a&b=c/d?e", "über ~*-_.", "100%", "日本語"]
    got = column(lambda q: urls.search_url(F.lit("amazon.com"), q, F.lit(2)), terms)
    assert got == [f"https://amazon.com/s?k={quote_plus(t)}&page=2" for t in terms]
    assert column(lambda q: urls.search_url(F.lit("amazon.de"), q), ["x"]) == ["https://amazon.de/s?k=x"]


def test_mask_credentials(column):
    check(
        column,
        urls.mask_credentials,
        [
            ("proxy http://u:p@host:1 failed", "proxy http://***:***@host:1 failed"),
            ("http://a:b@c and http://d@e", "http://***:***@c and http://***:***@e"),
            ("https://host/x then mail me@home", "https://***:***@home"),
            ("nothing here", "nothing here"),
            ("", ""),
            (None, None),
        ],
    )


def test_split_urls(column):
    assert column(urls.split_urls, ["https://a/dp/X\nhttps://b/dp/Y\n", " \r\n a b \r\n", "", None]) == [
        ["https://a/dp/X", "https://b/dp/Y"], ["a b"], [], None]


def test_seller_labels(column):
    check(column, sellers.normalize_seller, [("Sold by: Acme Inc.", "acme inc"), (" Visit the Sony ", "sony"), ("Brand: X!", "x")])
    check(column, sellers.is_marketplace_seller, [("Amazon", True), ("Sold by Amazon.com", True), ("Amazing", False), (None, False)])


def test_image_size(column):
    check(
        column,
        products.is_large_image,
        [("a._SX199_.jpg", False), ("a._SX200_.jpg", True), ("a._AC_US40_.jpg", False), ("a.jpg", True)],
    )
    check(column, products.image_base, [("i/61O._AC_SL1500_.jpg", "i/61O.jpg"), ("i/61O.jpg", "i/61O.jpg")])


def test_review_values(column):
    check(
        column,
        reviews.helpful_votes,
        [
            ("3 people found this helpful", 3),
            ("1 person found this helpful", 1),
            ("One person found this helpful", 1),
            ("ten people found this helpful", 10),
            ("1,234 people found this helpful", 234),
            ("Eleven people found this helpful", None),
            ("helpful", None),
            (None, None),
        ],
    )
    check(
        column,
        reviews.review_date,
        [
            ("Reviewed in the United States on January 5, 2025", "January 5, 2025"),
            ("Rezension aus Deutschland am 5. Januar 2025", "5. Januar 2025"),
            ("Rezension aus Deutschland vom 5. Januar 2025", "Rezension aus Deutschland vom 5. Januar 2025"),
        ],
    )
    check(column, reviews.review_rating, [("5.0 out of 5 stars", "5.0"), ("5,0 von 5", "5,0 von 5"), (None, None)])


@pytest.mark.parametrize(
    ("error", "kind", "captcha", "stage"),
    [
        ("Timeout 15000ms exceeded 503", "TimeoutError", True, "timeout"),
        ("navigation failed", "Error", True, "captcha"),
        ("still there", "CaptchaError", False, "captcha"),
        ("net::ERR_ABORTED 503 Service Unavailable", "Exception", False, "blocked"),
        ("Rate   limit hit", None, None, "blocked"),
        ("proxy http://503:robot@x died", "Error", False, "navigation"),
        ("boom", "RuntimeError", False, "navigation"),
    ],
)
def test_error_stage(spark, error, kind, captcha, stage):
    row = spark.createDataFrame([(error, kind, captcha)], "e string, k string, c boolean")
    assert row.select(outcomes.error_stage(F.col("e"), F.col("k"), F.col("c"))).first()[0] == stage


def test_values_inside_lambdas_are_worked_out_once(spark):
    """A pattern looked for in each hit is one expression of the plan, as is the fold over a seller's ratings."""
    from pyspark.sql import functions as F

    from shelfmark.functions.text import extract, filled, first_of
    from shelfmark.operators.sellers import seller_rating

    rows = spark.createDataFrame([(["", "ab", "x7"],), ([None],), ([],)], "v array<string>")
    found = rows.select(first_of(F.col("v"), lambda text: extract(text, r"\d")).alias("d"), first_of(F.col("v"), filled).alias("f"))
    assert [tuple(r) for r in found.collect()] == [("7", "ab"), (None, None), (None, None)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 1
    hits = "array<struct<text:string>>"
    rated = spark.createDataFrame([], f"r {hits}, b array<struct<stars:{hits}>>").select(seller_rating(F.col("r"), F.col("b")).alias("s"))
    plan = rated.select("s.rating", "s.count")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1
