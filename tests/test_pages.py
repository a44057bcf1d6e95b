"""Fields of single pages: products, deals, sellers, search cards, reviews, gates."""

import re

import pytest
from pyspark.sql import functions as F

from shelfmark import rules
from shelfmark.operators import outcomes, products, reviews, search
from shelfmark.rules import DEFAULT_RULES, Rule, rules_from_table, rules_table, with_rules
from shelfmark.schemas import PRODUCT

URL = "https://shop.example/item"


@pytest.fixture(scope="module")
def parsed(spark, request):
    """Products of every parametrized page of this module, from one job."""
    params = [item.callspec.params for item in request.session.items if item.module is request.module and hasattr(item, "callspec")]
    keys = {(p.get("url") if "asin" in p else URL, p["html"], None) for p in params if "html" in p}

    def run(keys):
        rows = [(str(n), *key) for n, key in enumerate(keys)]
        pages = spark.createDataFrame(rows, "n string, url string, html string, rendered_html string")
        found = {row.n: row for row in products.extract_products(pages, keep=["n"]).collect()}
        return {key: found[str(n)] for n, key in enumerate(keys)}

    done = run(list(keys))

    def product(html, url=URL, rendered=None):
        key = (url, html, rendered)
        if key not in done:
            done.update(run([key]))
        return done[key]

    return product


@pytest.fixture
def product(parsed):
    return parsed


@pytest.fixture
def cards(spark):
    def run(html, domain="www.amazon.com"):
        pages = spark.createDataFrame([("q", domain, 1, html)], "query string, domain string, page_num int, html string")
        return search.extract_search(pages).orderBy("card_pos").collect()

    return run


# Pages are made from the rules themselves: markup that a selector finds, around a text of ours.
_PIECE = re.compile(r"^(?P<tag>[a-z][\w-]*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)(?:[*^$]?=[\"'](?P<value>[^\"']*)[\"'])?\]")


def markup(selector, inner="", **attrs):
    """Nested elements, one for each compound of a selector."""
    for compound in reversed(selector.split(",")[0].split()):
        tag, have, classes = "em", dict(attrs), []
        for piece in _PIECE.finditer(compound):
            if piece["tag"]:
                tag = piece["tag"]
            elif piece["cls"]:
                classes.append(piece["cls"])
            else:
                have["id" if piece["id"] else piece["attr"]] = piece["id"] or piece["value"] or ""
        if classes:
            have["class"] = " ".join(classes)
        inner = f"<{tag}" + "".join(f' {k.replace("_", "-")}="{v}"' for k, v in have.items()) + f">{inner}</{tag}>"
        attrs = {}
    return inner


PLAIN = re.compile(r"[\w#.\s='\"*\[\]/-]+")
RANKED = [
    (field, rank, selector)
    for field, selectors in {"price": rules.PRICE, "rating": rules.RATING, "review_count": rules.REVIEW_COUNT, "availability": rules.AVAILABILITY, "title": rules.TITLE}.items()
    for rank, selector in enumerate(selectors, 1)
    if PLAIN.fullmatch(selector)
]
SHOWN = {"price": ("£ 48.30", "£ 48.30"), "rating": ("3,6 von 5 Sternen", "3.6 out of 5"), "review_count": ("8.051 Bewertungen", "8051"), "availability": ("Only two left", "Only two left"), "title": ("Lamp, oak", "Lamp, oak")}


@pytest.mark.parametrize(("field", "rank", "selector"), RANKED)
def test_every_selector_feeds_its_field(parsed, field, rank, selector):
    text, value = SHOWN[field]
    assert parsed(f"<main>{markup(selector, text)}</main>")[field] == value


def test_lower_ranks_win(product):
    for field, selectors in {"price": rules.PRICE, "title": rules.TITLE}.items():
        first, last = selectors[0], selectors[-1]
        one, two = {"price": ("₹ 7", "₹ 8"), "title": ("seven", "eight")}[field]
        assert product(markup(last, two) + markup(first, one))[field] == one


def test_a_page_of_all_parts(product):
    sizes = "{&quot;http://p/kx._SL900_.png&quot;:[900,640],&quot;http://p/kx._SX501_.png&quot;:[501,356],&quot;http://p/tiny._SS30_.png&quot;:[30,30]}"
    html = "".join(
        [
            markup("#availability span", "Two left"),
            markup("#feature-bullets li", "Oak and brass") + markup("#feature-bullets li", "OAK and brass") + markup("#feature-bullets li", "five watts"),
            markup("#main-image-container", markup("img", src="http://p/zz.png"), data_a_dynamic_image=sizes),
            markup("#acrCustomerReviewText", "8,051 ratings"),
            markup(".a-icon-alt", "3.6 out of 5 stars"),
            markup("#unifiedPrice_feature_div .a-offscreen", "£48.30"),
            markup("input", name="ASIN", value="B0LAMPOAK7"),
            "<title>Lamp, oak : Amazon.co.uk: Home</title>",
        ]
    )
    row = product(html)
    assert (row.title, row.price, row.rating, row.review_count, row.review_count_n) == ("Lamp, oak", "£48.30", "3.6 out of 5", "8051", 8051)
    assert row.images == ["http://p/zz.png", "http://p/kx._SL900_.png"]
    assert row.bullets == ["Oak and brass", "five watts"]
    assert (row.availability, row.asin) == ("Two left", "B0LAMPOAK7")
    assert row.extraction_quality["price"] == "css: #unifiedPrice_feature_div .a-offscreen"


def test_record_schema(spark, product):
    row = product("<p>nothing")
    assert list(row.asDict())[: len(PRODUCT)] == PRODUCT.fieldNames()
    assert len(PRODUCT) == 35
    assert row.images == [] and row.bullets == [] and row.variants == [] and row.reviews == []
    assert row.is_on_sale is False and row.buybox_owner is False and row.fulfilled_by_amazon is False
    assert row.price is None and row.asin is None and row.schema_version == "1.0"


@pytest.mark.parametrize("html", [None, ""])
def test_absent_page(product, html):
    assert product(html).title is None


@pytest.mark.parametrize(
    ("html", "price"),
    [
        ("<div id='corePrice_desktop'><i class='a-offscreen'>label</i></div><i id='priceblock_ourprice'>£5</i>", "£5"),
        # Only the first element of a selector counts.
        ("<div id='corePrice_desktop'><i class='a-offscreen'>label</i><i class='a-offscreen'>$9</i></div>", None),
        ("<i class='a-price'><i class='a-offscreen'>12</i></i>", "12"),
        ("<div id='CardInstance9'><i class='a-price'><i class='a-offscreen'>$1</i></i></div>", None),
        ("<i class='a-price a-text-price'><i class='a-offscreen'>$1</i></i>", None),
        ("<i class='a-price'></i><i class='a-price'><i class='a-offscreen'>$2</i></i>", "$2"),
    ],
)
def test_static_price(product, html, price):
    assert product(html).price == price


def test_rendered_price_only_without_a_static_one(product):
    shown = "<div id='priceblock_ourprice'>from US$ 1,299.99 now</div>"
    assert product("<p>", rendered=shown).price == "$ 1,299.99"
    assert product("<p>", rendered="<i id='priceblock_ourprice'>1.234,56 €</i>").price == "1.234,56 €"
    assert product("<i id='priceblock_ourprice'>$1</i>", rendered=shown).price == "$1"
    assert product("<i class='a-price'><i class='a-offscreen'>$3</i></i>", rendered=shown).price == "$3"
    # An empty price component is no price, so the rendered page still counts.
    assert product("<i class='a-price'></i>", rendered=shown).price == "$ 1,299.99"


@pytest.mark.parametrize(
    ("html", "title"),
    [
        ("<title>A : Amazon.de: B</title>", "A"),
        ("<title>a : AMAZON.com</title>", "a"),
        ("<title>A | B</title>", "A | B"),
        ("<i id='productTitle'> </i><title>T</title>", "T"),
        ("<i id='productTitle'>X : Amazon.de</i>", "X : Amazon.de"),
    ],
)
def test_title(product, html, title):
    assert product(html).title == title


@pytest.mark.parametrize(
    ("html", "brand"),
    [
        ("<a id='bylineInfo'>visit the Ember &amp; Oak shop</a>", "Ember & Oak"),
        ("<a id='bylineInfo'>Brand:Ember Brand</a>", "Ember"),
        ("<a id='bylineInfo'>Marke: Ember</a>", "Marke: Ember"),
        ("<a class='brand-link'> Acme </a>", "Acme"),
        ("<a href='/stores/brand/x'>Acme</a>", "Acme"),
        ("<table id='prodDetails'><tr><th>Brand Name<td>Acme</table><a id='bylineInfo'>Other</a>", "Acme"),
        ("<table id='prodDetails'><tr><th>Brandy<td>no</table><a id='bylineInfo'>Other</a>", "Other"),
        ("<div id='productOverview_feature_div'><table><tr><td>Brand<td>Acme</table></div>", "Acme"),
        ("<table><tr class='po-brand'><td class='a-span3'>Brand<td class='a-span9'>Acme</table>", "Acme"),
        ("<p>", None),
    ],
)
def test_brand(product, html, brand):
    assert product(html).brand == brand


@pytest.mark.parametrize(
    ("url", "html", "asin"),
    [
        ("https://x/dp/b0abcdef12", "", "B0ABCDEF12"),
        ("https://x/dp/B0ABCDEF123", "<p>", "B0ABCDEF12"),
        ("https://x/y", "<meta name='asin' content='short'><meta name='asin' content='b0abcdef12'>", "b0abcdef12"),
        ("https://x/y", "<input name='ASIN' value='B0ABCDEF12'>", "B0ABCDEF12"),
        ("https://x/y", "<input name='ASIN' value='B0'><input name='ASIN' value='B0ABCDEF12'>", None),
    ],
)
def test_asin(product, url, html, asin):
    assert product(html, url=url).asin == asin


def test_sale(product):
    row = product(
        markup("#priceblock_dealprice", "$61.20") + markup("#listPrice .a-offscreen", "$73.05") + markup(".dealLabel", "Ends at noon")
    )
    assert (row.price, row.original_price, row.deal_type) == ("$61.20", "$73.05", "Ends at noon")
    assert (row.is_on_sale, row.savings_amount, row.discount_percentage) == (True, "$11.85", "16%")


@pytest.mark.parametrize(
    ("html", "original"),
    [
        ("<div class='a-text-price'><span>List Price: CDN$ 73.05</span></div>", "CDN$ 73.05"),
        ("<div class='a-text-price'><span>List Price: 2.480,15 €</span></div>", "2.480,15 €"),
        ("<div class='a-text-price'><span>Was: $73.05</span></div>", "$73.05"),
        ("<div class='a-text-price'><span>No deal here</span></div>", None),
        ("<div class='a-text-price'>$7</div>", None),
    ],
)
def test_original_price(product, html, original):
    assert product(html).original_price == original


@pytest.mark.parametrize(
    ("html", "deal", "sale"),
    [
        ("<i class='a-badge-span'>New</i><i class='a-badge-span'>Save 5</i>", "Save 5", True),
        ("<i class='a-badge-span'>Best</i>", None, False),
        ("<i class='couponBadge'></i>", "Coupon", True),
        ("<i class='couponBadge'></i><i id='saleBadge'>Sale!</i>", "Sale!", True),
        ("<div class='a-row a-spacing-mini'><i class='a-color-price'>$5</i></div>", "$5", True),
    ],
)
def test_deal(product, html, deal, sale):
    row = product(html)
    assert (row.deal_type, row.is_on_sale) == (deal, sale)


SHOP_NAME = "Nordlicht Handel"
NAMED = markup("#merchantInfo", SHOP_NAME)


@pytest.mark.parametrize(
    ("html", "owner"),
    [
        # The box names a seller: in one text, split over a label and a link, or in the label's element.
        (markup("#buybox", markup("u", f"SOLD BY : {SHOP_NAME.upper()},")) + NAMED, True),
        (markup("#buybox", markup("u", "sold by Südlicht Handel")) + NAMED, False),
        (markup("#BuyBox", markup("section", "sold  by") + markup("a", SHOP_NAME)) + NAMED, True),
        (markup("#BuyBox", markup("section", f"Sold by <q>{SHOP_NAME}</q>")) + NAMED, True),
        # The marketplace itself needs no seller on the page.
        (markup("#addToCart_feature_div", markup("a", "Sold by Amazon")), True),
        # The box names nobody: the seller's name has to be in its text, whatever elements it is split over.
        (markup("#centerCol", "from <b>nordlicht</b><i>HANDEL</i> today") + NAMED, True),
        (markup("#buybox", "add to cart") + markup("#centerCol", SHOP_NAME) + NAMED, False),
        # There is no box.
        (f"<footer>Sold by: {SHOP_NAME}</footer>{NAMED}", False),
    ],
)
def test_buybox_owner(product, html, owner):
    assert product(html).buybox_owner is owner


@pytest.mark.parametrize(
    ("html", "flag"),
    [
        # A box hides notes elsewhere; without a box the page's notes count.
        (markup("#centerCol", "empty") + "<aside>sold by amazon</aside>", False),
        (markup("#centerCol", "<u>Sold by Amazon EU</u>"), True),
        ("<aside>we say: SHIPS FROM AMAZON, quick</aside>", True),
        ("<aside>ships <u>from</u> amazon</aside>", False),
        # The tabular box is read with its elements joined without a gap.
        (markup("#tabular-buybox", "<u>fulfilled by</u> amazon"), False),
        (markup("#tabular-buybox", "stock, fulfilled by amazon, here"), True),
        ("<aside>quick delivery</aside>", False),
    ],
)
def test_fulfilment(product, html, flag):
    assert product(html).fulfilled_by_amazon is flag


@pytest.mark.parametrize(
    ("html", "place"),
    [
        (markup("#buybox", "<u>Ships from: Riga</u>") + "<aside>Ships from: Porto</aside>", "Riga"),
        (markup("#buybox", "<u>no place</u>") + "<aside>Ships from: Porto</aside>", None),
        ("<aside>today ships from:   Porto</aside>", "Porto"),
        (markup("#shipsFromDetail", "ships from Riga Depot") + "<aside>Ships from: Porto</aside>", "Riga Depot"),
        (markup("#ubb-ufss-slot", "uk"), None),
    ],
)
def test_ships_from(product, html, place):
    assert product(html).ships_from == place


@pytest.mark.parametrize(
    ("html", "name"),
    [
        ("<a id='bylineInfo'>Visit the Ember shop</a>", "Ember shop"),
        ("<a id='merchant-info'>See more</a><a id='byline'>Acme</a>", "Acme"),
        ("<a id='merchant-info'>Seeds Co</a>", None),
        ("<p>Sold by:</p><a>X</a>", None),
        ("<p>Sold by: <span>Acme</span></p>", "Acme"),
        ("<div><b class='tabular-buybox-text'>a</b><b class='tabular-buybox-text'><span>Acme</span></b></div>", "Acme"),
    ],
)
def test_seller_name(product, html, name):
    assert product(html).seller_name == name


@pytest.mark.parametrize(
    ("html", "rating", "count"),
    [
        ("<a id='sellerProfileTriggerId'>3.8 out of 5 stars, 6,302 ratings</a>", "3.8", "6302"),
        ("<a id='sellerProfileTriggerId'>4.5 out of 5</a><a id='avgRating'>3.0 out of 5, 7 reviews</a>", "3.0", "7"),
        ("<a id='sellerProfileTriggerId'>4.5 out of 5, 9 ratings</a><a id='avgRating'>3.0 out of 5</a>", "4.5", "9"),
        ("<a id='avgRating'>3.0 out of 5</a><div id='feedbackSummaryTable'><i class='stars'>4.9 stars</i></div>", "4.9", None),
        ("<div class='feedbackDetailStars'><i class='stars'>none</i></div>", "none", None),
        ("<p>", None, None),
    ],
)
def test_seller_rating(product, html, rating, count):
    row = product(html)
    assert (row.seller_rating, row.seller_rating_count) == (rating, count)


TO_KETTLE = markup("a.a-link-normal.s-link-style", "<u>Kettle</u>", href="/dp/B0KETTLE44")


def card(body, link=TO_KETTLE):
    return f"<main><section data-component-type='s-search-result'>{body}{link}</section></main>"


def priced(whole=None, fraction=None, symbol=None, text="", hidden=None):
    parts = [("a-price-symbol", symbol), ("a-price-whole", whole), ("a-price-fraction", fraction), ("a-offscreen", hidden)]
    return markup(".a-price", text + "".join(markup(f".{name}", value) for name, value in parts if value is not None))


@pytest.mark.parametrize(
    ("body", "price"),
    [
        # Commas in the whole part: a decimal point follows. Points: they go, and a comma follows.
        (priced("12,480", "05", "₹"), "₹12,480.05"),
        (priced("3.070", "40", "€"), "€3070,40"),
        (priced("3.070", None, "€"), "€3070"),
        (priced("63", "", "$"), "$63"),
        # The symbol may stand in the block's text alone; without any the number is bare.
        (priced("18", text="¥"), "¥18"),
        (priced("18"), "18"),
        # Without a whole part the hidden text counts, if it is money.
        (priced(hidden="£ 72.15"), "£ 72.15"),
        (priced(hidden="72.15"), None),
        ("", None),
    ],
)
def test_card_price(cards, body, price):
    assert cards(card(body))[0].price == price


def test_card_fields(cards):
    parts = markup("i.a-icon-star-small", "2,9 su 5 stelle") + markup("a.a-size-base", "6.302", href="/kettle#customer-reviews") + markup("i.a-icon-prime-small")
    row = cards(card(parts), "www.amazon.it")[0]
    assert (row.url, row.asin, row.title) == ("https://www.amazon.it/dp/B0KETTLE44", "B0KETTLE44", "Kettle")
    assert (row.rating, row.review_count, row.is_prime) == ("2.9 out of 5", "6302", True)


def to(kind, href):
    return markup(kind, "Kettle", href=href)


@pytest.mark.parametrize(
    ("link", "url"),
    [
        (to("h2 a.a-link-normal", ""), None),
        (markup("h2", to("a.a-link-normal", "/Copper-Kettle/dp/B0KETTLE44/ref=x?a=1&amp;b=2")), "https://www.amazon.com/Copper-Kettle/dp/B0KETTLE44"),
        (markup("h2", to("a.a-text-normal", "https://shop.test/product/kettle-9/?c=3")), "https://shop.test/product/kettle-9/"),
        (to("a.a-link-normal.s-link-style", "gp/product/B0KETTLE44"), "https://www.amazon.com/gp/product/B0KETTLE44"),
        (to("a.a-link-normal.s-link-style", "go/gp/product/B0KETTLE44"), "https://www.amazon.com/go/gp/product/B0KETTLE44"),
        (markup("h2", to("a.a-link-normal", "/kettles/B0KETTLE44")), None),
        (markup("h2 u", "Kettle"), None),
        # The best ranked link decides, even if another one would lead to a product.
        (markup("h2", to("a.a-text-normal", "/dp/B0KETTLE44") + to("a.a-link-normal", "/help")), None),
    ],
)
def test_card_url(cards, link, url):
    assert [row.url for row in cards(card("", link))] == ([url] if url else [])


def test_cards_of_a_page_are_distinct_and_in_order(cards):
    links = [f"<h2><a class='a-link-normal' title='{t}' href='/dp/B00000000{n}'>x</a></h2>" for n, t in [(1, "a"), (2, "b"), (1, "c")]]
    html = "".join(card("", link) for link in links)
    assert [(row.card_pos, row.title) for row in cards(html)] == [(1, "a"), (2, "b")]


def test_review_fields(spark):
    def review(**parts):
        return markup('[data-hook="review"]', "".join(markup(f'[data-hook="{hook.replace("_", "-")}"]', text) for hook, text in parts.items()))

    html = review(
        helpful_vote_statement="Seven people found this helpful", avp_badge=" Verified Purchase ", review_date="Bewertet am 9. Mai 2021",
        review_star_rating="1.5 out of 5 stars", review_body="<span>Boils <u>slowly</u></span> read more",
    ) + review(review_body="No frame", avp_badge="bought elsewhere", review_star_rating="two stars", helpful_vote_statement="12 people  found this helpful")
    pages = spark.createDataFrame([("https://x/dp/B0KETTLE44", 4, html)], "url string, round int, html string")
    first, second = reviews.extract_reviews(pages).orderBy("pos").collect()
    assert (first.asin, first.round, first.pos, first.text) == ("B0KETTLE44", 4, 0, "Boilsslowly")
    assert (first.rating, first.date, first.verified, first.helpful_votes) == ("1.5", "9. Mai 2021", True, 7)
    assert (second.text, second.rating, second.date, second.verified, second.helpful_votes) == ("No frame", "two stars", None, False, 12)


def test_gate_pages(spark):
    htmls = ["<form id='captcha-form'>", "<input name='captcha'>", "<title>Robot Check</title>", "<title>CAPTCHA</title>", "<title>Deals</title>", None]
    pages = spark.createDataFrame([(str(i), h) for i, h in enumerate(htmls)], "url string, html string")
    rows = outcomes.page_quality(pages).orderBy("url").collect()
    assert [row.is_gate for row in rows] == [True, True, True, True, False, False]


def test_rules_are_data(spark):
    stored = rules_table(spark)
    assert stored.count() == len(DEFAULT_RULES)
    product_rules = rules_from_table(stored, "product")
    more = with_rules(product_rules, Rule("product", "", "title", 0, "h1.name"))
    pages = spark.createDataFrame([("u", "<h1 class='name'>Mine</h1>")], "url string, html string")
    row = products.parse_products(products.product_hits(pages, rules=more), rules=more).first()
    assert row.title == "Mine" and row.extraction_quality["title"] == "css: h1.name"
    with pytest.raises(ValueError):
        rules_from_table(spark.range(6000).select(*(F.lit("x").alias(n) if n != "rank" else F.col("id").cast("int").alias("rank") for n in stored.columns)))


def test_each_rule_has_its_own_pattern_form_and_attributes(spark):
    more = with_rules(
        rules_from_table(rules_table(spark), "product"),
        Rule("product", "", "availability", 0, ".note", attrs="data-day", pattern="^ok"),
        Rule("product", "", "price", 0, ".bare"),
    )
    htmls = ["<p class=note data-day=5>bad</p><p class=bare>12</p>", "<p class=note data-day=5>ok then</p>", "<p id=deliveryBlockMessage data-day=6>soon</p>"]
    pages = spark.createDataFrame([(str(i), h) for i, h in enumerate(htmls)], "url string, html string")
    one, two, three = products.product_hits(pages, rules=more).orderBy("url").collect()
    assert one.availability == [] and [h.text for h in one.price] == ["12"]
    assert [(h.text, h.attrs) for h in two.availability] == [("ok then", {"data-day": "5"})]
    assert [(h.text, h.attrs) for h in three.availability] == [("soon", None)]


def test_clean_up_moves_with_its_rule(spark):
    swapped = [rules.replace(r, rank=3 - r.rank) if (r.scope, r.field) == ("", "title") else r for r in products.DEFAULT]
    pages = spark.createDataFrame([("u", "<h1 id=productTitle>A : Amazon.de</h1>"), ("v", "<title>B : Amazon.de</title>")], "url string, html string")
    for table in (products.DEFAULT, swapped):
        got = {r.url: r.title for r in products.extract_products(pages, rules=table).collect()}
        assert got == {"u": "A : Amazon.de", "v": "B"}


def test_rules_of_a_field_have_one_mode(spark):
    mixed = [*products.DEFAULT, Rule("product", "", "title", 9, "h2", mode="all")]
    pages = spark.createDataFrame([("u", "<h2>x")], "url string, html string")
    with pytest.raises(Exception, match="different modes"):
        products.product_hits(pages, rules=mixed).collect()


def test_old_rule_tables_have_no_clean_up(spark):
    old = rules_table(spark).drop("clean")
    assert all(rule.clean is None for rule in rules_from_table(old))


def test_a_gate_is_told_in_the_same_pass(spark):
    htmls = ["<title>Robot Check</title>", "<title>Robot Check</title><b id=dp></b>", "<p>nothing"]
    pages = spark.createDataFrame([(str(i), h) for i, h in enumerate(htmls)], "url string, html string")
    assert [r.is_gate for r in products.extract_products(pages, gate=True).orderBy("url").collect()] == [True, False, False]
