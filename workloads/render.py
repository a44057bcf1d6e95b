"""Captured pages rendered by Spark from the given tables.

The tables hold no marketplace markup, so these functions write it: every row
becomes a page whose right extraction is known from the row.  Shapes vary with
the key, so that each selector rank, locale and fallback is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.urls import url_key
from shelfmark.operators.grouping import first_per

SHOP = "https://www.amazon.com"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows become pages: dealt out before it is rendered, while rows are small."""
    return table(spark, sf_dir, name).repartition(spark.sparkContext.defaultParallelism)


def join(*parts: Column | str) -> Column:
    """Concatenate texts and columns."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def choose(key: Column, *options: Column | str) -> Column:
    """Option number ``key mod n``."""
    out = None
    for at, option in enumerate(options):
        value = F.lit(option) if isinstance(option, str) else option
        test = key % len(options) == at
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def us(number: Column) -> Column:
    """Cents as 1,234.56."""
    return F.format_number(number.cast("decimal(18,0)") / 100, 2)


def eu(number: Column) -> Column:
    """Cents as 1.234,56."""
    return F.translate(us(number), ",.", ".,")


def item_id(key: Column) -> Column:
    return join("B", F.lpad(key.cast("string"), 9, "0"))


def price_text(key: Column, number: Column) -> Column:
    """One of four locales by key."""
    return choose(
        key, join("$", us(number)), join(eu(number), " €"), join("£", us(number)), join("CDN$ ", us(number))
    )


def part_price(part: DataFrame) -> Column:
    return cents(part["p_retailprice"]) + part["p_partkey"] * 1000


def product_url(key: Column) -> Column:
    """With tracking, by key; every third has no item id in its URL."""
    return choose(
        key,
        join(SHOP, "/dp/", item_id(key)),
        join(SHOP, "/item/", key),
        join(SHOP, "/gp/product/", F.lower(item_id(key))),
    )


def product_pages(part: DataFrame) -> DataFrame:
    """``part`` as product pages: key, url, html, rendered_html."""
    key, name, brand = part["p_partkey"], part["p_name"], part["p_brand"]
    price = price_text(key, part_price(part))
    title = choose(
        key,
        join("<title>x</title><h1 id='productTitle'>  ", name, " ", brand, " </h1>"),
        join("<title>", name, " ", brand, " : Amazon.com: Tools</title>"),
    )
    price_block = choose(
        key,
        join("<div id='corePrice_feature_div'><span class='a-price'><span class='a-offscreen'>", price, "</span></span></div>"),
        join("<span id='priceblock_ourprice'>", price, "</span>"),
        join("<div id=apex-pricetopay-accessibility-label> ", price, " </div>"),
        join(
            "<div id='CardInstanceAd1'><span class='a-price'><span class='a-offscreen'>$1.00</span></span></div>"
            "<span class='a-price a-text-price'><span class='a-offscreen'>was nothing</span></span>"
            "<span class='a-price'><span class='a-offscreen'>",
            price,
            "</span></span>",
        ),
        join("<div id='corePrice_desktop'><b class='a-offscreen'>no price</b></div><p id='price_inside_buybox'>", price, "</p>"),
        # No static price on these; the rendered page has it.
        "<div id='corePrice_feature_div'></div>",
    )
    rendered = F.when(
        key % 6 == 5, join("<div id='priceblock_dealprice'>Now only: ", price, " today</div>")
    )
    stars = join((key % 5).cast("string"), choose(key, ",", "."), (key % 10).cast("string"))
    rating = choose(
        key,
        join("<span data-hook='rating-out-of-text'>", stars, " von 5 Sternen</span>"),
        join("<i><span class='a-icon-alt'>", stars, " out of 5 stars</span></i>"),
        join("<span data-hook=rating-out-of-text>n/a</span><span class=a-icon-alt>", stars, " sur 5 &eacute;toiles</span>"),
    )
    count = join(
        choose(key, "<span data-hook='total-review-count'>", "<span data-hook='total-review-count'></span><span id='acrCustomerReviewText'>"),
        F.format_number(key * 7 + 1, 0),
        " global ratings</span>",
    )
    bullets = join(
        "<div id='feature-bullets'><ul><li><span>Kind:</span> <b>", part["p_type"], "</b><li>tiny<li><span>KIND: ",
        F.lower(part["p_type"]), "</span></li><li> Size ", part["p_size"], " mm </li></ul></div>",
    )
    weight = join("eight ", part["p_size"], " ")
    bullets = choose(
        key, bullets, join("<div id='feature-bullets'><li>abcd</li><li> W", weight, "g<li>w", weight, "G</li></div>"), "<ul><li>not a bullet</ul>"
    )
    availability = choose(
        key,
        "<div id='availability'><span> In Stock </span></div>",
        "<div id='availability'><span> </span></div><div id='deliveryBlockMessage'>FREE delivery</div>",
        "<div>Sold out elsewhere</div>",
    )
    asin = choose(
        key,
        "",
        F.when(key % 2 == 0, join("<meta name='asin' content='short'><meta name='asin' content='", item_id(key), "'>"))
        .otherwise(join("<form><input type=hidden name='ASIN' value='", item_id(key), "'/></form>")),
        "<meta name='asin' content='WRONGWRONG'>",
    )
    branding = choose(
        key,
        join("<table id='prodDetails'><tr><th>Colour<td>red<tr><th> Brand <td> ", brand, " </table>"),
        join("<a id='bylineInfo'>Visit the ", brand, " Store</a>"),
        join("<a id='bylineInfo'>Brand: ", brand, "</a>"),
        join("<div id='productOverview_feature_div'><table><tr><td>Brand<td>", brand, "</table></div>"),
    )
    base = join("https://img.example/I/", key)
    gallery = join(
        "<div id='imgTagWrapperId' data-a-dynamic-image='{&quot;", base, "._AC_SX300_.jpg&quot;:[300,300],&quot;",
        base, "b._AC_SX600_.jpg&quot;:[600,600],&quot;", base, "c._AC_SL1500_.jpg&quot;:[1500,900],&quot;", base,
        "._AC_SX900_.jpg&quot;:[900,900]}'><img data-old-hires='", base, "._AC_SL1000_.jpg' src='", base,
        "._AC_US40_.jpg'><img src='", base, "d.jpg'></div>",
    )
    gallery = choose(
        key,
        gallery,
        join(
            "<div id='imgTagWrapperId'><img data-old-hires='' src='", base, "._AC_US40_.jpg'><img src='", base, "e._SL500_.jpg'>"
            "<img data-old-hires='", base, "e._SL1500_.jpg' src='", base, "f.jpg'></div>",
        ),
        "<div id='imgTagWrapperId' data-a-dynamic-image='not json'></div>",
    )
    html = join(
        "<!doctype html><html><head>", title, asin, "<script>var a='<div id=productTitle>no</div>'</script></head><body>",
        price_block, rating, count, gallery, bullets, availability, branding, "</body></html>",
    )
    return part.select(
        key.alias("key"),
        product_url(key).alias("url"),
        html.alias("html"),
        rendered.alias("rendered_html"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("captured_at"),
    )


def offer_key(line: DataFrame) -> Column:
    """A lineitem has no key of its own; all its columns tell it apart well enough for a URL."""
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def sale_cents(line: DataFrame) -> tuple[Column, Column]:
    before = cents(line["l_extendedprice"])
    percent = F.round(line["l_discount"] * 100).cast("bigint")
    return before - F.call_function("div", before * percent, F.lit(100)), before


def deal_html(line: DataFrame) -> Column:
    now, before = sale_cents(line)
    kind = line["l_linenumber"] % 7
    was = choose(
        kind,
        join("<div id='listPrice'><span class='a-offscreen'>$", us(before), "</span></div>"),
        join("<span class='a-text-price'>List Price: $", us(before), "</span>"),
        join("<span class='a-text-price'>You save</span><span class='a-text-price'>Was: $", us(before), " </span>"),
        join("<s class='a-text-price'><span class='a-offscreen'>$", us(before), "</span></s>"),
        "",
    )
    deal = (
        F.when(line["l_returnflag"] == "R", F.lit("<div id='dealBadge'> </div><span class='dealLabel'>Lightning Deal</span>"))
        .when(line["l_returnflag"] == "A", F.lit("<i class='a-badge-span'>New</i><i class='a-badge-span'>10% Off today</i>"))
        .otherwise(F.lit("<i class='a-badge-span'>Brand New</i>"))
    )
    coupon = F.when(line["l_linestatus"] == "O", F.lit("<div class='a-section couponClippableBlock'></div>")).otherwise(F.lit(""))
    return join(
        "<body><div id='corePriceDisplay_desktop_feature_div'><span class='aok-offscreen'>$", us(now), " </span></div>",
        was, deal, coupon, "</body>",
    )


def deal_pages(line: DataFrame) -> DataFrame:
    """``lineitem`` as pages with a current price, an original price and deal markup."""
    return line.select(offer_key(line).alias("url"), deal_html(line).alias("html"))


def seller_html(line: DataFrame) -> Column:
    own = join("Supplier#", F.lpad(line["l_suppkey"].cast("string"), 9, "0"))
    rival = join("Supplier#", F.lpad(((line["l_suppkey"] + 1) % 7).cast("string"), 9, "0"))
    kind, flag = line["l_linenumber"] % 7, line["l_returnflag"]
    byline = F.when(
        kind == 6, join("<p><b>Sold by:</b> <a>", own, "</a>")
    ).otherwise(join("<div id='merchant-info'>See more</div><span id='byline'>Visit the ", own, "</span>"))
    box = choose(
        kind,
        join("<div id='buybox'><span>Sold by: ", own, ".</span></div>"),
        join("<div id='buybox'><span>Sold by ", rival, "</span></div>"),
        "<div id='buybox'><a>Sold by Amazon</a></div>",
        join("<div id='addToCart_feature_div'><span class='x'>Sold by</span> <a>", own, "</a></div>"),
        join("<div id='centerCol'>Offer of <i>", own, "</i></div>"),
        "<div id='BuyBox'>nobody</div>",
        "",
    )
    note = F.when(flag == "R", F.lit("<p id='footer'>Fulfilled by Amazon</p>")).otherwise(F.lit("<p>thanks</p>"))
    tabular = F.when(
        flag == "A", F.lit("<div id='tabular-buybox'><span>Ships from Amazon</span></div>")
    ).otherwise(F.lit(""))
    stars = join((line["l_quantity"] % 5).cast("int"), ".", line["l_linenumber"] % 10)
    rating = join(
        "<a id='sellerProfileTriggerId'>", stars, " out of 5 stars</a><span id='merchant-vars'> </span>"
        "<span id='avgRating'>", F.format_number(line["l_partkey"] + 1000, 0), " ratings</span>",
    )
    ships = F.when(line["l_linestatus"] == "O", join("<div id='shipsFrom'>Ships from Nation", line["l_suppkey"], "</div>")).otherwise(F.lit(""))
    return join("<body>", byline, box, tabular, note, rating, ships, "</body>")


def seller_pages(line: DataFrame) -> DataFrame:
    """``lineitem`` as pages with seller, buy box, fulfilment and ships-from markup."""
    return line.select(offer_key(line).alias("url"), seller_html(line).alias("html"))


def offer_pages(line: DataFrame) -> DataFrame:
    """``lineitem`` as whole product pages: title, id, price, deal and seller."""
    head = join(
        "<h1 id='productTitle'> Offer ", line["l_partkey"], " </h1><meta name='asin' content='", item_id(line["l_partkey"]), "'>"
        "<span data-hook='rating-out-of-text'>4.5 out of 5</span><div id='availability'><span>In Stock</span></div>",
    )
    return line.select(offer_key(line).alias("url"), join(head, deal_html(line), seller_html(line)).alias("html"))


CARDS_PER_PAGE = 2


def card_rows(line: DataFrame) -> DataFrame:
    """Lineitems as result cards of the query "order <key>": page and position by line number.

    Lines of an order with one number are one card more; repeats of a part in an
    order are repeats of a URL.
    """
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return line.select("l_orderkey", *order, "l_quantity", "l_returnflag").withColumn(
        "page_num", F.call_function("div", F.col("l_linenumber") + 1, F.lit(CARDS_PER_PAGE)).cast("int")
    )


def search_pages(line: DataFrame) -> DataFrame:
    """One result page per order and page number; an order lists at most a few dozen lines."""
    rows = card_rows(line)
    key, price = F.col("l_partkey"), cents(F.col("l_extendedprice"))
    whole, part = F.floor(price / 100), F.lpad((price % 100).cast("string"), 2, "0")
    german = F.col("l_partkey") % 2 == 1
    parts = join(
        "<div class='a-price'><span class='a-price-symbol'>", F.when(german, F.lit("€")).otherwise(F.lit("$")),
        "</span><span class='a-price-whole'>",
        F.when(german, F.translate(F.format_number(whole, 0), ",", ".")).otherwise(F.format_number(whole, 0)),
        "</span><span class='a-price-fraction'>", part, "</span></div>",
    )
    hidden = join("<div class='a-price'><span class='a-offscreen'>$", us(price), "</span></div>")
    link = choose(
        key,
        join("<h2><a class='a-link-normal' title='Part ", key, "' href='/dp/", item_id(key), "/ref=sr_1?qid=1&amp;sr=2'>x</a></h2>"),
        join("<h2><a class='a-text-normal' href='", SHOP, "/gp/product/", item_id(key), "?th=1'> Part <b>", key, "</b></a></h2>"),
        join("<a class='a-link-normal s-link-style' href='x/dp/", item_id(key), "'>Part ", key, "</a>"),
        join("<h2><a class='a-link-normal' href='/some/other/path'>no product ", key, "</a></h2>"),
    )
    card = join(
        "<div data-component-type='s-search-result'>", link, F.when(key % 3 == 0, hidden).otherwise(parts),
        "<i class='a-icon-star-small'><span class='a-icon-alt'>", key % 5, ",", key % 10, " von 5</span></i>",
        choose(key, "<span class='a-size-base s-underline-text'>", "<span class='a-size-base' aria-label='12 ratings'>"),
        F.format_number(key + 999, 0), "</span>",
        F.when(F.col("l_returnflag") == "R", F.lit("<i class='a-icon a-icon-prime'></i>")).otherwise(F.lit("")), "</div>",
    )
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", card.alias("card"))
    pages = rows.groupBy("l_orderkey", "page_num").agg(F.sort_array(F.collect_list(item)).alias("cards"))
    body = F.array_join(F.transform("cards", lambda c: c["card"]), "\n")
    return pages.select(
        join("order ", F.col("l_orderkey")).alias("query"),
        F.lit("www.amazon.com").alias("domain"),
        "page_num",
        join("<html><body>", body, "<a class='s-pagination-next' href='/s?k=x&page=2'>Next</a></body></html>").alias("html"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("captured_at"),
    )


def review_pages(conversations: DataFrame) -> DataFrame:
    """Conversations as review rounds of a product: three turns make a round, and each
    round shows the one before again (as a page that grows does)."""
    conv, turn = F.col("conv_id"), F.col("turn")
    stars = join(turn % 5, ".0")
    text = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    votes = choose(turn, join(turn, " people found this helpful"), "<b>Two</b> people found this helpful", "", "Helpful")
    review = join(
        "<div data-hook='review'><span data-hook='review-body'><span>", text, "</span></span>",
        "<i data-hook='review-star-rating'>", stars, F.when(turn % 2 == 0, F.lit(" out of 5 stars")).otherwise(F.lit(" von 5")),
        "</i>", F.when(turn % 3 == 2, F.lit("")).otherwise(join("<span data-hook='review-date'>Reviewed in Spain on May ", turn + 1, ", 2024</span>")),
        F.when(F.col("role") == "user", F.lit("<b data-hook='avp-badge'>Verified Purchase</b>")).otherwise(F.lit("")),
        "<span data-hook='helpful-vote-statement'>", votes, "</span></div>",
    )
    first = F.call_function("div", turn, F.lit(3)).cast("int") + 1
    # The third round comes late, after three without anything new.
    rounds = F.explode(F.array(first, first + 1))
    shown = conversations.select(conv.alias("conv_id"), turn.alias("turn"), review.alias("review"), rounds.alias("round"))
    late = F.when(F.col("round") >= 3, F.col("round") + 3).otherwise(F.col("round"))
    pages = (
        shown.withColumn("round", late)
        .groupBy("conv_id", "round")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "review"))).alias("items"))
    )
    return pages.select(
        join(SHOP, "/dp/", item_id(F.col("conv_id"))).alias("url"),
        "round",
        join("<body>", F.array_join(F.transform("items", lambda i: i["review"]), ""), "</body>").alias("html"),
    )


def snapshot_rows(events: DataFrame) -> DataFrame:
    """Events as stored captures: the user stands for the URL, the time for the write."""
    url = join(SHOP, "/dp/", item_id(F.col("user_id")))
    return events.select(
        "event_id",
        url_key(url).alias("url_key"),
        url.alias("url"),
        F.when(F.col("event_type") != "error", F.col("props")).alias("html"),
        F.col("ts").cast("timestamp").alias("cached_at"),
        F.when(F.col("event_type") != "signup", F.floor(F.col("value") * 36_000).cast("int")).alias("ttl_seconds"),
        F.when(F.col("event_type") == "purchase", F.lit("0")).otherwise(F.lit("1")).alias("version"),
        F.when(F.col("event_type") != "click", F.col("event_type") != "signup").alias("meta_ok"),
    )


def snapshot_files(pages: DataFrame, as_of: str) -> DataFrame:
    """``pages`` as files (name, text) of a snapshot directory.  Page number mod 6: 0 valid, 1 expired,
    2 of another version, 3 with broken meta data, 4 without any, 5 without a page.

    Files are named by URL, so of several pages with one URL the last number counts, whole: else tasks would write
    one file at a time, and a page of one capture lie beside the meta data of another."""
    pages = first_per(pages, ["url"], [F.col("page_id").desc()])
    kind, name = F.col("page_id") % 6, url_key(F.col("url"))
    now = F.unix_timestamp(F.lit(as_of))
    meta = F.to_json(
        F.struct(
            "url",
            F.when(kind == 1, now - 7200).otherwise(now - 60).cast("double").alias("cached_at"),
            F.lit(3600).alias("ttl_seconds"),
            F.when(kind == 2, "0").otherwise("1").alias("version"),
        )
    )
    meta = F.when(kind == 3, F.substring(meta, 1, 9)).otherwise(meta)
    html = pages.where(kind != 5).select(join(name, ".html").alias("name"), F.col("html").alias("text"))
    return html.union(pages.where(kind != 4).select(join(name, ".meta.json"), meta))


def write_files(files: DataFrame, folder: str) -> None:
    """Each row (name, text) as a file of that name; a task that is run again writes the same."""

    def write(rows) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for row in rows:
            with store.open_output_stream(f"{base}/{row.name}") as out:
                out.write(row.text.encode())

    files.foreachPartition(write)
