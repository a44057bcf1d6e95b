"""The page helper: tolerance of captured markup, texts, and the selector subset."""

import random
import time

import pytest

from shelfmark import rules
from shelfmark.operators._markup import Document, Selector
from shelfmark.operators.hits import _Field, _fields


def select(html, css, scope_css=None):
    selector = Selector(css)
    scope = Selector(scope_css) if scope_css else None
    doc = Document(html, frozenset(selector.keys() | (scope.keys() if scope else set())))
    start = scope.first(doc, 0) if scope else 0
    found = selector.all(doc, start)
    first = selector.first(doc, start)
    assert first == (found[0] if found else None)
    return [doc.text(i, "tight") for i in found]


@pytest.mark.parametrize(
    ("html", "css", "texts"),
    [
        ("<p id=a>x<p id=b>y", "p", ["x", "y"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "li", ["a", "bc", "c", "d"]),
        ("<table><tr><th>h<td>v<tr><th>i<td>w</table>", "tr", ["hv", "iw"]),
        ("<table><tr><td>1<td><b>2<td>3</table>", "td:nth-child(2)", ["2"]),
        ("<tr><td>a</td><td>b</td></tr>", "td:first-child", ["a"]),
        ("<div>a</span>b</div>c", "div", ["ab"]),
        ("<div><span>a</div>b", "span", ["a"]),
        ("<span><div>a</span>b</div>", "div", ["ab"]),
        ("<select><option>a<option>b</select>", "option", ["a", "b"]),
        ("<br><img src=x>t<b>u</b>", "b", ["u"]),
        ("<DIV CLASS='A b'>x</DIV>", "div.A.b", ["x"]),
        ("<i class='a  a'>x</i>", ".a", ["x"]),
        ("<i data-x='1'>x</i><i data-x='12'>y</i>", "[data-x='1']", ["x"]),
        ("<i data-x='1'>x</i><i data-x='12'>y</i>", '[data-x*="1"]', ["x", "y"]),
        ("<i id=AdX>x</i>", '[id^="Ad"]', ["x"]),
        ("<a href=/stores/brand/x>x</a>", "a[href*='/stores/brand/']", ["x"]),
        ("<div class=a><p><i class=b>x</i></p></div><i class=b>y</i>", ".a .b", ["x"]),
        ("<i class=a></i><i class=b>y</i>", ".a, .b", ["", "y"]),
        ("<i class='a'> <!-- c --></i><i class=a>y</i>", ".a:not(:empty)", ["y"]),
        ("<i class='a b'>x</i><i class=a>y</i>", ".a:not(.b)", ["y"]),
        ("<div id=Card1><i class=a>x</i></div><i class=a>y</i>", '.a:not(div[id^="Card"] *)', ["y"]),
        ("<script>var a='<i class=a>no</i>'</script><i class=a>y</i>", ".a", ["y"]),
        ("<i class=a>a &amp; b&nbsp;&euro;</i>", ".a", ["a & b\xa0€"]),
        ("<i class=a>1 < 2</i>", ".a", ["1 < 2"]),
        ("<i title='a>b' class=a>y</i>", ".a", ["y"]),
        ("<i title='open class=a>y</i><i class=a>z</i>", ".a", ["y", "z"]),
        ("<i class=a>y</i><i class=a", ".a", ["y", ""]),
        ("<i class=a>x > y", ".a", ["x > y"]),
        ("<i class=a>y<!-- open <i class=a>z</i>", ".a", ["y"]),
        ("<i class=a>y</i><script>open <i class=a>z</i>", ".a", ["y"]),
        ("", "p", []),
    ],
)
def test_select(html, css, texts):
    assert select(html, css) == texts


def test_scope_limits_the_match_but_not_its_ancestors():
    html = "<div class=a><div class=s><i class=b>x</i></div><i class=b>y</i></div>"
    assert select(html, ".a .b", ".s") == ["x"]


def test_texts():
    doc = Document("<p> a <b> b\n</b><!-- c --><script>d</script><style>e</style> f</p>", frozenset(["p"]))
    p = doc.index["p"][0]
    assert doc.text(p, "tight") == "abf"
    assert doc.text(p, "spaced") == "a b f"
    assert doc.text(p, "raw") == " a  b\n f"


def test_next_element_may_be_inside_or_after():
    doc = Document("<p>x<a>in</a></p><a>after</a>", frozenset(["p", "a"]))
    assert doc.text(doc.next_element(doc.index["p"][0], ("a", "span2")[:1]), "tight") == "in"
    assert doc.text(doc.next_element(doc.index["a"][0], ("a",)), "tight") == "after"
    assert doc.next_element(doc.index["a"][1], ("a",)) is None


@pytest.mark.parametrize("css", ["a > b", "a:hover", "", "a + b"])
def test_unsupported_selectors_are_refused(css):
    with pytest.raises(ValueError):
        Selector(css)


@pytest.mark.parametrize("piece", ["<div a='", '<div a="', "<!-- ", "<a ", "<i a='>'", "<i \"<i' ", "<p x=\"'>", "<script ", "<", "</"])
def test_broken_markup_is_read_in_linear_time(piece):
    import time

    def seconds(pieces):
        started = time.perf_counter()
        Document(piece * pieces, frozenset())
        return time.perf_counter() - started

    assert seconds(100_000) < 40 * seconds(10_000) + 1


def nested(seed, size):
    """Any markup: open and closed elements of all kinds the rules look for, at any depth."""
    rng = random.Random(seed)
    parts = ["<div>", "<span class='a-offscreen'>", "<ul>", "<li>", "</div>", "</ul>", "</table>", "<table id='prodDetails'>", "<tr>", "<td>", "word ", "</b>", "<b>",
             "<a href='/dp/B1'>", "sold by ", "<p>", "<i data-hook='review'>", "<div id='buybox'>", "<div class='a-price'>", "<section data-component-type='s-search-result'>"]
    return "".join(rng.choice(parts) for _ in range(size // 9))


SHAPES = {
    "stray end tags": lambda n: "<b>" * (n // 7) + "</i>" * (n // 7),
    "end tags behind a barrier": lambda n: "<b><table>" + "<i>" * (n // 7) + "</b>" * (n // 8),
    "nested spans with text": lambda n: "<span>x" * (n // 7),
    "nested spans with blanks": lambda n: "<span> " * (n // 7),
    "nested blocks with prices": lambda n: "<div><b class='a-offscreen'></b>" * (n // 31),
    "nested cards": lambda n: "<p data-component-type='s-search-result'><i class='a-price'>" * (n // 60),
    "nested rows": lambda n: "<table id='prodDetails'><tr><td>" * (n // 32),
    "nested prices without a price": lambda n: "<i class='a-text-price'>x" * (n // 27),
    "nested prices in a sentence": lambda n: "<i class='a-text-price'>was $5 x" * (n // 34),
    "nested badges": lambda n: "<i class='a-badge-span'>x" * (n // 26) + "sale",
    "labels before nested elements": lambda n: "Sold by: <b>x</b> <span>y" * (n // 25),
    "nested labels": lambda n: "<span>sold by x <div>ships from: y" * (n // 34),
    "random": lambda n: nested(3, n),
}
RULE_SETS = [[*rules.PRODUCT_RULES, *rules.DEAL_RULES], rules.SELLER_RULES, [*rules.GATE_RULES, *rules.CONTENT_RULES], rules.SEARCH_RULES, rules.REVIEW_RULES]


def seconds(page):
    started = time.process_time()
    for group in RULE_SETS:
        fields = [_Field(name, rows, group) for name, rows in _fields(group).items()]
        doc = Document(page, frozenset().union(*(f.keys() for f in fields)))
        for field in fields:
            field.run(doc, 0)
    return time.process_time() - started


@pytest.mark.parametrize("shape", list(SHAPES))
def test_reading_and_rules_are_linear(shape):
    """A page ten times as long costs about ten times as much, for all rule sets."""
    small = min(seconds(SHAPES[shape](100_000)) for _ in range(2))
    assert seconds(SHAPES[shape](1_000_000)) < 30 * small + 1


def characters(found):
    """Length of all texts in what the rules report."""
    if isinstance(found, dict):
        return sum(map(characters, found.values()))
    if isinstance(found, list):
        return sum(map(characters, found))
    return len(found) if isinstance(found, str) else 0


@pytest.mark.parametrize("shape", list(SHAPES))
def test_a_page_reports_no_more_than_it_holds(shape):
    """But for lists, whose elements each are a result (bullets, rows, cards, reviews)."""
    page = SHAPES[shape](200_000)
    for group in RULE_SETS[:2]:
        fields = [_Field(name, rows, group) for name, rows in _fields(group).items() if not name.endswith(("bullet", "_row"))]
        doc = Document(page, frozenset().union(*(f.keys() for f in fields)))
        for field in fields:
            assert characters(field.run(doc, 0)) <= 10 * len(page), field.name


SETTLING = ["<i class='a-text-price'>", "</i>", "<b class='a-badge-span'>", "</b>", "<span>", "</span>", "<div>", "</div>", "<a href='/x'>", "</a>",
            "was ", "list\nprice ", "LIST PRICE ", "$", "5", "5 \u20ac", "\u20b9\xa07", "x", "sale ", "\u017fale ", "Save ", "sold by ", "Sold By: ", "sold by\n", ":", "\xa0", "ships from: ", "Ships from:\n",
            "<script>", "</script>", "<template class='a-text-price'>", "</template>", "<div id='buybox'>", " \n ", "Acme ", "ab", "sold by amazon"]


def test_rules_that_settle_early_give_the_same_records(spark):
    """Records with and without ``until`` and with every hit reported, on pages of all kinds of pieces."""
    from dataclasses import replace

    from shelfmark.operators.deals import deal_fields
    from shelfmark.operators.products import DEFAULT, product_hits
    from shelfmark.operators.sellers import seller_fields

    rng = random.Random(7)
    rows = [(f"https://shop.example/dp/{n}", "".join(rng.choices(SETTLING, k=rng.choice((6, 20, 60))))) for n in range(1_500)]
    pages = spark.createDataFrame(rows, "url string, html string").repartition(8)
    every = [replace(rule, until=None, pattern=None if rule.field in ("was_price", "badge") else rule.pattern) for rule in DEFAULT]
    short, whole = (product_hits(pages, rules=rules).select("url", *deal_fields(), *seller_fields()).collect() for rules in (DEFAULT, every))
    assert sorted(map(str, short)) == sorted(map(str, whole))
    for name in ("original_price", "deal_type", "seller_name", "fulfilled_by_amazon", "ships_from", "box_seller"):
        assert len({row[name] for row in whole}) > 1, name


def climbing(doc, element, compounds):
    """Descendant matching, element by element."""
    at, left = doc.parent[element], list(compounds)
    while at > 0 and left:
        if all(test(doc, at) for test in left[0]):
            left.pop(0)
        at = doc.parent[at]
    return not left


@pytest.mark.parametrize("seed", range(12))
def test_selectors_find_what_a_climb_finds(seed):
    for group in RULE_SETS:
        selectors = [Selector(rule.selector) for rule in group if rule.mode != "nodes"]
        doc = Document(nested(seed, 4_000), frozenset().union(*(s.keys() for s in selectors)))
        scopes = [0, *random.Random(seed).sample(range(1, len(doc.tag)), 5)]
        for selector in selectors:
            for scope in scopes:
                high = doc.end[scope] if scope else len(doc.tag)
                want = sorted({e for key, tests, above in selector.chains for e in doc.index[key]
                               if scope < e < high and all(t(doc, e) for t in tests) and climbing(doc, e, above)})
                assert selector.all(doc, scope) == want
                assert selector.first(doc, scope) == (want[0] if want else None)


def test_heads_begin_like_texts():
    doc = Document(nested(5, 3_000), frozenset(["*"]))
    for element in doc.index["*"]:
        for form in ("tight", "spaced"):
            text, head = doc.text(element, form), doc.head(element, form, 20)
            assert text.startswith(head) and (head == text or len(head) >= 20)


def test_pages_of_one_layout_are_laid_out_once_and_say_their_own():
    """A reader that met other pages before gives what one that meets only this page gives."""
    from shelfmark.operators.hits import _Reader

    rng = random.Random(4)
    shapes = ["".join(rng.choices(SETTLING, k=rng.choice((4, 12, 40)))) for _ in range(300)]
    card = "<div data-component-type='s-search-result'><h2><a class='a-link-normal' href='/dp/{0}' title='{1}'>x</a></h2><i id='merchant-vars'>{1}</i></div>"
    shapes += [card.format(n, text) for n in range(20) for text in ("", " ", "&#32;", "5 &amp; 6", f"t{n}")]
    pages = [page for shape in shapes for page in (shape, shape.replace("5", "7").replace("Acme", "B &amp; C"), shape)]
    for group in RULE_SETS:
        shared = _Reader(group)
        assert [shared.read(page) for page in pages] == [_Reader(group).read(page) for page in pages]
        assert len(shared.layouts.shapes) <= len(set(pages)) / 1.5
        few = _Reader(group)
        few.layouts.TOKENS = 10  # forgets all the time
        assert [few.read(page) for page in pages] == [shared.read(page) for page in pages]


@pytest.mark.parametrize("seed", range(4))
def test_columns_of_a_batch_are_what_its_pages_give(seed):
    """Pages read by the steps of their layout, or with tags known by their form, say what one reading by itself says."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from shelfmark.operators.hits import _column, _Reader, hits_schema

    rng = random.Random(seed)
    odd = ["<a href='/dp/1' title='5 > 4'>x</a>", "<b <i>", "a < b", "<a'x y'z w>", "<ſpan>", "<span class='stars' class='x'>1</span>", "<!-- <p> -->", "<script>'<p>'</script>", "sold by&#58; me", "<div id='merchant-info' /", ""]
    shapes = ["".join(rng.choices([*SETTLING, *odd], k=rng.choice((3, 12, 40)))) for _ in range(60)]
    pages = [page for shape in shapes for page in (shape, shape.replace("5", "7").replace("Acme", "B &amp; C"), None, shape)]
    for group in RULE_SETS:
        shared, kinds = _Reader(group), [field.type for field in to_arrow_schema(hits_schema(group))]
        for start in range(0, len(pages), 50):
            batch = pages[start : start + 50]
            for row, page in enumerate(batch):
                shared.add(page, row)
            rows = [_Reader(group).read(page) for page in batch]
            assert shared.columns(kinds, len(batch)) == [_column([row[at] for row in rows], kind) for at, kind in enumerate(kinds)]


def test_plain_tags_are_cut_as_the_pattern_cuts_them():
    from shelfmark.operators._markup import _SPLIT, Layouts

    rng = random.Random(3)
    some = ["<", ">", "'", '"', "=", " ", "/", "a", "b", "script", "style", "!--", "-->", "!", "?", "p class=", "ſ", "x"]
    shared = Layouts(frozenset(["p"]))
    for _ in range(4_000):
        page = "".join(rng.choices(some, k=rng.choice((4, 12, 30)))) + rng.choice(("", "<p class='a' id='b'>", "<a href='1' href='2'>"))
        parts = _SPLIT.split(page + ">")
        texts, entries = shared._cut(page)
        assert texts == [*parts[::3][:-1], parts[::3][-1][:-1]], page
        fresh = Layouts(frozenset(["p"]))
        assert [entry[1:] for entry in entries] == [fresh._token(token)[1:] for token in parts[1::3]], page
