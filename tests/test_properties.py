"""Generated values against small independent Python statements of the rules."""

import re
from urllib.parse import parse_qsl, urlsplit

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shelfmark.functions import prices, urls

FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def plain_amount(text):
    """Reads a price by trying each notation on the digits that are left."""
    left = "".join(ch for ch in text if ch in "0123456789.,")
    groups = {
        ",": [(r"\d+(\.\d{3})*(,\d\d?)?", ".", ","), (r"\d{1,3}(,\d{3})+(\.\d\d?)?", ",", ".")],
        "": [(r"\d+(\.\d\d?)?", ",", "."), (r"\d{1,3}(\.\d{3})+", ".", ",")],
    }
    for pattern, thousands, decimal in groups["," if "," in left else ""]:
        if re.fullmatch(pattern, left):
            return float(left.replace(thousands, "").replace(decimal, "."))
    return None


@FEW
@given(st.lists(st.text(alphabet="0123456789.,$€ x", max_size=14), min_size=150, max_size=300))
def test_amount(column, texts):
    got = column(prices.amount, texts)
    want = [plain_amount(text) for text in texts]
    assert [None if v is None else float(v) for v in got] == want


@FEW
@given(st.lists(st.tuples(st.sampled_from(["a", "tag", "b", "ref_", "th"]), st.text(alphabet="xy1%", max_size=3)), max_size=6).flatmap(lambda q: st.lists(st.just(q), min_size=1, max_size=1)))
def test_cleaned_query_is_the_rest_in_order(column, queries):
    pairs = queries[0]
    url = "https://www.amazon.com/dp/B000000001?" + "&".join(f"{k}={v}" for k, v in pairs) + "#f"
    got = urlsplit(column(urls.clean_url, [url])[0])
    assert got.query.split("&") == ([f"{k}={v}" for k, v in pairs if k not in urls.TRACKING_PARAMS] or [""])
    assert (got.path, got.fragment) == ("/dp/B000000001", "f")
    assert all(k not in urls.TRACKING_PARAMS for k, _ in parse_qsl(got.query))


@FEW
@given(st.lists(st.integers(0, 10**9), min_size=50, max_size=100))
def test_rendered_prices_are_valid_and_read_back(column, cents):
    us = [f"${c // 100:,}.{c % 100:02d}" for c in cents]
    eu = [t[1:].translate(str.maketrans(",.", ".,")) + " €" for t in us]
    for texts in (us, eu):
        assert column(prices.price_is_valid, texts) == [True] * len(texts)
        assert [int(v * 100) for v in column(prices.amount, texts)] == cents
