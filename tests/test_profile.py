"""Log profiles on the hand-made rows."""

from stagepath.operators import profile
from tests.conftest import make_events


def test_quality_labels_and_counts(spark):
    ev = make_events(
        spark,
        [("A", 1, "view", 1, None, "c", None), ("A", 1, "view", 2, 0.0, None, "b"),
         (None, 2, "cart", 3, -1.0, None, None), (None, 2, "view", 4, 2.0, "c", "b")],
    )
    assert {r["item"]: r["count"] for r in profile.quality_long(ev).collect()} == {
        "category_code 결측": 2, "brand 결측": 2, "price 결측": 1, "price = 0": 1, "price < 0": 1,
    }
    wide = profile.null_price_profile(ev).first()
    assert (wide.total_rows, wide.null_category_pct, wide.null_brand_pct) == (4, 50.0, 50.0)
    quality = profile.column_quality(ev).first()
    assert (quality.products, quality.null_session, quality.non_positive_price) == (2, 2, 2)
    assert (quality.min_price, quality.max_price, quality.avg_price) == (-1.0, 2.0, 0.33)
    assert [tuple(r) for r in profile.null_session_by_type(ev).collect()] == [("cart", 1), ("view", 1)]


def test_session_breadth(edge_events):
    # A: 6 products, B: 1, C: 2 known products, D, E and F: 1 each.
    row = profile.session_breadth(edge_events).first()
    assert (row.total_sessions, row.max_products_per_session) == (6, 6)
    assert (row.single_product_sessions, row.multi_product_sessions) == (4, 2)
    assert (row.avg_products_per_session, row.median_products_per_session) == (2.0, 1.0)
    assert row.multi_product_pct == 33.33
    short = profile.session_breadth_summary(edge_events).first()
    assert (short.avg_products, short.median_products, short.max_products) == (2.0, 1.0, 6)


def test_price_changes(edge_events):
    row = profile.price_change_products(edge_events).first()
    # Products 2, 11 and the two views of product 1 at different prices.
    assert (row.total_products, row.changed_price_products) == (12, 3)
