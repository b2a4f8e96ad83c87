"""Products rolled up from their listings, on worked cases."""

from __future__ import annotations

import datetime

from pricewren.operators import market

PRODUCTS = "product_id long, current_price double, previous_price double, lowest_price double, highest_price double, scrape_status string, failure_count int, last_error string, last_checked_at timestamp_ntz"
LISTINGS = "product_id long, competitor_id long, price double, is_active boolean, scrape_status string, last_checked_at timestamp_ntz"
EARLY, LATE = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 2, 1)


def test_rolled_up(spark):
    before = [(n, 5.0, 4.0, 3.0, 9.0, "pending", 2, "timeout", None) for n in (1, 2, 3, 4)] + [(5, None, None, None, None, None, None, None, EARLY), (6, 2.0, 1.0, 3.0, 3.0, "failed", 1, "x", EARLY)]
    listings = [
        (1, 8, 2.0, True, "success", EARLY), (1, 7, 2.0, True, "failed", LATE), (1, 6, 1.0, False, "success", None),
        (2, 1, 5.0, True, "failed", LATE), (2, 2, None, True, None, None), (3, 1, 12.0, True, None, None), (3, 2, 20.0, None, "success", None), (4, 1, 1.0, False, "success", LATE),
        (5, 1, None, True, "failed", None), (9, 1, 1.0, True, "success", LATE), (None, 1, 1.0, True, "success", LATE),
    ]
    found = market.rolled_up(spark.createDataFrame(before, PRODUCTS), spark.createDataFrame(listings, LISTINGS))
    names = ["product_id", "competitor_count", "current_price", "previous_price", "lowest_price", "highest_price", "cheapest_competitor_id", "scrape_status", "failure_count", "last_error", "last_checked_at"]
    assert sorted(tuple(r) for r in found.select(*names).collect()) == [
        (1, 2, 2.0, 5.0, 2.0, 9.0, 7, "success", 0, None, LATE),
        (2, 2, 5.0, 4.0, 3.0, 9.0, 1, "failed", 2, "timeout", LATE),
        (3, 1, 12.0, 5.0, 3.0, 12.0, 1, "pending", 2, "timeout", None),
        (4, 0, None, 4.0, 3.0, 9.0, None, "skipped", 2, "timeout", LATE),
        (5, 1, None, None, None, None, None, "failed", None, None, EARLY),
        (6, 0, None, 1.0, 3.0, 3.0, None, "skipped", 1, "x", EARLY),
    ]
    assert market.rolled_up(spark.createDataFrame([], PRODUCTS), spark.createDataFrame([], LISTINGS)).count() == 0
