"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from pricewren.plans import accounts, catalog, events, matches, offers, prices, relations, shops, states, streams, texts

PLANS = (prices, catalog, relations, events, offers, texts, matches, shops, states, streams, accounts)
QUERIES: dict = {k: v for p in PLANS for k, v in p.QUERIES.items()}
ORACLES: dict = {k: v for p in PLANS for k, v in p.ORACLES.items()}
