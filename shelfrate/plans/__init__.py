"""Query catalogue and join strategies."""


def load_catalog():
    """Import every query module so its entries register; return (queries, oracle)."""
    from shelfrate.plans import catalog
    from shelfrate.plans import pricing_queries  # noqa: F401
    from shelfrate.plans import materialize_queries  # noqa: F401
    from shelfrate.plans import feed_queries  # noqa: F401
    from shelfrate.plans import ingest_queries  # noqa: F401
    from shelfrate.plans import listing_queries  # noqa: F401
    from shelfrate.plans import source_queries  # noqa: F401
    from shelfrate.plans import quality_queries  # noqa: F401
    from shelfrate.plans import rollup_queries  # noqa: F401
    from shelfrate.plans import api_queries  # noqa: F401
    return catalog.QUERIES, catalog.ORACLE
