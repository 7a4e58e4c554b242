"""Training-data operators: filtering, de-duplication, extraction, PII and mixing.

Nothing else in the library imports this package. ``load_catalog`` returns
the registered queries (one per operator, plus ``pipeline``) and their SQL.
"""


def load_catalog():
    """(queries, oracle SQL) of this package and of ``corpus_pipeline``."""
    from shelfrate.llm import queries

    return queries.QUERIES, queries.ORACLE
