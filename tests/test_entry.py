from __future__ import annotations

import __spark_entry__
from echolex import catalog, catalog_terms, catalog_transcripts


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.oracle_sql()) == set(catalog.queries())
    for own in (catalog, catalog_transcripts, catalog_terms):
        assert set(own.oracle_sql()) <= set(own.queries())


def test_catalogues_do_not_share_names():
    names = [n for own in (catalog, catalog_transcripts, catalog_terms) for n in own.queries()] + list(catalog.queries_without_sql())
    assert len(names) == len(set(names))
