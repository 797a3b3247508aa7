"""Which words similarities of filings count, by query and by SQL."""

import duckdb
import pytest

from panelspark.plans import catalog

#: Two years of one firm; only does, the, having and harvest are in both filings of a section.
TEXTS = ["does alpha", "the beta", "having harvest", "gamma does", "delta the", "harvest having harvest"]
#: Cosine of (1, 1) and (1, 2): having and harvest.
ITEM7 = round(3 / 10**0.5, 6)


@pytest.fixture(scope="module")
def filed(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("filed"))
    rows = [(i, t, "en", "s1", 500) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


def both(spark, d, name):
    """Rows of the query and of its SQL, sorted, each by the query's columns."""
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, d)
    rel = con.sql(catalog.SQL[name])
    at = [rel.columns.index(c) for c in df.columns]
    return sorted(map(tuple, df.collect())), sorted(tuple(r[i] for i in at) for r in rel.fetchall())


def test_yearly_cosine_counts_words_that_the_reference_counts(spark, filed):
    want = [(1, "Item 1", 2001, 1.0), (1, "Item 1A", 2001, 0.0), (1, "Item 7", 2001, ITEM7)]
    assert both(spark, filed, "text_yoy_cosine") == (want, want)


def test_text_change_averages_similarities_with_those_words(spark, filed):
    want = [(1, 2001, 1.0, 0.0, ITEM7, round(1 - (1 + 3 / 10**0.5) / 3, 6))]
    assert both(spark, filed, "sig_text_change") == (want, want)


def test_similarity_profile_describes_similarities_with_those_words(spark, filed):
    want = [(n, 1, *[x] * 5) for n, x in (("Item 1", 1.0), ("Item 1A", 0.0), ("Item 7", ITEM7))]
    assert both(spark, filed, "text_similarity_profile") == (want, want)
