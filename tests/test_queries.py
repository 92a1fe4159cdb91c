import pytest
from against_sql import SMALL, database, rows_of, rows_of_sql

from lodestone import queries

CON = database(SMALL)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    assert rows_of(df) == rows_of_sql(CON, queries.ORACLE_SQL[name])


#: Queries without SQL, each held against plain code in test_parts, test_golden or test_whole.
WITHOUT_SQL = {"transliterated", "noisy_texts", "tei_passages", "positive_pairs", "word_lcs", "rf_rank", "gbt_rank", "ltr_pairwise_rank", "engine_retrieve", "engine_answers", "pipeline_measures", "text_processed", "first_test_set", "large_test_set", "basic_features_all", "advanced_features_all"}


def test_all_are_checked():
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == WITHOUT_SQL


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
