"""The driver's contract."""

import __spark_entry__


def test_entry_gives_the_specific_tokens(spark):
    assert "w3_specific_tokens" in __spark_entry__.entry.__doc__
    d = __spark_entry__.entry(spark)
    assert d.columns == ["cond", "side", "rank", "token_norm", "s_score", "count", "count_all"] and d.limit(1).count() == 1


def test_every_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
