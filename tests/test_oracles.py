"""Every registered query against its SQL."""

import pytest

from tidemill.plans.oracle import ORACLE_SQL, SMALL_SQL
from tidemill.plans.queries import QUERIES, RULES
from tidemill.sources.inline import Inline

from .conftest import SMALL


#: On the smallest tables; but for lexical_and_topk each has rows on sf0.01.
NO_ROWS_AT_THIS_SIZE = ("lexical_and_topk", "phrase_probe", "superseded", "numeric_conflicts")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(name, same):
    assert len(same(QUERIES[name], ORACLE_SQL[name])) > 0 or name in NO_ROWS_AT_THIS_SIZE


@pytest.mark.parametrize("name", sorted(SMALL_SQL))
def test_rule_equals_its_sql(name, same):
    assert len(same(lambda spark, _: RULES[name](Inline(spark)), SMALL_SQL[name])) > 0


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert QUERIES["corpus_counts"](spark, SMALL).count() == 3
