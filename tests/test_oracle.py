"""Every query with oracle SQL equals DuckDB on the sf0.001 tables (row
count, column names, values)."""

import pytest

from tandem.plans.oracle import SQL
from tandem.plans.queries import all_queries
from tests.oracle_harness import compare, duck


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, sf_small, name):
    result = compare(spark, con, name, all_queries()[name], SQL[name], sf_small)
    assert result["columns_match"], result
    assert result["values_match"], result
    assert result["spark_rows"] == result["duck_rows"]


def test_expected_counts(spark, sf_small):
    """Counts published with the table binding (FIXTURES.md section 2)."""
    q = all_queries()
    assert q["domain_check"](spark, sf_small).count() == 400
    assert q["roster_check"](spark, sf_small).count() == 138
    assert q["range_check_x"](spark, sf_small).count() == 82
    assert q["range_check_y"](spark, sf_small).count() == 171
    assert q["manifest_missing"](spark, sf_small).filter("kind = 'events'").count() == 27
    assert q["season_pair_totals"](spark, sf_small).count() == 22
    best = q["top_pairs"](spark, sf_small).first()
    assert (best.pair, best.season_modified, best.season_plain) == ("(user_11, user_9)", 4.439453125, -0.5)
    halves = q["segment_by_marker"](spark, sf_small)
    assert halves.filter("half = 1").count() == 608
    ones = [q[name](spark, sf_small).filter(f"{name} = 1").count()
            for name in ("label_goal", "label_concede", "label_keep", "label_lose")]
    assert ones == [91, 69, 612, 298]
