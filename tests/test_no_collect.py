"""No registered query pulls rows to the driver while it is built or run.

Row-returning actions of the session's own DataFrame class are patched to
raise; each query is executed with the no-op sink.  Queries that read a few
rows of control data, bounded by what is declared, may do so (``ALLOWED``).
"""

import pytest

from vouch.queries import all_queries
from conftest import SMALL_SF

ROW_ACTIONS = ["collect", "toPandas", "take", "head", "first", "tail", "toLocalIterator"]
ALLOWED = {
    "install_dataset", "repair_dataset", "repair_changes",  # a count and a digest for each bucket of a copy
    "validate_contents",  # the first paths that differ, and the files of the damage it makes
    "expect_custom_errors",  # one row for each declared check
    "stream_recovery",  # one commit for each batch
}


@pytest.mark.parametrize("name", sorted(set(all_queries()) - ALLOWED))
def test_query_collects_nothing(spark, name, monkeypatch):
    def forbid(action):
        def raiser(self, *a, **k):
            raise AssertionError(f"{name} called DataFrame.{action}")
        return raiser

    fn = all_queries()[name]
    for action in ROW_ACTIONS:
        monkeypatch.setattr(type(spark.range(1)), action, forbid(action))
    df = fn(spark, SMALL_SF)
    df.write.format("noop").mode("overwrite").save()
