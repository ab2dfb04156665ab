from __future__ import annotations

import pytest

from signals.sources.scratch import drop_scratch, scratch_root, scratch_run, write_once


def test_a_run_drops_its_own_tables_only(spark):
    with scratch_run() as one:
        first = write_once(spark.range(3))
        with scratch_run() as two:
            second = write_once(spark.range(5))
    assert drop_scratch(spark, one) == 1 and second.count() == 5
    with pytest.raises(Exception, match="(?i)does not exist|not found|no such file"):
        first.collect()
    assert drop_scratch(spark, two) == 1


def test_scratch_is_under_the_shared_folder(spark):
    assert scratch_root(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
