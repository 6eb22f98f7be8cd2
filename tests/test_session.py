import os

import pytest

from tidemark import session
from tidemark.session import cut_lineage, settled


def _tables(spark):
    folder = session.ensure_checkpoint_dir(spark).removeprefix("file:")
    return {f for f in os.listdir(folder) if f.startswith("table-")}


def test_tables_on_the_way_go_and_the_result_stays(spark):
    before = _tables(spark)

    def build():
        inner = settled(lambda: cut_lineage(spark.range(10)).selectExpr("id * 2 AS id"))
        first = cut_lineage(inner)
        assert len(_tables(spark) - before) == 2  # the inner result and its copy
        return first.where("id > 4")

    kept = settled(build)
    assert len(_tables(spark) - before) == 1
    assert sorted(r["id"] for r in kept.collect()) == [6, 8, 10, 12, 14, 16, 18]


def test_tables_go_when_a_build_fails(spark):
    before = _tables(spark)

    def build():
        cut_lineage(spark.range(3))
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        settled(build)
    assert _tables(spark) == before
    cut_lineage(spark.range(3))
    assert len(_tables(spark) - before) == 1
