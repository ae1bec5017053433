from __future__ import annotations

import pytest

from sondera.session import cut_lineage, stage


def test_staged_table_is_read_back(spark):
    df = spark.range(10).selectExpr("id % 3 AS k", "id AS n").groupBy("k").sum("n")
    folder = spark.conf.get("spark.checkpoint.dir", None)
    staged = stage(df)
    assert sorted(staged.collect()) == sorted(df.collect())
    if folder:
        assert all("sondera-stage" in f for f in staged.inputFiles())
    else:
        assert staged is df
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            cut_lineage(df)
