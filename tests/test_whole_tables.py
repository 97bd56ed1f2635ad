"""Queries that once ran over a subset of their tables."""

import pandas as pd

from probanda.plans import robust

from .conftest import SMALL


def test_preferences_of_all_parts(spark, monkeypatch):
    monkeypatch.setattr(robust.stats, "bradley_terry", lambda pairs: pairs)
    lines = pd.read_parquet(f"{SMALL}/lineitem.parquet", columns=["l_partkey", "l_suppkey"])
    met = lines.assign(c=lines["l_suppkey"] % 20).groupby("l_partkey")["c"].nunique()
    assert robust.preference_strengths(spark, SMALL).count() == (met * (met - 1) // 2).sum() > 0
