"""op9 keeps no table of a round that has ended, and only rows that may have a class move with their lanes."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from conftest import SF_SMALL
from shelfcast.llm.common import parted
from shelfcast.llm.minhash import op9_minhash
from shelfcast.session import checkpoint_dir


def test_rounds_leave_no_tables(spark):
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    op9_minhash(spark, SF_SMALL)
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before}
    assert not left & {"jaccard-compared", "jaccard-checked", "jaccard-pairs", "jaccard-stars", "minhash-sets", "minhash-lists"}


def test_parts_are_whole(spark):
    rows, keys = spark.range(1000).withColumnRenamed("id", "th"), spark.range(5).withColumnRenamed("id", "th")
    some, others = parted(rows, keys)
    assert sorted(r.th for r in some.union(others).collect()) == list(range(1000)) and some.count() == 5
