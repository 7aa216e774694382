"""Files that arrive, are judged, imported, tried again and removed."""
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from feedyard import schemas as S
from feedyard.session import fresh_scratch_path
from feedyard.sources.partitioned import PartitionedCatalog
from feedyard.streaming import landing as LZ
from tests.conftest import write_file


def _run_ts():
    return F.lit("2025-01-01 00:00:00").cast("timestamp")


class Failing(PartitionedCatalog):
    """A catalog whose first `left` upserts raise."""

    left = 0

    def upsert(self, *args):
        if self.left > 0:
            self.left -= 1
            raise RuntimeError("no database")
        return super().upsert(*args)


def _store(spark, left=0):
    t0 = dt.datetime(2024, 1, 1)
    store = Failing(spark, fresh_scratch_path(spark, "store"), partitions=4)
    store.publish(spark.createDataFrame([(1, "A-1", "old", None, True, t0, t0, "a-1")], S.CATALOG), 0)
    store.left = left
    return store


def _log(spark, log):
    return sorted((os.path.basename(r["path"]), r["outcome"], r["tries"], r["message"] is None) for r in LZ.read_log(spark, log).collect())


def _names(store):
    return {r["sku_key"]: r["name"] for r in store.read().collect()}


def test_accepted_rejected_and_removed(spark, tmpdir_path):
    feed = os.path.join(tmpdir_path, "feed")
    os.makedirs(feed)
    write_file(feed, "good.csv", "sku,name\nA-1,new\nB-2,two\n")
    write_file(feed, "bad.csv", "sku,title\nC-3,x\n")
    write_file(feed, "notes.txt", "sku,name\nD-4,x\n")
    write_file(feed, "none.csv", "")
    store, log, ckpt = _store(spark), fresh_scratch_path(spark, "log"), fresh_scratch_path(spark, "ckpt")
    LZ.land(spark, feed, store, _run_ts(), log, checkpoint=ckpt, clean_source="delete")
    want = [("bad.csv", "rejected", 1, False), ("good.csv", "accepted", 1, True), ("none.csv", "rejected", 1, False), ("notes.txt", "rejected", 1, False)]
    assert _log(spark, log) == want
    assert _names(store) == {"a-1": "new", "b-2": "two"}  # nothing of a rejected file
    write_file(feed, "later.csv", "sku,name\nb-2,three\n")
    LZ.land(spark, feed, store, _run_ts(), log, checkpoint=ckpt, clean_source="delete")
    assert _log(spark, log) == sorted([*want, ("later.csv", "accepted", 1, True)])  # each file once
    assert _names(store)["b-2"] == "three"
    assert not os.path.exists(os.path.join(feed, "good.csv")) and not os.path.exists(os.path.join(feed, "bad.csv"))


@pytest.mark.parametrize("fails, outcome", [(1, "accepted"), (2, "failed")])
def test_tries(spark, tmpdir_path, fails, outcome):
    feed = os.path.join(tmpdir_path, "feed")
    os.makedirs(feed)
    write_file(feed, "a.csv", "sku,name\nA-1,new\n")
    write_file(feed, "b.csv", "sku\nA-1\n")
    store, log, ckpt = _store(spark, fails), fresh_scratch_path(spark, "log"), fresh_scratch_path(spark, "ckpt")
    with pytest.raises(Exception, match="no database"):
        LZ.land(spark, feed, store, _run_ts(), log, tries=2, checkpoint=ckpt, clean_source="delete")
    assert _log(spark, log) == [("a.csv", "retried", 1, False), ("b.csv", "retried", 1, False)]
    assert os.path.exists(os.path.join(feed, "a.csv"))  # kept for the next try
    LZ.land(spark, feed, store, _run_ts(), log, tries=2, checkpoint=ckpt, clean_source="delete")
    assert [r[:3] for r in _log(spark, log)] == sorted([("a.csv", "retried", 1), ("b.csv", "retried", 1), ("a.csv", outcome, 2), ("b.csv", "rejected", 2)])
    assert _names(store) == {"a-1": "new" if outcome == "accepted" else "old"}
    assert store.current_version() == 1
