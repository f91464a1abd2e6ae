"""The id index: exact answers, no bucket read in vain, growth, rebuilding."""

from pyspark.sql import functions as F

from idsignal.sources import id_index
from idsignal.sources.id_index import BLOCK_IDS, IdIndex


def ids(spark, *span):
    return spark.range(*span).select("id")


def found(index, wanted):
    return sorted(r.id for r in index.known(wanted).collect())


def test_index_answers_exactly_as_it_grows(spark, tmp_path):
    index = IdIndex(spark, str(tmp_path / "index"))
    assert found(index, ids(spark, 10)) == [] and index.size() == (0, 0)
    for n in range(4):
        index.add(ids(spark, n * 1500, (n + 1) * 1500))
        assert found(index, ids(spark, n * 1500 - 5, n * 1500 + 5)) == [i for i in range(n * 1500 - 5, n * 1500 + 5) if i >= 0]
    blocks, stored = index.size()
    assert stored == 6000 and 6000 <= blocks * BLOCK_IDS and blocks & (blocks - 1) == 0
    assert found(index, ids(spark, -100, 7000)) == list(range(6000))
    index.add(ids(spark, 0))
    assert index.size() == (blocks, stored)


def test_unseen_ids_raise_few_alarms(spark, tmp_path):
    index = IdIndex(spark, str(tmp_path / "index"))
    index.add(ids(spark, 20_000))
    assert index.hits(ids(spark, 10**9, 10**9 + 50_000)).count() <= 25
    assert index.hits(ids(spark, 20_000)).count() == 20_000


def files_read(df):
    return {r[0].split("bucket=")[1].split("/")[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_only_buckets_that_were_hit_are_read(spark, tmp_path):
    index = IdIndex(spark, str(tmp_path / "index"))
    index.add(ids(spark, 20_000))
    hits = index.hits(ids(spark, 3))
    buckets = {str(r.bucket) for r in hits.collect()}
    looked = index.candidates(hits)
    assert files_read(looked) == buckets and 1 <= len(buckets) <= 3
    scan = [line for line in looked._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line]
    assert all("bucket" in line.split("PartitionFilters")[1] for line in scan) and scan
    nothing = index.candidates(index.hits(ids(spark, 10**9, 10**9 + 100)))
    assert files_read(nothing) == set()


def test_rebuilt_index_is_the_same(spark, tmp_path):
    index, again = (IdIndex(spark, str(tmp_path / n)) for n in ("a", "b"))
    for n in range(3):
        index.add(ids(spark, n * 100, n * 100 + 100))
    stored = ids(spark, 300).unionByName(ids(spark, 50)).unionByName(spark.sql("select cast(null as bigint) id"))
    again.rebuild(stored)
    assert again.size()[1] == index.size()[1] == 300
    assert found(again, ids(spark, 1000)) == found(index, ids(spark, 1000)) == list(range(300))


def test_without_broadcast(spark, tmp_path, monkeypatch):
    index = IdIndex(spark, str(tmp_path / "index"))
    index.add(ids(spark, 5000))
    monkeypatch.setattr(id_index, "fits_broadcast", lambda df: False)
    monkeypatch.setattr("idsignal.operators.lookup.fits_broadcast", lambda df: False)
    assert found(index, ids(spark, 4990, 5010)) == list(range(4990, 5000))
