"""Stored blocks and streams against batch results."""

import random

import pytest
from pyspark.sql import functions as F

from alnspark.operators import encode
from alnspark.sources import store
from alnspark.streaming import runs
from alnspark.streaming.dictionary import GrowingDictionary


def _aln(spark, n=3000):
    rng = random.Random(7)
    data = [(i, rng.randint(0, 2), rng.choice([5, 5, rng.randint(0, 4000)]), f"s{i}") for i in range(n)]
    return spark.createDataFrame(data, "aln_idx long, ref_id int, pos int, seq string")


def test_a_view_reads_the_files_of_its_region(spark, tmp_path):
    rows, path = _aln(spark), str(tmp_path / "store")
    store.write(rows, path, 100)
    whole = store.spans(spark, path)
    assert whole.agg(F.sum("n")).first()[0] == 3000 and whole.count() >= 30
    files = []
    for start, stop in ((100, 110), (100, 1000), (0, 4001), (5, 6), (9000, 9001)):
        got = store.view(spark, path, 1, start, stop)
        want = rows.where((F.col("ref_id") == 1) & (F.col("pos") >= start) & (F.col("pos") < stop))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        files.append(len(got.inputFiles()))
    assert files[0] <= files[1] <= 4 < files[2] < whole.count() / 2 and files[4] <= 1
    ordered = [r["aln_idx"] for r in rows.orderBy("ref_id", "pos", "aln_idx").collect()]
    for n in (0, 1234, 2999):
        block = store.block_of(spark, path, n)
        assert ordered[n] in {r["aln_idx"] for r in block.collect()} and block.count() <= 100
    assert store.block_of(spark, path, 3000).isEmpty()


def _feed(spark, path, part):
    part.write.mode("append").parquet(f"{path}/in")
    stream = runs.offset_runs(spark.readStream.schema("ref_id int, pos int").parquet(f"{path}/in"))
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out").awaitTermination()


def test_stream_of_runs_goes_on_from_its_checkpoint(spark, tmp_path):
    runs.enable(spark)
    rows, path = _aln(spark).select("ref_id", "pos"), str(tmp_path)
    cuts = [0, 5, 6, 2000, 4001]  # a run is cut between two batches
    for lo, hi in zip(cuts, cuts[1:]):
        part = rows.where((F.col("pos") >= lo) & (F.col("pos") < hi))
        halves = [part.where("ref_id = 0"), part.where("ref_id > 0")] if hi == 6 else [part]
        for half in halves:
            _feed(spark, path, half)
    _feed(spark, path, rows.where("pos = 4000"))  # still open: it goes on
    _feed(spark, path, spark.createDataFrame([(r, None) for r in range(4)], "ref_id int, pos int"))
    got = spark.read.schema(runs.OUT).parquet(f"{path}/out")
    want = encode.offset_runs(rows.union(rows.where("pos = 4000")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("ref_id", "pos", "delta", "mult").collect()))


def test_positions_out_of_order_are_refused(spark, tmp_path):
    runs.enable(spark)
    _feed(spark, str(tmp_path), spark.createDataFrame([(0, 9)], "ref_id int, pos int"))
    with pytest.raises(Exception, match="came after"):
        _feed(spark, str(tmp_path), spark.createDataFrame([(0, 8)], "ref_id int, pos int"))


def test_a_dictionary_grows_and_its_codes_stay(spark, tmp_path):
    rows = spark.createDataFrame([(i, (i * i) % 37 if i % 5 else None) for i in range(60)], "aln_idx long, flag int")
    words = GrowingDictionary(spark, str(tmp_path / "words"), "flag")
    assert words.words() is None and words.versions() == []
    seen = {}
    for number in range(3):
        part = rows.where((F.col("aln_idx") >= 20 * number) & (F.col("aln_idx") < 20 * number + 20))
        for _ in range(2):  # a batch that comes again adds nothing
            words.extend(part, number)
        now = {r["value"]: r["code"] for r in words.words().collect()}
        assert all(now[k] == c for k, c in seen.items()) and words.words().count() == len(now)
        seen = now
    assert seen == {r["value"]: r["code"] for r in encode.first_seen(rows, "flag").collect()}
    # a version that was cut off is written anew
    (tmp_path / "words" / "batch-2" / "_SUCCESS").unlink()
    assert words.versions() == [0, 1]
    words.extend(rows.where("aln_idx >= 40"), 2)
    assert {r["value"]: r["code"] for r in words.words().collect()} == seen
    assert words.encode(spark.createDataFrame([(1, 4), (2, 999)], "aln_idx long, flag int")).where("code IS NULL").count() == 1
