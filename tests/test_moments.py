"""The insert-size model of a stream against that of the same rows at once."""

import random
import statistics

import pytest

from seqweave.operators import chaining
from seqweave.streaming import moments

SCHEMA = "pair_id long, size double"


def test_model_stops_and_held_rows_follow(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, None if i % 9 == 0 else rng.gauss(300, 40)) for i in range(900)]
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    put = lambda lo, hi: spark.createDataFrame(rows[lo:hi], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run = lambda: moments.modelled(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), out, check, most=400).awaitTermination()
    put(0, 200)
    run()
    assert not (tmp_path / "out" / "out").exists()  # held
    put(200, 400)
    run()
    put(400, 700)
    run()  # from the checkpoint; goes beyond the 400
    put(700, 900)
    run()
    got = spark.read.parquet(f"{out}/out").collect()
    first = [x for _, x in rows if x is not None][:400]
    assert sorted(r.pair_id for r in got) == list(range(900))
    assert {(round(r.model_mean, 6), round(r.model_sd, 6)) for r in got} == {(round(statistics.fmean(first), 6), round(statistics.stdev(first), 6))}
    before = sorted(map(tuple, (r[:2] for r in got)), key=lambda r: r[0])
    moments.step(spark.createDataFrame(rows[400:700], SCHEMA), 2, out, "size", "pair_id", 400)  # a batch that is run again
    assert sorted(map(tuple, (r[:2] for r in spark.read.parquet(f"{out}/out").collect())), key=lambda r: r[0]) == before


def test_short_streams_finish(spark, tmp_path):
    out = str(tmp_path)
    moments.step(spark.createDataFrame([(1, 2.0), (2, 4.0)], SCHEMA), 0, out, "size", "pair_id", 400)
    moments.step(spark.createDataFrame([], SCHEMA), 1, out, "size", "pair_id", 400)
    moments.finish(spark, out, spark.createDataFrame([], SCHEMA).schema, 1, 400)
    assert [(r.model_mean, r.model_sd) for r in spark.read.parquet(f"{out}/out").collect()] == [(3.0, pytest.approx(2**0.5))] * 2
    assert moments.merged((0, 0.0, 0.0), (0, 0.0, 0.0)) == (0, 0.0, 0.0)


def test_skipped_chains_are_counted(spark):
    chain = lambda read, k, score, x0: (read, 5, k, score, 1, x0, x0, 0, 0, 0, 1000, False, [(x0, 0, 10)])
    rows = [chain(1, 0, 50, 100), chain(1, 1, 50, 105), chain(1, 2, 50, 112), chain(1, 3, 50, 130), chain(1, 4, 60, 101), chain(2, 0, 50, 103)]
    found = spark.createDataFrame(rows, chaining.CHAINS)
    assert {tuple(r) for r in chaining.skipped(found, 10).collect()} == {(1, 2), (2, 0)}
    assert {(r.read_id, r.chain) for r in chaining.apart(found, 10).select("read_id", "chain").collect()} == {(1, 0), (1, 3), (1, 4), (2, 0)}
