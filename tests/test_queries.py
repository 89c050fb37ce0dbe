"""Every query with an SQL twin gives the twin's rows."""

import pytest

from seqweave.plans import catalog
from seqweave.plans.catalog import ORACLES, QUERIES, item_mates
from tests.oracles import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    assert difference(QUERIES[name](spark, SF), ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_pairs_hold_whole_items(spark):
    items = {r.item_id: len(r.text or "") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    mates = {(r.pair_id, r.mate): len(r.seq) for r in item_mates(spark, SF).collect()}
    assert {i: mates[i, 0] + mates[i, 1] for i in items} == items and len(mates) == 2 * len(items)
    assert QUERIES["align_pe"](spark, SF).count() == 2 * len(items)


def test_filters_drop_and_keep(spark):
    """At sf0.01 each filter has rows to drop and rows to keep."""
    sf = "/root/testdata/sf0.01"
    count = lambda name: catalog.QUERIES[name](spark, sf).count()
    matches = {k: catalog.dna_matches(spark, sf, k) for k in (catalog.CAP_K, catalog.SHARE_K)}
    assert 0 < count("seed_cap") < catalog.matching.occurrences(matches[catalog.CAP_K]).count()
    assert 0 < count("freq_filter") < catalog.matching.intervals(matches[catalog.SHARE_K]).count()
    assert 0 < count("direction_filter") < catalog.matching.intervals(catalog.both_strands(spark, sf, catalog.SIDE_K)[1]).count()
