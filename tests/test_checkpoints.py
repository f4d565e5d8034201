import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import checkpoints as K
from ledgerloom.operators import replay as R
from ledgerloom.operators import verify as V

from .test_audit import clean, frame


def same(a, b):
    return sorted(map(repr, a.select(sorted(a.columns)).collect())) == sorted(map(repr, b.select(sorted(b.columns)).collect()))


def full(ledger, name):
    specs = R.projections()
    return V.REBUILT[name][0](ledger) if name in V.REBUILT else R.project(ledger, specs[name])


@pytest.fixture(scope="module")
def ledger(spark):
    rows = frame(spark, clean()).withColumn("event_hash", F.concat(F.lit("h"), F.col("event_sequence").cast("string")))
    return spark.createDataFrame(rows.collect(), rows.schema)


@pytest.fixture(scope="module")
def names(spark):
    return [*R.projections(), "ownership", "artefact_files", "acquisition_files", "export_items", "confidential_authority", "counters"]


def test_every_table_is_that_of_a_full_replay(spark, ledger, names, tmp_path):
    n = ledger.count()
    rng = random.Random(1)
    cuts = sorted(rng.sample(range(1, n), 2))
    first, second, third = ledger.filter(F.col("event_sequence") <= cuts[0]), ledger.filter(F.col("event_sequence").between(cuts[0] + 1, cuts[1])), ledger.filter(F.col("event_sequence") > cuts[1])
    K.take(first, f"{tmp_path}/1")
    K.advance(spark, f"{tmp_path}/1", second, f"{tmp_path}/2")
    K.advance(spark, f"{tmp_path}/2", third, f"{tmp_path}/3")
    upto = ledger.filter(F.col("event_sequence") <= cuts[1])
    for at, history in ((2, upto), (3, ledger)):
        got = K.tables(spark, f"{tmp_path}/{at}")
        assert set(got) == set(names)
        for name in names:
            assert same(got[name], full(history, name)), (name, cuts)
    live = {n: full(ledger, n) for n in ("files", "notes", "ownership")}
    assert V.verify_state(ledger.limit(0), live, K.tables(spark, f"{tmp_path}/3", list(live))).count() == 0
    assert V.verify_state(ledger.limit(0), live, K.tables(spark, f"{tmp_path}/3", list(live)), by_tree=True).count() == 0


def test_a_delta_that_does_not_go_on_is_refused(spark, ledger, tmp_path):
    K.take(ledger.filter("event_sequence <= 10"), f"{tmp_path}/1", ["files"])
    later = ledger.filter("event_sequence > 10")
    for name, bad in {"gap": later.filter("event_sequence <> 12"), "twice": later.unionByName(later.limit(1)), "late": later.filter("event_sequence > 11"), "fork": later.withColumn("previous_hash", F.lit("x"))}.items():
        with pytest.raises(ValueError):
            K.advance(spark, f"{tmp_path}/1", bad, f"{tmp_path}/{name}", ["files"])
    K.advance(spark, f"{tmp_path}/1", later.limit(0), f"{tmp_path}/none", ["files"])
    assert K.tables(spark, f"{tmp_path}/none", ["files"])["files"].count() == 2
    other = later.withColumns({"project_id": F.lit("Q"), "event_sequence": F.col("event_sequence") - 10})
    K.advance(spark, f"{tmp_path}/1", other, f"{tmp_path}/new", ["files"])
    assert {r["project_id"]: r["event_count"] for r in K.read(spark, f"{tmp_path}/new", "heads").collect()} == {"P": 10, "Q": other.count()}
