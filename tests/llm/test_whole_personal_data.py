"""Personal data outside the base patterns."""

import numpy as np
import pytest

from idsignal.llm import boosting, pii

WIDER = {
    1: "please call (555) 010-9999 today", 2: "ring 555.010.9999 or so", 3: "write to name [at] host [dot] com please",
    4: "my card 4222222222222 is lost", 5: "it stood at 10 . 0 . 0 . 1 for long", 6: "visa: 4111.1111.1111.1111, paid",
}
OTHER = {
    11: "see order id 4222222222222 there", 12: "serial 12345678901234567890 of it", 13: "a long 9807915762804490 number",
    14: "since version 10 . 0 . 0 . 1 only", 15: "hash 555-010-9999 in the list", 16: "look (at) i.j now",
}


@pytest.fixture(scope="module")
def found(spark, sf):
    """Spans of the cases among the given documents."""
    given = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id >= 100")
    cases = spark.createDataFrame([*WIDER.items(), *OTHER.items()], "doc_id long, text string")
    return {r.doc_id: r for r in pii.find(given.unionByName(cases), ["doc_id"]).where("doc.doc_id < 100").select("doc.doc_id", "base", "spans").collect()}


@pytest.mark.parametrize("case,value,kind", [(1, "(555) 010-9999", 3), (2, "555.010.9999", 3), (3, "name [at] host [dot] com", 0),
                                             (4, "4222222222222", 2), (5, "10 . 0 . 0 . 1", 1), (6, "4111.1111.1111.1111", 2)])
def test_wider_forms_are_selected(found, case, value, kind):
    start = WIDER[case].index(value)
    assert found[case].base == []
    assert [tuple(s) for s in found[case].spans] == [(start, kind, start + len(value))]


@pytest.mark.parametrize("case", sorted(OTHER))
def test_other_numbers_are_not(found, case):
    assert found[case].spans == found[case].base == []


def test_held_out_values_and_no_seeds():
    rows = pii.examples([])
    assert {r[0] for r in rows if r[1] and r[2]} == {r[0] for r in rows if r[1] and not r[2]} == {0, 1, 2, 3}
    assert len(rows) < 20_000


def test_every_base_span_counts(spark):
    n = 3 * pii.SEEDS
    docs = spark.createDataFrame([(i, f"write to u{i}@host{i % 7}.com, or not") for i in range(n)] * 2, "doc_id long, text string")
    values = pii.seeds(pii.collect_candidates(docs, ["doc_id"]))
    assert values.count() == n
    rows = pii.all_examples(values).withColumn("weight", pii.example_weights(values)).where("part = 0 and label")
    weights = [r.weight for r in rows.where(rows.features[16] == 1).select("weight").collect()]
    assert len(weights) >= n and set(weights) == {boosting.UNIT * pii.SEEDS // n}


def test_trees_of_a_table_are_those_of_its_rows(spark):
    dice = np.random.default_rng(1)
    table = dice.integers(0, [2, 9, 30], (600, 3))
    labels = (table[:, 1] + table[:, 2] // 3 + dice.integers(0, 6, 600) > 10)
    plain = boosting.fit(table.astype(float), labels.astype(float), trees=4)
    cuts = [np.unique(np.quantile(table[:, f], np.linspace(0, 1, 33)[:-1])) for f in range(3)]
    bins = np.stack([np.searchsorted(c, table[:, f]) for f, c in enumerate(cuts)], 1).astype(np.uint8)
    rows = [(r.tobytes(), bool(y), boosting.UNIT, 1) for r, y in zip(bins, labels)]
    model, _ = boosting.grow(spark.createDataFrame(rows, "bins binary, label boolean, weight long, n long").repartition(5), cuts, trees=4)
    assert np.allclose(boosting.predict(model, table), boosting.predict(plain, table), atol=1e-6)


def test_histograms_follow_the_rows_not_the_partitions(spark, monkeypatch):
    """Many shuffle partitions: as many partial sums as in one part, and all rows in them."""
    set_before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.openCostInBytes",
                                                 "spark.sql.files.maxPartitionBytes")}
    written = {}
    stage = pii.stage
    monkeypatch.setattr(pii, "stage", lambda df, name: written.setdefault(name, stage(df, name)))
    docs = spark.createDataFrame([(i, f"write to u{i}@host{i % 7}.com or call +1 (555) 010-{1000 + i}, will you") for i in range(300)], "doc_id long, text string")
    try:
        for key, value in zip(set_before, ("64", "false", "64k", "1m")):
            spark.conf.set(key, value)
        pii.fit_model(pii.collect_candidates(docs, ["doc_id"]), "many")
        binned = written["many-binned"]
        model, width = {"start": 0.0, "rate": 0.3, "trees": []}, len(pii.features(b"", 0, 0, 0))
        made = [boosting._partial_sums(rows, model, (1.0,), 1, width, 33).count() for rows in (binned, binned.coalesce(1))]
        counted = boosting._histograms(binned, model, (1.0,), 1, width, 33)[0, :, :, 2].sum(1)
    finally:
        for key, value in set_before.items():
            spark.conf.set(key, value)
    assert made[0] == made[1]
    assert set(counted) == {written["many-examples"].count()}


def test_parts_hold_all_rows(spark, monkeypatch):
    monkeypatch.setattr(boosting, "PART_ROWS", 100)
    rows = spark.range(950).repartition(40)
    assert [boosting.in_parts(rows, n).rdd.getNumPartitions() for n in (0, 100, 101, 950)] == [1, 1, 2, 10]
    assert boosting.in_parts(rows, 950).distinct().count() == 950
