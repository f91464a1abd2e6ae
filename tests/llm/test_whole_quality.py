"""Cases that lie outside what the given tables plant."""

from idsignal.llm import queries

BIG = "/root/testdata/sf0.1"


def test_quality_sees_repetition_and_word_shapes(spark):
    """Labelled junk without symbols, capitals or marks: repeated words, distinct words, word lengths."""
    judged = {r.doc_id: r for r in queries.op4_quality_rules(spark, BIG).collect()}
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{BIG}/labels.parquet").where("quality is not null").collect()}
    plain = [514, 1847, 2667, 4974, 7628, 7695]
    assert all(marks[i] == 0 and not judged[i].base_failed for i in plain)
    assert not any(judged[i].kept for i in plain)
    bad = [i for i, x in marks.items() if x == 0 and not judged[i].base_failed]
    good = [i for i, x in marks.items() if x == 1 and not judged[i].base_failed]
    assert sum(judged[i].kept for i in bad) <= 0.01 * len(bad)
    assert sum(not judged[i].kept for i in good) <= 0.002 * len(good)
