"""The pipeline's stages on odd input."""

from collections import Counter

import corpus_pipeline
import pytest

from .helpers import ODD_NAMES, clashing, corpus, docs, odd, write

LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"


def staged(spark, d, place):
    """(name, rows) of every stage, each on what the one before kept."""
    out = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, d, place)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert found.columns == d.columns
        d = spark.createDataFrame(found.collect(), found.schema)
        out.append((name, d))
    return out


def test_stages_on_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    rows = corpus()
    rows += [(None, "another text without an id " * 3, None, None, None), rows[0]]
    d = clashing(docs(spark, rows)).drop("shard", "slot")
    place = write(spark, tmp_path, documents=d, labels=spark.createDataFrame([], LABELS), benchmark=spark.createDataFrame([(1, None), (None, "")], ITEMS))
    found = dict(staged(spark, d, place))
    kept = [r for r in found["quality"].collect()]
    assert Counter(r.doc_id for r in kept) == Counter(r[0] for r in rows if (r[1] or "").split())  # no labels: only wordless texts go
    single = found["near_duplicates"].collect()
    assert len({r.text for r in single}) == len(single) and rows[0][0] in {r.doc_id for r in single}
    assert sum(r.doc_id is None for r in single) == 2 and max(len(r.text) for r in single) == max(len(r[1] or "") for r in rows)
    assert Counter(found["decontamination"].collect()) == Counter(single)
    last = found["sharding"].collect()
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in found["mixing"].collect()) and len({(r.shard, r.slot) for r in last}) == len(last)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_columns_of_any_name_come_out_unchanged(spark, tmp_path, name, stage):
    rows = [r for r in corpus() if r[1] is not None] + [corpus()[3]] * 3
    d = odd(docs(spark, rows))
    labels = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (1, 1, 0), (2, 1, 0), (4, 0, 0)], LABELS)
    place = write(spark, tmp_path, labels=labels, benchmark=spark.createDataFrame([(1, rows[7][1])], ITEMS))
    found = stage(spark, d, place)
    assert found.columns == d.columns + (["shard", "slot"] if name == "sharding" else [])
    got = [r.asDict(recursive=True) for r in found.collect()]
    assert got
    for r in got:
        key = -1 if r["doc_id"] is None else r["doc_id"]
        assert [r[x] for x in ODD_NAMES] == [f"{i}:{key}" for i in range(len(ODD_NAMES))]
        assert r["map"] == {"k": r["doc_id"]} and r["deep"] == {"in.side": [{"k": r["doc_id"]}], "none": None} and r["list"] == [{"k": r["doc_id"]}]
    plain = stage(spark, docs(spark, rows), place)
    assert Counter(r["doc_id"] for r in got) == Counter(r.doc_id for r in plain.collect())


def test_empty_tables_pass_all_stages(spark, tmp_path):
    d = docs(spark, [])
    place = write(spark, tmp_path, documents=d, labels=spark.createDataFrame([], LABELS), benchmark=spark.createDataFrame([], ITEMS))
    assert [x.count() for _, x in staged(spark, d, place)] == [0] * 5 and corpus_pipeline.run(spark, place).count() == 0
