import duckdb
import pytest

import corpus_pipeline
from folioquery.llm import queries, sql
from folioquery.llm.shared import written


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns
        docs = written(after, "stage")
        kept.append(docs.count())
    texts = [r.text for r in docs.collect()]
    assert before >= kept[0] >= kept[1] >= kept[2] > 0.5 * before and kept[1] < before and len({t.lower() for t in texts}) == len(texts)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
    whole = corpus_pipeline.run(spark, sf)
    assert whole.count() == pieces.count() and set(whole.columns) == set(pieces.columns)


NEAR = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
ROWS = [(3, "text a"), (5, "TEXT A"), (5, "text b"), (9, "text b"), (None, "text c"), (10, "text c"), (None, "no other"), (None, None), (11, ""), (12, NEAR), (13, NEAR + " end"), (13, "quite another text of thirteen"), (14, "é" * 100_000), (15, "same row"), (15, "same row"), (16, " ")]


def test_stages_decide_by_row(spark, sf, tmp_path):
    """Null and repeated doc_ids, empty and long texts, columns that clash, an empty table."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, key string, row long, kept boolean, node string, row_of_stage string, `Row_Of_Stage_` long"
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "k", n, False, "n", "mine", 7) for n, (i, t) in enumerate(ROWS)], columns)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert sorted(map(repr, stages["toxicity"](spark, docs, str(tmp_path)).collect())) == sorted(map(repr, docs.collect()))
    exact = written(stages["exact dedup"](spark, docs, str(tmp_path)), "t")
    assert {(r.row_of_stage, r.Row_Of_Stage_) for r in exact.collect()} == {("mine", 7)}
    got = sorted(((r.doc_id, r.text) for r in exact.collect()), key=repr)
    want = [(5, "TEXT A"), (9, "text b"), (10, "text c"), (None, "no other"), (11, ""), (12, NEAR), (13, NEAR + " end"), (13, "quite another text of thirteen"), (14, "é" * 100_000), (15, "same row"), (16, " ")]
    assert exact.columns == docs.columns and got == sorted(want, key=repr)
    near = stages["near dedup"](spark, exact, str(tmp_path))
    assert near.columns == docs.columns and sorted(((r.doc_id, r.text) for r in near.collect()), key=repr) == sorted((x for x in want if x != (13, NEAR + " end")), key=repr)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.select("doc_id").distinct().count() == len({i for i, _ in want})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_written_tables_are_deleted(spark, sf):
    import os

    from folioquery.llm.shared import shared_root

    place = shared_root(spark).removeprefix("file://")
    before = set(os.listdir(place))
    found = corpus_pipeline.run(spark, sf)
    after = {n.rsplit("-", 1)[0] for n in set(os.listdir(place)) - before}
    assert after == {"near-dedup"} and found.count()


def test_every_operator_has_its_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    found = c.execute(sql.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(found.fetchall())
