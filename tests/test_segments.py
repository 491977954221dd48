"""Tables that change by deltas, against tables written anew."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from folioquery.operators import retrieval as R
from folioquery.sources import segments
from folioquery.sources.segments import Segments


def listing(folder):
    return {f"{a}/{b}" for a in os.listdir(folder) for b in os.listdir(f"{folder}/{a}")}


def test_any_changes_give_the_table_that_is_left(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "SMALLEST", 8)
    store = Segments(spark, f"file://{tmp_path}/t", "k", {"parts": lambda rows: rows.select("k", F.explode(F.split("v", "")).alias("part"))}, lambda: F.length("v"))
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    draw, held, merged = random.Random(3), {}, 0
    assert store.read() is None and store.version().number == 0
    for step in range(12):
        new = {draw.randrange(40): f"v{step}{draw.randrange(9)}" for _ in range(draw.choice([0, 2, 9]))}
        gone = [k for k in draw.sample(range(45), draw.choice([0, 3, 8])) if k not in new]
        before = store.version()
        after = store.change(frame(list(new.items())) if new or step == 0 else None, frame([(k, None) for k in gone]) if gone else None)
        held = {k: v for k, v in held.items() if k not in gone} | new
        assert after.number > before.number
        merged += after.number > before.number + 1
        assert {r.k: r.v for r in store.read().collect()} == held and after.rows == len(held) and after.weight == sum(map(len, held.values()))
        assert sorted((r.k, r.part) for r in store.read("parts").collect()) == sorted((k, c) for k, v in held.items() for c in v)
        assert {r.k: r.v for r in store.read(version=before).collect()} == was if step else True
        was = dict(held)
    assert merged and len(store.version().segments) < 12
    left = store.vacuum()
    assert left and {r.k: r.v for r in store.read().collect()} == held and store.vacuum() == []
    empty = store.change(deletes=frame([(k, None) for k in held]))
    assert empty.rows == empty.weight == empty.signature == 0 and store.read().count() == 0


def test_only_the_delta_is_written(spark, tmp_path):
    folder = f"{tmp_path}/t"
    store = Segments(spark, f"file://{folder}", "k")
    store.change(spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v")))
    before = listing(folder)
    rows = spark.range(5, 1003).select(F.col("id").alias("k"), F.when(F.col("id") == 7, "b").otherwise("a").alias("v"))
    version = store.refresh(rows)
    assert listing(folder) - before == {"rows/0000000002", "tombstones/0000000002", "versions/0000000002"}
    assert version.segments == {1: 1000, 2: 4} and version.tombstones == {2: 6}  # 7, 1000 to 1002; 0 to 4 and 7
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, rows.collect()))
    assert store.refresh(rows) == version and store.refresh(rows, new_keys=True) == version
    assert store.refresh(rows.withColumn("v", F.lit("c")), new_keys=True) == version  # as promised, only keys are looked at
    assert store.refresh(rows.where("k <> 9"), new_keys=True).rows == 997


def test_a_key_comes_back_and_a_stopped_writer_leaves_nothing(spark, tmp_path):
    folder = f"{tmp_path}/t"
    store, frame = Segments(spark, f"file://{folder}", "k"), lambda *rows: spark.createDataFrame(rows, "k long, v string")
    store.change(frame((1, "a"), (1, "a"), (2, "b")))
    store.change(deletes=frame((1, None), (9, None)))
    frame((1, "half")).write.parquet(f"file://{folder}/rows/0000000003")  # of a writer that never made its version
    assert {r.k for r in store.read().collect()} == {2}
    store.change(frame((1, "c")))
    assert {(r.k, r.v) for r in store.read().collect()} == {(1, "c"), (2, "b")}
    own = json.loads(spark.read.text(f"file://{folder}/versions/0000000003").first()[0])
    assert own["rows"] == 2 and set(own["segments"]) == {"1", "3"}
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        store._commit(store.version())


@pytest.mark.parametrize("exact", [False, True])
def test_search_in_a_changed_index_is_search_in_a_new_one(spark, tmp_path, monkeypatch, exact):
    monkeypatch.setattr(segments, "SMALLEST", 20)
    draw = random.Random(8)
    words = [f"word{k}" for k in range(30)] + ["the", "अमा"]
    text = lambda: " ".join(draw.choices(words, k=draw.randint(0, 12)))
    frame = lambda held: spark.createDataFrame([(k, k // 2, k % 2, t) for k, t in held.items()], "chunk_id long, item_id long, ordinal int, text string")
    store, held = R.index_store(spark, f"file://{tmp_path}/index"), {}
    asked = spark.createDataFrame([(1, "word1 word2"), (2, "word7"), (3, "अमा the"), (4, "wor"), (5, "missing")], "query_id long, text string")
    for _ in range(6):
        held = {k: t for k, t in held.items() if draw.random() > 0.2} | {draw.randrange(60): text() for _ in range(15)}
        store.refresh(frame(held))
        found = R.bm25(R.stored_index(store, exact), asked, R.RECOMMENDED, 10)
        fresh = R.build_index(frame(held), f"file://{tmp_path}/fresh-{draw.random()}", exact)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, R.bm25(fresh, asked, R.RECOMMENDED, 10).collect()))
    with pytest.raises(ValueError):
        R.stored_index(R.index_store(spark, f"file://{tmp_path}/none"))


def test_a_segment_of_dead_rows_goes(spark, tmp_path):
    """What is replaced to its last row, at once or bit by bit, is read and joined no more; unique rows are written as they come (F2)."""
    store = Segments(spark, f"file://{tmp_path}/t", "k")
    rows = lambda n, v: spark.range(n).select(F.col("id").alias("k"), F.lit(v).alias("v"))
    held = lambda: sorted(map(tuple, store.read().collect()))
    first = store.change(rows(100, "a"))
    version = store.change(store.read().withColumn("v", F.lit("b")), unique=True)
    assert (version.segments, version.tombstones, version.dead, version.rows) == ({2: 100}, {}, {}, 100) and held() == [(k, "b") for k in range(100)]
    assert store.read(version=first).where("v = 'a'").count() == 100  # of a version that is there already nothing goes
    version = store.change(rows(100, "c").where("k % 3 = 0"), unique=True)
    assert (version.segments, version.dead) == ({2: 100, 3: 34}, {2: 34})
    version = store.change(rows(100, "d").where("k % 3 > 0"), unique=True)
    assert (version.segments, version.dead, version.rows) == ({3: 34, 4: 66}, {}, 100) and held() == [(k, "d" if k % 3 else "c") for k in range(100)]
    version = store.change(deletes=rows(101, ""))
    assert version.rows == 0 and held() == [] and set(version.segments) == {4}
    store.change(rows(3, "e"))
    assert held() == [(k, "e") for k in range(3)] and store.version().rows == 3
    place = f"{tmp_path}/t/versions/{store.version().number + 1:010d}"  # as it was written before segments had dead rows
    own = {k: v for k, v in store.version().__dict__.items() if k != "dead"} | {"number": store.version().number + 1}
    spark.createDataFrame([(json.dumps(own),)], "value string").coalesce(1).write.text(f"file://{place}")
    assert held() == [(k, "e") for k in range(3)] and store.version().dead == {}
