"""What keeps the queries within bounds as their tables grow: tasks, batches and shuffles, with the same rows as a plain way."""

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from tessel.functions import text as tx
from tessel.operators import fusion, index, social
from tessel.queries import registry
from tessel.streaming import jobs


def tasks_with_rows(df) -> int:
    return sum(n > 0 for n in df.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect())


def test_deliveries_of_one_room_are_the_work_of_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(jobs, "RUN", 8)
    monkeypatch.setattr(jobs, "SLICE", 3)
    rooms = lambda n: [7] * n + [8, 9, None]
    events = [(i, r, i % 50 if i % 5 else None) for i, r in enumerate(rooms(60))]
    members = [(r, i if i % 11 else None) for i, r in enumerate(rooms(45))] + [(7, 3), (7, 3)]
    got = jobs.deliveries(spark.createDataFrame(events, "event_id long, room long, sender long"), spark.createDataFrame(members, "room long, user_id long"))
    want = Counter((r, m, e) for e, r, s in events for q, m in members if r is not None and r == q and s is not None and m is not None and m != s)
    assert Counter(map(tuple, got.collect())) == want and max(want.values()) == 3
    assert tasks_with_rows(got) == 4


def test_nearby_of_a_crowd(spark, monkeypatch):
    """Crowds at a few places, users at several places, repeated rows and nulls, against a plain join."""
    monkeypatch.setattr(social, "RUN", 5)
    rows = [(i, 48.05 + (i % 4) * 2e-4, 11.3 + (i % 3) * 3e-4) for i in range(60)] + [(60, None, 11.3), (None, 48.05, 11.3)]
    for more in ([], [(5, 48.05, 11.3), (6, 48.0502, 11.3), (6, 48.0502, 11.3)]):
        t = spark.createDataFrame(rows + more, "user_id long, lat double, lon double")
        a, b = t.toDF("me", "lat0", "lon0"), t
        plain = a.join(b, F.col("me") != F.col("user_id")).select("me", F.col("user_id").alias("other"), social.haversine(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")).alias("meters"))
        plain = plain.filter("meters <= 50").distinct()
        got = social.nearby(t, t, 50.0)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, plain.collect()))
        rounded = social.nearby(t, b.select("*"), 50.0, digits=3)
        assert Counter(map(tuple, rounded.collect())) == Counter(map(tuple, plain.withColumn("meters", F.round("meters", 3)).collect()))
    crowd = spark.createDataFrame([(i, 48.05, 11.3) for i in range(300)], "user_id long, lat double, lon double")
    near = social.nearby(crowd, crowd, 50.0)
    assert near.count() == 300 * 299 and tasks_with_rows(near) == 4


def test_python_takes_a_batch_in_slices(monkeypatch):
    """No array that is made of a batch holds more than a slice's tokens, and the slices hold all rows."""
    lists = [["word"] * n for n in (3, 0, 9, 40, 1, 1, 6)] + [None, ["last"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9), pa.int64()), pa.array(lists, pa.list_(pa.string()))], ["doc_id", "tokens"])
    whole = [r for b in index._grouped(True)([batch]) for r in b.to_pylist()]
    monkeypatch.setattr(tx, "SLICE", 10)
    assert [(b.num_rows, len(b.column(1).flatten())) for b in tx.slices(batch)] == [(2, 3), (1, 9), (1, 40), (5, 9)]
    made = []
    analyzed = index.analyzed_tokens
    monkeypatch.setattr(index, "analyzed_tokens", lambda tokens, stem: made.append(len(tokens.flatten())) or analyzed(tokens, stem))
    assert [r for b in index._grouped(True)([batch.slice(1), batch.slice(0, 1)]) for r in b.to_pylist()] == whole[1:] + whole[:1]
    assert max(made) == 40 and sorted(made)[-2] <= 10


def test_spread_deals_by_size(spark, tmp_path, monkeypatch):
    """A task for each PART_BYTES where there are fewer parts than cores, all rows, and nothing where there are enough."""
    rows = spark.createDataFrame([(i, f"{i * 7919} text {i * i}") for i in range(3000)], "doc_id long, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert registry.spread(one).rdd.getNumPartitions() == 4
    monkeypatch.setattr(registry, "PART_BYTES", 2000)
    dealt = registry.spread(one.select("doc_id", "text"))
    assert dealt.rdd.getNumPartitions() > 8 and tasks_with_rows(dealt) > 8
    assert sorted(dealt.collect()) == sorted(rows.collect())
    rows.repartition(5).write.parquet(str(tmp_path / "five"))
    five = spark.read.parquet(str(tmp_path / "five")).repartition(5)
    assert registry.spread(five) is five


def test_cross_score_analyses_a_text_once(spark):
    """The plan holds the normalised text once, and the scores are those of the formula."""
    t = spark.createDataFrame([("deep x networks",), ("deep deep deep networks",), ("Deep\n NET-WORKS deep networks",), ("",), ("a",)], "text string")
    got = t.select("text", fusion.cross_score("deep networks", F.col("text")).alias("cross"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2
    assert [round(r["cross"], 6) for r in got.collect()] == [0.633333, 1.0, 1.0, 0.0, 0.2]


def test_bigram_counts(spark, monkeypatch):
    """Against a plain count, also of keys with several rows; those with one are not shuffled."""
    monkeypatch.setattr(tx, "SLICE", 6)
    rows = [(1, "the cat saw the cat, the cat!"), (2, "of an ox"), (3, None), (4, ""), (5, "one two six one two"), (None, "one two"), (6, "abc")]
    for more in ([], [(1, "cat saw the cat"), (5, "two six"), (None, "one two")]):
        t = spark.createDataFrame(rows + more, "doc_id long, text string")
        want = Counter()
        for key, text in rows + more:
            words = "".join(c for c in (text or "").lower() if c.isalnum() or c == " ").split()
            want.update((key, f"{a} {b}") for a, b in zip(words, words[1:]) if len(a) >= 3 and len(b) >= 3)
        got = tx.bigram_counts(t)
        assert {(r["doc_id"], r["bigram"]): r["n"] for r in got.collect()} == want and got.count() == len(want)
        assert ("Exchange" in got._jdf.queryExecution().toString()) == bool(more)
