import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel import catalog
from tessel.functions import wordpiece
from tessel.operators import dense, evaluation, fusion, graph, index, lexical, mutation, social
from tessel.operators.index import Index
from tessel.plans.search import Engine, LruCache
from tessel.sources import files


@pytest.fixture(scope="module")
def docs(spark):
    rows = ["machine learning systems", "deep learning networks learn", "cloud computing for machines", "the database of learning machines", "machine learning systems", ""]
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")


def test_postings_and_search(spark, docs):
    ix = Index(docs, "stem")
    p = {(r["term"], r["doc_id"]): (r["tf"], r["positions"]) for r in ix.postings.collect()}
    assert p["learn", 1] == (2, [1, 3])
    a, b = lexical.search(ix, "machine learning", 3).collect(), lexical.search_pruned(ix, "machine learning", 3).collect()
    assert a == b and len(a) == 3
    ties = [r["doc_id"] for r in lexical.search(ix, "systems", 5).collect()]
    assert ties == [0, 4]
    assert lexical.search(ix, "the of", 5).count() == 0
    assert {r["doc_id"] for r in lexical.phrase(ix, ["machin", "learn"]).collect()} == {0, 4}


def test_save_load(spark, docs, tmp_path):
    ix = Index(docs, "stop")
    ix.save(str(tmp_path / "ix"))
    got = Index.load(spark, str(tmp_path / "ix"))
    assert sorted(got.postings.collect()) == sorted(ix.postings.collect())


def test_empty_corpus(spark, docs):
    ix = Index(docs.limit(0), "stop")
    assert lexical.search(ix, "machine", 5).count() == 0 and ix.stats.first()["avgdl"] == 0


def test_filters(spark):
    t = spark.createDataFrame([(1, "AI", 2022.0), (2, "AI", 2024.0), (3, "Cloud", 2025.0)], "doc_id int, category string, year double")
    ids = lambda e: [r[0] for r in t.filter(fusion.filter_expr(e, {"year"})).orderBy("doc_id").collect()]
    assert ids("") == [1, 2, 3] and ids("category:AI") == [1, 2] and ids("category:AI,year:>=2024") == [2] and ids("year:>2024") == [3]
    assert ids("nonsense") == [] and ids("nonsense,category:Cloud") == [3] and ids("category: AI") == [] and ids("year:2024") == []
    with pytest.raises(ValueError):
        fusion.filter_expr("year:>=x", {"year"})


def test_rrf(spark):
    a = spark.createDataFrame([(1, 3.0), (2, 2.0)], "doc_id int, score double")
    b = spark.createDataFrame([(2, 0.9), (3, 0.8)], "doc_id int, sim double")
    got = [(r["doc_id"], r["rrf"]) for r in fusion.rrf(a, b, 5).collect()]
    assert got == [(2, round(1 / 62 + 1 / 61, 9)), (1, round(1 / 61, 9)), (3, round(1 / 62, 9))]


def test_rerank_floor(spark):
    c = spark.createDataFrame([(1, 1.0, "nothing here"), (2, 0.5, "deep networks"), (3, 0.1, "neural deep networks neural")], "doc_id int, score double, text string")
    got = {r["doc_id"]: r["cross"] for r in fusion.rerank("deep networks", c).collect()}
    assert got[1] == 0.2 and got[2] == 1.0 and 0.2 < got[3] <= 1.0


def test_vectors(spark, tmp_path):
    x = np.random.RandomState(42).standard_normal((60, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    t = spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    files.write_vectors(t, str(tmp_path / "v.bin"))
    back = files.read_vectors(spark, str(tmp_path / "v.bin"))
    assert sorted(back.collect()) == sorted(t.collect())
    assert [r[0] for r in dense.knn(t, x[4], 3).collect()] == (np.argsort(-(x @ x[4]))[:3] + 1).tolist()
    top = dense.sq8_search(dense.sq8(t), x[4], 1).first()
    assert top["vec_id"] == 5
    dense.save_sq8(dense.sq8(t), str(tmp_path / "sq8"))
    back = dense.load_sq8(spark, str(tmp_path / "sq8"))
    assert sorted(map(str, back.collect())) == sorted(map(str, dense.sq8(t).collect()))
    assert dense.sq8_search(back, x[4], 3).collect() == dense.sq8_search(dense.sq8(t), x[4], 3).collect()
    for other in (dense.load_sq8, graph.load):
        with pytest.raises(Exception, match="version 1|PATH_NOT_FOUND"):
            other(spark, str(tmp_path / "nothing"))


def test_vector_files_of_several_parts(spark, tmp_path):
    t = spark.createDataFrame([(i, [float(i), -float(i)]) for i in range(1, 51)], "vec_id long, embedding array<float>").repartition(5)
    files.write_vectors(t, str(tmp_path / "v"), rows=8)
    assert len([f for f in (tmp_path / "v").iterdir() if f.suffix == ".bin"]) > 1
    assert sorted(files.read_vectors(spark, str(tmp_path / "v")).collect()) == sorted(t.collect())
    (tmp_path / "v" / "part-000009.bin").write_bytes(b"\x05\0\0\0\x05\0\0\0short")
    with pytest.raises(Exception, match="not a vector file"):
        files.read_vectors(spark, str(tmp_path / "v")).collect()


def test_graph(spark, tmp_path):
    x = np.random.RandomState(5).standard_normal((900, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)], "vec_id long, embedding array<float>")
    files.write_vectors(t.filter("embedding is not null"), str(tmp_path / "v"))
    graph.build_from_file(spark, str(tmp_path / "v"), str(tmp_path / "g"))
    saved = graph.load(spark, str(tmp_path / "g"))
    assert saved.count() == 900 and saved.filter("entry").count() == 1 and saved.agg(F.max("level")).first()[0] >= 1
    asked = t.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(r["query_id"], r["vec_id"]) for r in dense.knn_batch(t, asked, 10).collect()}
    for g, shift in ((saved, 1), (graph.build(t, 3), 0)):
        got = {(r["query_id"], r["vec_id"] - shift) for r in graph.search(g, asked, 10).collect()}
        assert len(got) == len(exact) == 180 and len(got & exact) >= 0.95 * len(exact)
    assert graph.search(graph.build(t.limit(0)), asked, 10).collect() == []
    assert graph.search(graph.build(t.filter("vec_id = 3")), asked, 10).count() == 18


def test_knn_batch(spark):
    """Blocks of both sides, ties, null vectors and too few rows; the driver never collects the queries."""
    x = np.round(np.random.RandomState(1).standard_normal((90, 4)), 1)
    x[40:60] = x[3]
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(100, None)], "vec_id long, embedding array<double>").repartition(3)
    q = t.filter("vec_id % 2 = 0").withColumnRenamed("vec_id", "query_id")
    q.toPandas = None
    want = {(i, int(v), n + 1) for i in range(0, 90, 2) for n, v in enumerate(np.lexsort((np.arange(90), -np.round(x @ x[i], 6)))[:10])}
    for sizes in ({}, {"block": 7, "query_block": 4}):
        got = dense.knn_batch(t, q, 10, **sizes).collect()
        assert {(r["query_id"], r["vec_id"], r["rank"]) for r in got} == want and len(got) == len(want)
    assert dense.knn_batch(t.filter("vec_id < 3"), q.filter("query_id = 2"), 10).count() == 3
    assert dense.knn_batch(t, q.limit(0), 10).collect() == [] and dense.knn_batch(t.limit(0), q, 10).collect() == []


def test_searches_ask_every_id_divisible_by_50(spark):
    """The registered graph search against the exact one: recall@10 of 0.95 at least."""
    d = "/root/testdata/sf0.01"
    exact, got = ({(r["query_id"], r["vec_id"]) for r in catalog.QUERIES[q](spark, d).collect()} for q in ("d2_knn_batch", "d3_d4_ann_search"))
    ids = {r[0] for r in spark.read.parquet(f"{d}/embeddings.parquet").filter("vec_id % 50 = 0").select("vec_id").collect()}
    assert {q for q, _ in exact} == {q for q, _ in got} == ids and len(exact) == len(got) == 10 * len(ids)
    assert len(exact & got) >= 0.95 * len(exact)


def test_index_parts(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 3)
    monkeypatch.setattr(index, "CELLS", 4)
    ids = [-7, 0, 1, 4, 5, 9, 10, 11, 300, 5000]
    docs = spark.createDataFrame([(i, "alpha beta" if i % 2 else "alpha") for i in ids], "doc_id long, text string")
    ix = Index(docs, "stop")
    got = sorted((r["term"], r["doc_id"], r["idx"], r["gap"], r["decoded"]) for r in index.numbered(ix.postings).collect())
    want = []
    for term, mine in (("alpha", ids), ("beta", [i for i in ids if i % 2])):
        want += [(term, d, n, d - (mine[n - 1] if n else 0), d) for n, d in enumerate(mine)]
    assert got == want
    assert index.cut_points(docs, [0, 3, 9]) == [-7, 4, 5000]
    assert sorted((r["doc_id"], r["segment"]) for r in index.segments(docs, 4).collect()) == [(d, n // 3) for n, d in enumerate(ids)]
    assert {(r["doc_id"], r["segment"]) for r in index.segment_postings(docs, 4, "stop").collect()} == {(d, n // 3) for n, d in enumerate(ids)}
    assert index.segments(docs.limit(0), 4).collect() == []
    one = sorted(ix.sorted().postings.collect())
    assert one == sorted(ix.snapshot().postings.collect()) == sorted(ix.postings.collect())
    ix.close()


def test_pruning_skips_and_keeps_the_result(spark):
    rnd = np.random.RandomState(2)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choice(vocabulary, 12, p=np.arange(40, 0, -1) / 820))) for i in range(300)]
    ix = Index(spark.createDataFrame(rows, "doc_id long, text string"), "stop")
    skipped = 0
    for q in ("w0 w39", "w39 w38 w1", "w0 w1 w2", "nothing", "w5 w5 w30"):
        a, b = lexical.search(ix, q, 5).collect(), lexical.search_pruned(ix, q, 5).collect()
        assert a == b
        s = lexical.pruning_stats(ix, q, 5).first()
        assert s["candidates"] == s["evaluated"] + s["skipped"] and s["evaluated"] >= len(a)
        skipped += s["skipped"]
    assert skipped > 0


def test_word_pieces(spark, tmp_path):
    pieces = ["[PAD]", "un", "##aff", "##able", "the", "cat", "##s", ",", "[CLS]", "[SEP]", "[UNK]"]
    (tmp_path / "vocab.txt").write_text("\n".join(pieces) + "\n")
    v = wordpiece.read_vocabulary(spark, str(tmp_path / "vocab.txt"))
    assert v == {p: i for i, p in enumerate(pieces)}
    assert wordpiece.word_pieces("unaffable", v) == [1, 2, 3] and wordpiece.word_pieces("unaffx", v) == [1, 2, 100] and wordpiece.word_pieces("x", v) == [100]
    assert wordpiece.whole_word_pieces("unaffx", v) == [10] and wordpiece.whole_word_pieces("cats", v) == [5, 6]
    assert wordpiece.single_ids("The  CAT\u00e9s x", v) == [101, 4, 5, 6, 100, 102] and wordpiece.single_ids(None, v) == [101, 102]
    assert len(wordpiece.single_ids("cats " * 200, v)) == 128
    ids, segments = wordpiece.pair_ids(["the", "cats"], ["unaffable"], v)
    assert ids == [8, 4, 5, 6, 9, 1, 2, 3, 9] and segments == [0, 0, 0, 0, 1, 1, 1, 1, 1]
    ids, _ = wordpiece.pair_ids(["cats"] * 9, ["the"] * 9, v, 8)
    assert ids == [8, 5, 6, 5] + [5] * 7 + [9] + [4] * 9 + [9]  # each token past the cap still adds one piece
    t = spark.createDataFrame([(1, "the cats"), (2, None)], "id int, text string")
    assert {r["id"]: r["ids"] for r in wordpiece.encoded(t, v).collect()} == {1: [101, 4, 5, 6, 102], 2: [101, 102]}


def test_pair_model_and_encoder(spark):
    t = spark.createDataFrame([("q", "abc"), ("", "x"), ("q", None)], "query string, text string")
    got = {(r["query"], r["text"]): r["cross"] for r in fusion.cross_score_model(t, lambda q, d: [float(len(x) - 3) for x in d]).collect()}
    assert got == {("q", "abc"): 0.5, ("", "x"): 0.0, ("q", None): 0.0}
    calls = dense.encode(t, lambda texts: np.array([[float(len(texts)), 0.0]] * len(texts)), batch=2).collect()
    assert sorted(r["embedding"][0] for r in calls) == [1.0, 2.0, 2.0] or len(calls) == 3
    with pytest.raises(Exception, match="unit length"):
        dense.encode(t, lambda texts: np.array([[2.0, 0.0]] * len(texts)), unit=1e-4).collect()


def test_mean_gain(spark):
    of = lambda rows: spark.createDataFrame(rows, "query_id string, ndcg double")
    r = evaluation.mean_gain(of([("a", 0.5), ("b", 0.0)]), of([("a", 1.0), ("c", 0.5)])).first()
    assert (r["base_ndcg"], r["new_ndcg"], r["gain_percent"]) == (0.166667, 0.5, 200.0)
    assert evaluation.mean_gain(of([("a", 0.0)]), of([("a", 1.0)])).first()["gain_percent"] == 0


def test_log_file_and_table(spark, tmp_path):
    rows = [(1, 5, "a"), (2, 7, ""), (3, 5, "\u00e9" * 3)]
    raw = struct.pack("<II", mutation.LOG_MAGIC, mutation.LOG_VERSION) + b"".join(mutation.log_record(*r) for r in rows)
    assert mutation.log_records(raw) == rows and mutation.log_records(raw[:-1]) == rows[:2] and mutation.log_record(2, 7, "x") == mutation.log_record(2, 7, "")
    with pytest.raises(ValueError):
        mutation.log_records(b"\0" * 9)
    log = mutation.MutationLog(spark, str(tmp_path / "log")).open()
    t = spark.createDataFrame([(1, 1, 1, "a"), (2, 2, 1, None)], log.SCHEMA)
    log.append(t)
    log.open().append(t.selectExpr("seq + 2 as seq", "op", "doc_id + 1 as doc_id", "content"))
    assert sorted(r["seq"] for r in log.rows().collect()) == [1, 2, 3, 4] and mutation.replay(log.rows()).collect() == []
    log.clear()
    assert log.rows().collect() == [] and log.open().rows().count() == 0
    log.append(t)
    assert log.rows().count() == 2


def test_encrypted_messages(spark):
    """A published test vector of the mode, then what comes back of messages and of changed ones."""
    zero = spark.createDataFrame([("\0" * 16,)], "text string")
    m = zero.select(social.encrypted(F.col("text"), F.lit("\0" * 32), F.unhex(F.lit("00" * 12))).alias("m")).first()["m"]
    assert m == "00" * 12 + ":d0d1c8a799996bf0265b98b5d48ab919:cea7403d4d606b6e074ec5d3baf39d18"
    key = F.lit("0123456789abcdef0123456789abcdef")
    t = spark.createDataFrame([("hello \u00e9",), ("",), (None,)], "text string").withColumn("m", social.encrypted(F.col("text"), key))
    rows = t.select("text", "m", social.decrypted(F.col("m"), key).alias("back"), social.decrypted(F.reverse("m"), key).alias("changed")).collect()
    assert all(r["text"] == r["back"] and r["changed"] is None for r in rows)


def test_query_params(spark):
    t = spark.createDataFrame([("http://h/p?a=1&b=x+y%26z&a=2&c&d=&e=1=2#f=3",), ("http://h/p",), ("http://h/?%zz=%zz",), (None,)], "url string")
    got = {r["url"]: r["p"] for r in t.withColumn("p", files.query_params(F.col("url"))).collect()}
    assert got[t.first()["url"]] == {"a": "2", "b": "x y&z", "d": "", "e": "1=2"} and got["http://h/p"] == {} and got["http://h/?%zz=%zz"] == {"%zz": "%zz"}


def test_replay(spark):
    log = spark.createDataFrame([(1, 1, 1, "a"), (2, 1, 2, "b"), (3, 2, 1, None), (4, 3, 2, "c"), (5, 2, 9, None), (6, 1, 1, "d")], "seq long, op int, doc_id long, content string")
    assert sorted(mutation.replay(log).collect()) == [(1, "d"), (2, "c")]
    assert [r[0] for r in mutation.tombstones(log).collect()] == [9]


def test_presence(spark):
    t = spark.createDataFrame([(1, u, f"2024-01-01 00:00:{s:06.3f}" if s < 60 else f"2024-01-01 00:01:{s - 60:06.3f}") for u, s in ((1, 0.0), (2, 0.0))], "event_id int, user_id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    at = lambda s: {r["status"] for r in social.presence(t, F.lit(f"2024-01-01 00:0{s // 60}:{s % 60:02d}").cast("timestamp")).collect()}
    assert at(15) == {"ACTIVE"} and at(16) == {"GHOSTING"} and at(75) == {"GHOSTING"} and at(76) == {"OFFLINE"}


def test_engine_and_cache(spark, docs):
    e = Engine(docs, dead=spark.createDataFrame([(0,)], "doc_id long"))
    assert [r["doc_id"] for r in e.search("systems", k=3).collect()] == [4]
    assert e.collected("systems", k=3) is e.collected("systems", k=3)
    assert not e.click(0) and e.click(4) and e.click(4)
    assert e.search("systems", k=3).first()["score"] > lexical.search(e.index, "systems", 3).collect()[1]["score"]
    assert [r["doc_id"] for r in e.search("sistems", k=3, spell=True).collect()] == [4] and [r["doc_id"] for r in e.collected("sistems", k=3, spell=True)] == [4]
    assert e.command("wand machine learning") and e.command("click 0") == [False] and e.command("click x") == [] and e.command("systems")[0]["doc_id"] == 4
    new = spark.createDataFrame([(9, "systems systems of systems"), (1, "plain")], "doc_id long, text string")
    assert e.document("POST", new) and not e.document("PUT", new)
    assert [r["doc_id"] for r in e.collected("systems", k=3)][0] == 9 and e.collected("deep", k=3) == []
    assert e.document("DELETE", new.filter("doc_id = 9")) and [r["doc_id"] for r in e.collected("systems", k=3)] == [4]
    c = LruCache(2)
    for k in "aba":
        c.put(k, k)
    c.put("c", "c")
    assert c.get("b") is None and c.get("a") == "a"
    assert LruCache(0).put("x", 1) is None


def test_social_queries_return_every_row(spark):
    d, q = "/root/testdata/sf0.01", catalog.QUERIES
    ids = lambda name, column: {r[0] for r in spark.read.parquet(f"{d}/{name}.parquet").select(column).distinct().collect()}
    users = q["r27_user_with_profiles"](spark, d).collect()
    assert {r["user_id"] for r in users} == ids("customer", "c_custkey") and len(users) == 3 * len({r["user_id"] for r in users})
    pending = q["r10_incoming_pending"](spark, d).collect()
    assert {r["to_id"] % 5 for r in pending} == set(range(5))
    convs = ids("conversations", "conv_id")
    mine = q["r19_conversations"](spark, d).collect()
    assert {(r["me"], r["conv_id"]) for r in mine} == {(p, c) for c in convs for p in (c % 100, 100 + c % 77)} and len(mine) == 2 * len(convs)
