"""Exact and approximate search, lexical search and fusion."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.operators import ann, bm25, hybrid, knn, metrics


def vectors(spark, rows, key="vec_id"):
    data = [(k, (np.array(v) / (np.linalg.norm(v) or 1)).astype(np.float32).tolist()) for k, v in rows]
    return spark.createDataFrame(data, f"{key} long, embedding array<float>")


@pytest.fixture(scope="module")
def waves(spark):
    return vectors(spark, [(i, [math.cos(37 * i + 13 * d) for d in range(32)]) for i in range(200)]).cache()


def query(spark, values):
    return vectors(spark, [(-1, values)])


def test_knn_finds_itself_first(spark, waves):
    got = knn.knn(waves, waves.where("vec_id = 42"), 5).collect()
    assert len(got) == 5 and got[0].id == 42 and got[0].score > 0.999
    assert [r.distance for r in got] == sorted(r.distance for r in got)


def test_knn_against_numpy(spark, waves):
    x = np.array([r.embedding for r in waves.orderBy("vec_id").collect()], dtype=float)
    q = x[7]
    for metric, far in (("cosine", 1 - np.clip(x @ q, -1, 1)), ("dot", -(x @ q)), ("euclidean", np.sqrt(((x - q) ** 2).sum(1)))):
        want = sorted(range(200), key=lambda i: (round(far[i], 6), i))[:10]
        assert [r.id for r in knn.knn(waves, waves.where("vec_id = 7"), 10, metric, round_to=6).collect()] == want
        batch = knn.knn_batch(waves, waves.where("vec_id in (7, 8)"), 10, metric, round_to=6, most_queries=1).where("qid = 7").orderBy("rank").collect()
        assert [r.id for r in batch] == want


def test_filters_tombstones_and_edges(spark, waves):
    q = waves.where("vec_id = 3")
    assert all(r.id % 2 == 0 for r in knn.knn(waves, q, 20, where="vec_id % 2 = 0").collect())
    gone = waves.where("vec_id < 100").select("vec_id")
    assert min(r.id for r in knn.knn(waves, q, 50, exclude=gone).collect()) >= 100
    assert 3 not in [r.id for r in knn.find_similar(waves, 3).collect()]
    assert knn.knn(waves.limit(0), q).count() == 0
    assert knn.knn_batch(waves, waves.limit(0)).count() == 0
    same = vectors(spark, [(i, [1, 1]) for i in (5, 3, 9)])
    assert [r.id for r in knn.knn(same, same.limit(1), 2).collect()] == [3, 5]


@pytest.mark.parametrize("quantization", ["sq8", "bq"])
def test_quantized_search(spark, waves, quantization):
    got = knn.knn(waves, waves.where("vec_id = 25"), 5, quantization=quantization).collect()
    assert len(got) == 5 and got[0].distance == min(r.distance for r in got) and 25 in [r.id for r in got] and got[0].score > 0.95


def test_graph_recall_on_held_out_queries(spark):
    rng = np.random.default_rng(5)
    data = vectors(spark, [(i, rng.normal(size=32)) for i in range(600)]).cache()
    index, asked = data.where("vec_id >= 40"), data.where("vec_id < 40")
    nodes = ann.build_graph(index, shard_vectors=300).cache()
    assert nodes.count() == 560 and nodes.select("shard").distinct().count() == 2
    exact = knn.knn_batch(index, asked, 10)
    assert ann.recall(ann.search_graph(nodes, asked, 10, ef=64), exact, 10).first().recall >= 90
    sizes = nodes.select(F.size(F.element_at("neighbors", 1)).alias("n")).agg(F.max("n")).first()[0]
    assert sizes <= 32
    found = ann.search_graph(nodes, asked, 5, ef=64, allowed=index.where("vec_id % 2 = 0").select("vec_id"), tombstones=index.where("vec_id % 4 = 0").select("vec_id"))
    assert all(r.id % 4 == 2 for r in found.collect())


def test_compaction_and_renumbering(spark, waves):
    nodes = ann.build_graph(waves.limit(40))
    ids = [r.id for r in nodes.collect()]
    gone = spark.createDataFrame([(i,) for i in ids[:15]], "id long")
    live = ann.drop_tombstones(nodes, gone).orderBy("node").collect()
    assert [r.node for r in live] == list(range(25)) and not {r.id for r in live} & set(ids[:15])
    assert all(0 <= n < 25 for r in live for layer in r.neighbors for n in layer)
    again = ann.compact(nodes, gone)
    assert {r.id for r in again.collect()} == set(ids[15:])
    links = spark.createDataFrame([(1, 0, d, float(d)) for d in range(9)], "src int, layer int, dst int, distance double")
    assert ann.prune_links(links, 4).count() == 4


def bm25_model(docs, question, k1=1.2, b=0.75):
    import re

    tokens = {i: [w for w in re.split(r"\s+", re.sub(r"[^a-z0-9_\-\s]", " ", t.lower())) if len(w) > 1 and w not in ("the", "and", "is", "of", "for")] for i, t in docs.items()}
    n, avg = len(docs), sum(map(len, tokens.values())) / max(1, len(docs))
    out = {}
    for term in [w for w in re.split(r"\s+", question.lower()) if len(w) > 1]:
        df = sum(term in t for t in tokens.values())
        for i, t in tokens.items():
            tf = t.count(term)
            if tf:
                out[i] = out.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avg))
    return out


def test_bm25_against_a_model(spark):
    docs = {1: "PgBouncer handles pooling for Postgres and pooling is fast", 2: "Kafka streams the events", 3: "", 4: "pooling of pooling pooling"}
    index = bm25.BM25Index.build(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    want = bm25_model(docs, "PgBouncer pooling pooling")
    got = {r.id: r.score for r in index.search("PgBouncer pooling pooling").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert index.search("PgBouncer pooling").first().id == 1
    assert [r.id for r in index.search("pooling", where="id = 4").collect()] == [4]
    assert index.search("the of").count() == 0 and index.search("absent").count() == 0
    assert index.stats().first().n == 4
    gone = index.remove(spark.createDataFrame([(4,)], "i long"))
    assert [r.id for r in gone.search("pooling").collect()] == [1] and gone.stats().first().n == 3
    new = index.add(spark.createDataFrame([(2, "pooling")], "doc_id long, text string"))
    assert {r.id for r in new.search("pooling").collect()} == {1, 2, 4} and new.stats().first().n == 4 and index.search("kafka").count() == 1 and new.search("kafka").count() == 0
    batch = index.search_batch(spark.createDataFrame([(9, "pooling"), (8, "kafka")], "item_id long, text string"), 1).collect()
    assert {(r.qid, r.id) for r in batch} == {(9, 4), (8, 2)}


def test_fusion(spark):
    dense = spark.createDataFrame([("A", 0.9), ("B", 0.8), ("C", 0.7)], "id string, score double")
    sparse = spark.createDataFrame([("B", 4.5), ("D", 3.2), ("A", 2.1)], "id string, score double")
    got = hybrid.reciprocal_rank_fusion(dense, sparse, 4).collect()
    assert [r.id for r in got] == ["B", "A", "C", "D"] and got[0].combined_score == 1
    raw = 1 / 62 + 0.8 / 61
    assert abs(got[1].combined_score - (1 / 61 + 0.8 / 63) / raw) < 1e-12 and got[3].dense_rank is None and got[2].sparse_score is None
    assert hybrid.reciprocal_rank_fusion(dense.limit(0), sparse.limit(0)).count() == 0
    assert [r.combined_score for r in hybrid.relative_scores(sparse).orderBy(F.desc("score")).collect()][0] == 1


def test_figures(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(1, 101)], "ms double")
    r = metrics.latency(rows).first()
    assert (r.iterations, r.p50, r.p95, r.p99, r.qps) == (100, 51, 96, 100, 20)
    assert [x[0] for x in spark.createDataFrame([(96.0,), (80.0,), (10.0,)], "r double").select(metrics.grade(F.col("r"))).collect()] == ["green", "amber", "red"]


def test_graph_queries_search_the_whole_table_in_blocks(spark, tmp_path):
    from skarn import queries

    r = np.random.default_rng(5)
    x = r.normal(size=(400, 16))
    rows = [(i, i % 10, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    vectors = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    asked = vectors.where("vec_id % 50 = 0")
    exact = knn.knn_batch(vectors, asked, 10)
    found = queries.hnsw_search(spark, str(tmp_path))
    assert {(a.qid, a.id) for a in found.where("rank = 1").collect()} == {(i, i) for i in range(0, 400, 50)}
    assert ann.recall(found, exact, 10).first().recall >= 95
    blocks = queries._found(ann.search_graph(ann.build_graph(vectors), asked, 10, ef=queries.EF, most_queries=3))
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, found.collect()))


def test_checked_search_finds_what_a_narrow_beam_misses(spark):
    x = np.random.default_rng(5).normal(size=(900, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x[600:630] = x[0]
    vectors = spark.createDataFrame([(k, v.tolist(), k % 10) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    asked, some, gone = vectors.where("vec_id % 50 = 0"), vectors.where("label < 5").select("vec_id"), vectors.where("vec_id % 3 = 0").select("vec_id")
    wide = x.astype(np.float64)
    for config, shard in ((ann.GraphConfig(), 300), (ann.GraphConfig(metric="euclidean"), 900), (ann.GraphConfig(quantization="sq8"), 900)):
        nodes = ann.build_graph(vectors, config, shard_vectors=shard).cache()
        at = ann.Vectors(wide, config)
        for filters, keep in (({}, np.ones(900, bool)), ({"allowed": some, "tombstones": gone}, (np.arange(900) % 10 < 5) & (np.arange(900) % 3 > 0))):
            found = ann.search_graph(nodes, asked, 10, config, ef=10, checked=True, **filters)
            rows = {(r.qid, r["rank"]): r.id for r in found.collect()}
            for q in range(0, 900, 50):
                far = at.one_by_one(wide[q], np.flatnonzero(keep))
                assert [rows[q, k] for k in range(1, 11)] == np.flatnonzero(keep)[np.argsort(far, kind="stable")[:10]].tolist()


def test_numbers_over_all_shards(spark, waves):
    ids = sorted(r.vec_id for r in waves.select("vec_id").collect())
    nodes = ann.build_graph(waves, shard_vectors=40).cache()
    assert nodes.select("shard").distinct().count() > 1
    rows = {r.id: r for r in ann.numbered(nodes).collect()}
    assert [rows[i].node for i in ids] == list(range(len(ids)))
    own = {(r.shard, r.node): r.id for r in nodes.collect()}
    for r in nodes.collect():
        assert [[ids[n] for n in layer] for layer in rows[r.id].neighbors] == [[own[r.shard, n] for n in layer] for layer in r.neighbors]
