"""Chunks, answers, projections, snapshots, the store, streams and the facade."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.operators import ann, chunk, project, rag
from skarn.plans.collection import Collection
from skarn.sources import files, snapshot
from skarn.sources.store import Store
from skarn.streaming import ingest

MARKDOWN = "# Title\nIntro text about indexes.\n\n## Storage\n" + "Rows live in pages. " * 12 + "\n\n## Queries\n" + "A plan is a tree of operators. " * 9


def test_text_chunks(spark):
    chunks = chunk.text_chunks(MARKDOWN, 180, 40)
    assert len(chunks) > 1 and chunks[0].startswith("# Title") and all("\n\n" not in c for c in chunks)
    assert any(c.startswith("## Storage") or "\n## Storage" in c for c in chunks)
    assert chunk.text_chunks("", 10) == [] and chunk.text_chunks(" \n ", 10) == []
    assert chunk.text_chunks("x" * 900, 600, 120) == ["x" * 900]
    rows = chunk.chunk_text(spark.createDataFrame([("a.md", MARKDOWN), ("b.md", None), ("c.md", "")], "name string, text string"), "name", size=180, overlap=40).collect()
    assert len(rows) == len(chunks) and rows[0].id == "a.md-chunk-1" and rows[0].total_chunks == len(chunks)
    assert rows[0].start_char == 0 and rows[0].end_char == len(chunks[0]) and all(r.token_count_estimate > 0 for r in rows)


def test_overlap_is_the_end_of_the_chunk_before():
    parts = chunk.text_chunks(" ".join(f"Sentence number {i} is here." for i in range(40)), 200, 50)
    for a, b in zip(parts, parts[1:]):
        assert b.startswith(a[-50:].strip())


def test_code_chunks(spark):
    code = "interface A {\n  x: number;\n}\n" + "\n".join(f"// {i}" for i in range(16)) + "\nexport class B {\n}\nasync function c() {\n}\n" + "\n".join(f"let v{i} = {i};" for i in range(30))
    got = chunk.code_chunks(code, "a.ts", 20, 4)
    assert len(got) > 1 and "interface A" in got[0] and any("class B" in c for c in got) and any("function c" in c for c in got)
    rows = chunk.chunk_any(spark.createDataFrame([("a.ts", code), ("b.txt", "plain text")], "name string, text string"))
    assert {r.id.rsplit("-", 1)[0] for r in rows.collect()} == {"a.ts-code", "b.txt-chunk"}
    assert chunk.code_chunks("", "x.py") == []


def contexts(spark, texts):
    return spark.createDataFrame([(0, k, f"c{k}", f"d{k}.md", k, t) for k, t in enumerate(texts, 1)], "qid int, ord int, id string, document_name string, chunk_index int, text string")


def test_answers(spark):
    rows = contexts(spark, ["Caching makes queries fast indeed. Nothing else of note here today.", "Queries use caching and an index as well. Caching makes queries fast indeed."])
    r = rag.answer(rows, "How does caching help queries?").first()
    assert r.summary == "Caching makes queries fast indeed. [1]" and r.bullet_points == ["Queries use caching and an index as well. [2]"]
    assert [c.chunk_id for c in r.citations] == ["c1", "c2"] and abs(r.confidence - 0.8) < 1e-9
    r = rag.answer(rows, "zzz").first()
    assert r.summary == "Caching makes queries fast indeed. [1]" and r.confidence == 0.5 and len(r.citations) == 1
    r = rag.answer(rows, "zzz", rag.WORKER).first()
    assert r.summary.endswith("... [1]") and r.confidence == 0.55
    assert rag.answer(rows.limit(0), "x").count() == 0
    shown = rag.answer_text(rag.answer(rows, "caching")).first().text
    assert "\n\n• " in shown and shown.endswith("[2] d2.md (Chunk #2)")


def test_model_answers(spark):
    row = spark.createDataFrame([("  First.  \n\nsecond\nthird\nfourth\nfifth", " Only this long sentence. And another long sentence! ok. ", "")], "a string, b string, c string")
    r = row.select(rag.chat_answer(F.col("a")).alias("a"), rag.small_answer(F.col("b")).alias("b"), rag.small_answer(F.col("c")).alias("c"), rag.chat_answer(F.col("c")).alias("d")).first()
    assert r.a.summary == "First." and r.a.bullet_points == ["second", "third", "fourth"]
    assert r.b.summary == "Only this long sentence." and r.b.bullet_points == ["And another long sentence!"]
    assert r.c.summary == "Could not synthesize answer from context." and r.d.bullet_points == []


def test_history(spark):
    turns = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"m{t} " + "x" * 200) for t in range(8)], "conv_id long, turn long, role string, text string")
    assert sorted(r.turn for r in rag.last_turns(turns).collect()) == [2, 3, 4, 5, 6, 7]
    assert sorted(r.turn for r in rag.prior_turns(turns).collect()) == [0, 1, 2, 3, 4, 5]
    lines = rag.chat_history(turns).first().history.split("\n")
    assert len(lines) == 6 and lines[0].startswith("User: m2") and lines[1].startswith("Assistant: m3")
    small = rag.small_history(turns).first().history
    assert small.startswith("Q: m4") and len(small) == 2 * (3 + 80) + 2 * (3 + 120) + 3
    assert rag.exchanges(turns).first().exchanges == 4
    prompt = rag.chat_prompt(contexts(spark, ["t" * 600]), "why?", "User: hi").first().prompt
    assert "Previous conversation:\nUser: hi\n\nContext:\n[Source 1] (d1.md):\n" + "t" * 500 + "\n\nUser Question: why?" in prompt
    assert rag.small_prompt(contexts(spark, ["t" * 600]), "why?").first().prompt.startswith("Context: [1] " + "t" * 350 + " Question: why?")


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 6)) * [5, 3, 1, 0.2, 0.1, 0.1]
    rows = spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    model = project.fit_pca(rows)
    _, _, vt = np.linalg.svd(x.astype(np.float32) - x.astype(np.float32).mean(0))
    assert abs(np.dot(model.components[0], vt[0])) > 0.999 and abs(np.dot(model.components[1], vt[1])) > 0.99
    two, three = project.project_2d(rows, model).toPandas(), project.project_3d(rows, model).toPandas()
    assert two.x.min() == 0 and two.x.max() == 1 and three.z.min() == -1 and three.z.max() == 1
    with pytest.raises(ValueError):
        project.fit_pca(rows.limit(0))
    same = spark.createDataFrame([(1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert project.project_2d(same, project.fit_pca(same)).first().x == 0.5


def test_tsne(spark):
    assert project.tsne(np.zeros((0, 3))).shape == (0, 2)
    assert project.tsne(np.eye(1)).tolist() == [[0.5, 0.5]]
    y = project.tsne(np.eye(2))
    assert ((y >= 0) & (y <= 1)).all()
    x = np.array([[1, 0, 0, 0], [0.99, 0.1, 0, 0], [0.98, 0.15, 0, 0], [0, 0, 1, 0], [0, 0, 0.99, 0.1], [0, 0, 0.98, 0.15]])
    y = project.tsne(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert ((y >= 0.04) & (y <= 0.96)).all()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert project.tsne_points(rows).count() == 6
    # blocks of rows give what the whole matrix gives
    wide = np.random.default_rng(2).normal(size=(70, 8))
    wide /= np.linalg.norm(wide, axis=1, keepdims=True)
    assert np.allclose(project.tsne(wide, iterations=12, block=9), project.tsne(wide, iterations=12), atol=1e-9)


def test_selection(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 10.0), (3, 11.0, 10.0)], "id long, x double, y double")
    assert [r.id for r in project.box_select(points, (10, 0), (0, 10)).orderBy("id").collect()] == [1, 2]
    assert [r.id for r in project.box_select(points, (11, 12), (9, 10)).collect()] == [3]
    assert project.nearest_point(points, 100, 100).count() == 0
    results = spark.createDataFrame([(1, 0.0), (2, 0.99)], "id long, score double")
    place = project.weighted_place(results, points).first()
    assert abs(place.x - 9.9) < 1e-9


def made_snapshot(n, dim, **more):
    nodes = [(f"v{i}", 0, np.sin(17 * i + np.arange(dim)).astype(np.float32).tolist(), [[(i + 1) % n]]) for i in range(n)]
    chunks = [{"id": f"v{i}", "documentName": "d", "chunkIndex": i, "totalChunks": n, "text": f"té {i}", "startChar": 0, "endChar": 4, "tokenCountEstimate": 1} for i in range(n)]
    return snapshot.Snapshot(nodes, chunks, entry=0 if n else None, max_level=0 if n else -1, **more)


def test_snapshots(spark):
    for s in (made_snapshot(0, 0), made_snapshot(25, 64, metric="euclidean", quantization="sq8"), made_snapshot(50, 384, metric="dot", quantization="bq")):
        again = snapshot.from_binary(snapshot.to_binary(s))
        assert (again.nodes, again.chunks, again.metric, again.quantization, again.entry, again.max_level) == (s.nodes, s.chunks, s.metric, s.quantization, s.entry, s.max_level)
        assert snapshot.from_json(snapshot.to_json(s)).nodes == s.nodes
    assert len(snapshot.to_json(s).encode()) / len(snapshot.to_binary(s)) > 2.5
    with pytest.raises(ValueError, match="bad magic number"):
        snapshot.from_binary(bytes(64))
    bad = bytearray(snapshot.to_binary(made_snapshot(0, 0)))
    bad[4:8] = (999).to_bytes(4, "little")
    with pytest.raises(ValueError, match="Unsupported snapshot version: 999"):
        snapshot.from_binary(bytes(bad))
    with pytest.raises(ValueError):
        snapshot.from_json(json.dumps({"type": "other"}))
    live = made_snapshot(5, 8).live({"v0", "v3"})
    assert [n[0] for n in live.nodes] == ["v1", "v2", "v4"] and live.entry == 0 and live.nodes[1][3] == [[]]


def test_snapshot_tables(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    nodes, chunks = ann.build_graph(rows), spark.createDataFrame([("a", "x")], "id string, text string")
    snapshot.save_tables(str(tmp_path / "s"), nodes, chunks, metric="cosine")
    got, texts, header = snapshot.load_tables(spark, str(tmp_path / "s"))
    assert got.count() == 5 and texts.count() == 1 and header == {"metric": "cosine"}
    with pytest.raises(ValueError):
        snapshot.save_tables(str(tmp_path / "t"), nodes.limit(0), chunks)


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    assert store.read("vectors").count() == 0 and not store.is_ready()
    store.put("vectors", spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, vector array<float>"))
    store.put("vectors", spark.createDataFrame([("b", [3.0])], "id string, vector array<float>"))
    assert {r.id: r.vector for r in store.read("vectors").collect()} == {"a": [1.0], "b": [3.0]}
    assert store.get("vectors", "b").count() == 1
    store.delete("vectors", spark.createDataFrame([("a",)], "x string"))
    assert store.read("vectors").count() == 1
    store.vacuum()
    assert store.read("vectors").count() == 1
    store.set_preference("k", {"size": 3})
    assert store.preference("k") == {"size": 3} and store.preference("none", 7) == 7
    for q in ("one", "two", " one ", ""):
        store.remember(q, "hybrid")
    assert sorted(r.query for r in store.read("history").collect()) == ["one", "two"]
    store.clear()
    assert store.read("vectors").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("hello\nworld")
    (tmp_path / "b.bin").write_text("no")
    assert [(r.name, r.text) for r in files.text_files(spark, str(tmp_path)).collect()] == [("a.md", "hello\nworld")]
    pages = spark.createDataFrame([("f", 2, ["c"]), ("f", 1, ["a", "b"])], "name string, page_no int, items array<string>")
    r = files.pdf_text(pages).first()
    assert r.text == "--- Page 1 ---\n\na b\n\n--- Page 2 ---\n\nc" and r.page_count == 2


def test_collection_end_to_end(spark, tmp_path):
    box = Collection(spark, str(tmp_path / "c"), dim=64, size=120, overlap=20)
    docs = spark.createDataFrame([("a.md", "PgBouncer pools connections for Postgres. It keeps them open and ready."), ("b.md", "Kafka moves events between services. Topics hold the events in order."), ("e.md", "")], "name string, text string")
    box.add(docs)
    assert [r.document_name for r in box.names().collect()] == ["a.md", "b.md"]
    for mode in ("dense", "sparse", "hybrid"):
        assert box.search("PgBouncer connections", mode).first().document_name == "a.md"
    assert {r.document_name for r in box.search("events", "hybrid", document="b.md").collect()} == {"b.md"}
    assert "PgBouncer" in box.answer("What does PgBouncer do?").first().summary
    box.add(spark.createDataFrame([("b.md", "Only graphs now.")], "name string, text string"))
    assert box.search("Kafka", "sparse").count() == 0 and box.store.read("documents").count() == 2
    assert box.find_similar("a.md-chunk-1").count() == 1
    assert box.stats().first().n == 2
    box.delete("a.md")
    assert box.chunks.count() == 1 and box.vectors.count() == 1
    with pytest.raises(ValueError):
        box.search("x", "other")


def test_collection_scope_snapshot_and_rehydration(spark, tmp_path):
    box = Collection(spark, str(tmp_path / "c"), dim=16, size=120, overlap=20)
    assert box.rehydrate() is None
    box.add(spark.createDataFrame([("a", "Topics hold events."), ("a-chunk-x", "Events hold topics.")], "name string, text string"))
    # a document's name that begins another one's chunk ids is not in its scope
    assert {r.document_name for r in box.search("events", "sparse", document="a").collect()} == {"a"}
    assert len(box.vector("a-chunk-1")) == 16 and box.vector("b-chunk-1") is None
    assert box.vector("a-chunk-1", spark.createDataFrame([("a-chunk-1",)], "id string")) is None
    saved = box.index()
    assert saved.terms is not None and saved.postings.where("term = 'events'").count() == 2
    graph, index = box.rehydrate()
    assert graph.count() == 2 and index.search("topics").count() == 2
    assert tuple(box.sizes(graph.select("id").limit(0)).first()) == (2, 2)
    names = box.graph_ids().withColumnRenamed("id", "chunk")
    ids = names.join(graph, names.node_id == graph.id)
    nodes = ids.select("shard", "node", F.col("chunk").alias("id"), "level", "vector", "neighbors")
    chunks = box.chunks.join(nodes.select("id", "shard"), "id")
    kept = snapshot.snapshot_rows(nodes, chunks).cache()
    kept.count()
    other = Collection(spark, str(tmp_path / "d"), dim=16)
    other.add(spark.createDataFrame([("gone", "This goes.")], "name string, text string"))
    other.import_snapshot(kept)
    assert {r.document_name for r in other.names().collect()} == {"a", "a-chunk-x"} and other.store.read("documents").count() == 2
    assert other.search("events", "hybrid").count() == 2 and other.search("goes", "sparse").count() == 0
    head = snapshot.read_headers(kept).first()
    assert (head.m, head.m0, head.metric, head.nodes, head.chunks, head.max_level) == (16, 32, "cosine", 2, 2, graph.agg(F.max("level")).first()[0])
    other.clear()
    assert other.rehydrate() is None


def test_canvas_and_export_of_little(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "vec_id long, embedding array<float>")
    chunks = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "id long, document_name string")
    model, plane, space = project.canvas(vectors, chunks)
    assert {r.id: r.document_name for r in plane.collect()} == {1: "a", 2: "unknown", 3: "unknown"} and space.columns[:4] == ["id", "x", "y", "z"]
    assert project.query_place(vectors.where("vec_id = 1"), model).first() == plane.where("id = 1").select("x", "y").first()
    none, plane, space = project.canvas(vectors.limit(1), chunks)
    assert none is None and plane.count() == space.count() == 0 and project.query_place(vectors, None).count() == 0
    assert project.canvas(vectors, chunks, "tsne")[1].count() == 3
    with pytest.raises(ValueError):
        project.canvas(vectors, chunks, "other")
    with pytest.raises(ValueError):
        snapshot.export(ann.build_graph(vectors.limit(0)))
    assert snapshot.export(ann.build_graph(vectors)).count() == 1


def test_samples_and_progress(spark):
    rows = files.samples(spark).collect()
    assert len(rows) == 3 and all(r.text.startswith("#") and r.size_bytes == len(r.text.encode()) for r in rows)
    some = spark.createDataFrame([("x",)] * 12 + [("y",)] * 3 + [("z",)] * 5, "batch string")
    got = sorted(tuple(r) for r in ingest.progress_events(some).collect())
    assert got == [("x", 5, 12, 42), ("x", 10, 12, 83), ("x", 12, 12, 100), ("y", 3, 3, 100), ("z", 5, 5, 100)]


def test_model_embeddings_fall_back(spark):
    from skarn.functions import embed

    def model(text):
        raise RuntimeError("no model")

    rows = spark.createDataFrame([("some text",)], "t string")
    assert np.allclose(rows.select(embed.embedder(model, 8)(F.col("t"))).first()[0], embed.hash_embedding("some text", 8))
    with pytest.raises(Exception):
        rows.select(embed.embedder(model, 8, fallback=False)(F.col("t"))).collect()


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    spark.createDataFrame([("s.md", "Streams arrive as files.")], "name string, text string").write.parquet(str(source / "one"))
    box = Collection(spark, str(tmp_path / "c"), dim=16)
    stream = spark.readStream.schema("name string, text string").parquet(str(source / "*"))
    ingest.ingest(stream, box.add, str(tmp_path / "ck")).awaitTermination()
    assert box.names().first().document_name == "s.md"
    parts = spark.createDataFrame([(1, 0, '{"response":"He'), (1, 1, 'llo"}\n{bad}\n{"response":" you"}')], "stream int, seq int, part string")
    lines = ingest.lines_of(parts)
    got = ingest.token_stream(lines).first()
    assert got.text == "Hello you" and got.tokens == 2


def test_camera(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    r = project.camera(points, math.pi / 3, 0.2).first()
    assert (r.sx, r.sy, r.depth, r.scale) == (400, 300, 2.5, 120)


def test_tsne_query_projects_every_vector(spark, tmp_path):
    from skarn import queries

    rows = [(i, i % 10, [float(i % 7), float(i % 3), 1.0]) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {r.id for r in queries.tsne_points(spark, str(tmp_path)).collect()} == set(range(40))


def test_tsne_against_points_moved_one_by_one():
    """Blocks, and affinities that are held or made again, give what moving each point after the one before gives."""
    x = np.random.default_rng(3).normal(size=(150, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n, iterations, rate = len(x), 25, 100
    p = np.exp(-np.maximum(0, 2 * (1 - np.clip(x @ x.T, -1, 1))) / 3)
    np.fill_diagonal(p, 0)
    p /= p.sum(axis=1, keepdims=True)
    p = (p + p.T) / (2 * n)
    at = np.arange(n)
    y = 0.1 * np.fmod(np.stack([np.sin(at * 12.9898), np.cos(at * 78.233)], 1) * 43758.5453, 1)
    old, gain = y.copy(), np.ones((n, 2))
    for step in range(iterations):
        near = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(axis=2))
        np.fill_diagonal(near, 0)
        weight = 4 * (p - near / near.sum()) * near
        for i in range(n):
            gradient, moved = weight[i].sum() * y[i] - weight[i] @ y, y[i] - old[i]
            gain[i] = np.where(np.sign(gradient) != np.sign(moved), gain[i] + 0.2, np.maximum(0.01, gain[i] * 0.8))
            old[i], y[i] = y[i], y[i] + (0.5 if step < 20 else 0.8) * moved - rate * gain[i] * gradient
    expected = 0.05 + 0.9 * (y - y.min(0)) / (y.max(0) - y.min(0))
    for params in ({}, {"held_cells": 0}, {"block": 40}):
        assert np.allclose(project.tsne(x, iterations=iterations, **params), expected, atol=1e-9)
