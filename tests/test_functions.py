"""Scalar functions on literals."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skarn.functions import quantize, text, vector
from skarn.functions.embed import embedder, hash_embedding


def unit(values):
    v = np.array(values, dtype=np.float32)
    return (v / np.linalg.norm(v)).tolist()


def one(spark, *columns, **values):
    names = list(values)
    rows = spark.createDataFrame([tuple(list(map(float, values[n])) if isinstance(values[n], list) else values[n] for n in names)], ", ".join(f"{n} array<float>" if isinstance(values[n], list) else f"{n} string" for n in names))
    return rows.select(*columns).first()


def test_vector_literals(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, vector.dot(a, b), a=[1.0, 2, 3, 4, 5, 6, 7], b=[7.0, 6, 5, 4, 3, 2, 1])[0] == 84
    assert one(spark, vector.dot(a, b), a=[1.5, 2, 3.5, 4, 5], b=[2.0, 1, 2, 0.5, 1])[0] == 19
    assert one(spark, vector.normalize(a), a=[3.0, 4])[0] == [0.6, 0.8]
    assert one(spark, vector.normalize(a), a=[0.0, 0])[0] == [0, 0]
    assert one(spark, vector.euclidean(a, b), a=[0.0, 0, 0], b=[3.0, 4, 0])[0] == 5
    assert one(spark, vector.cosine_similarity(a, b), vector.vector_distance(a, a), a=[1.0, 0, 0], b=[0.0, 1, 0]) == (0, 0)
    assert one(spark, vector.cosine_similarity(a, b), a=[0.0, 0], b=[0.0, 1])[0] == 0
    assert one(spark, vector.vector_distance(a, b, "dot"), vector.vector_distance(a, b, "euclidean"), a=[1.0, 2], b=[1.0, 2]) == (-5, 0)
    with pytest.raises(ValueError):
        vector.vector_distance(a, b, "manhattan")


def test_scores(spark):
    row = spark.range(1).select(vector.score(F.lit(0.25)), vector.score(F.lit(-3.0), "dot"), vector.score(F.lit(1.0), "euclidean"), vector.score(F.lit(0.4), "euclidean", "bq")).first()
    assert tuple(round(x, 6) for x in row) == (0.75, 1.0, 0.5, 0.6)


def test_sq8_and_bq_fidelity(spark):
    a, b = unit([math.sin(3 * i + 1) for i in range(384)]), unit([math.cos(5 * i + 2) for i in range(384)])
    qa, qb = quantize.sq8(F.col("a")), quantize.sq8(F.col("b"))
    r = one(spark, qa["data"], vector.cosine_similarity(F.col("a"), quantize.sq8_decode(qa)), F.abs(quantize.sq8_dot(qa, qb) - vector.dot(F.col("a"), F.col("b"))), a=a, b=b)
    assert len(r[0]) == 384 and r[1] > 0.99 and r[2] < 0.05
    x, y, z = (unit([s * math.sin(1.5 * i + d) for i in range(384)]) for s, d in ((1, 0), (1, 0.1), (-1, 0)))
    x_, y_, z_ = (quantize.bq(F.col(n)) for n in "xyz")
    r = one(spark, F.size(x_["bits"]), quantize.hamming(x_, y_), quantize.hamming(x_, z_), quantize.bq_cosine(x_, y_), quantize.bq_cosine(x_, z_), x=x, y=y, z=z)
    assert r[0] == 12 and r[1] < r[2] and r[3] > 0.7 and r[4] < 0


def test_halves_round_up(spark):
    assert one(spark, quantize.sq8(F.col("a"))["data"], a=[127.0, 2.5, -2.5, 0.0])[0] == [127, 3, -2, 0]
    assert one(spark, quantize.sq8(F.col("a"))["scale"], a=[0.0, 0.0])[0] == 1


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-4, 4, width=32), min_size=1, max_size=70))
def test_quantized_forms_of_any_vector(spark, values):
    q, b = quantize.sq8(F.col("a")), quantize.bq(F.col("a"))
    r = one(spark, q, quantize.sq8_decode(q), b, quantize.bq_decode(b), a=[float(v) for v in values])
    assert all(abs(x - y) <= r[0].scale / 2 + 1e-9 for x, y in zip(values, r[1]))
    assert [x > 0 for x in values] == [x > 0 for x in r[3]] == [bool(r[2].bits[i // 32] >> (i % 32) & 1) for i in range(len(values))]


def test_text(spark):
    row = spark.createDataFrame([("Don't use PgBouncer's pool-size für 2 THE x",)], "t string").select(text.tokens(F.col("t")), text.query_terms(F.col("t"))).first()
    assert row[0] == ["don", "use", "pgbouncer", "pool-size"]
    assert row[1] == ["don", "use", "pgbouncer", "pool", "size", "the"]
    row = spark.createDataFrame([("# A heading that is long enough. First sentence is here!\nShort. Second sentence follows this one?",)], "t string")
    assert row.select(text.sentences(F.col("t"))).first()[0] == ["First sentence is here!", "Second sentence follows this one?"]
    names = spark.createDataFrame([("https://a.b/c/d.txt?x=1",), ("https://a.b/",), ("https://a.b",), (None,)], "u string")
    assert [r[0] for r in names.select(text.url_filename(F.col("u"))).collect()] == ["d.txt", "remote_document.txt", "remote_document.txt", "remote_document.txt"]
    marks = spark.createDataFrame([("A cat+ and CAT+s",)], "t string").select(text.highlight(F.col("t"), "cat+ an")).first()[0]
    assert marks == "A <mark>cat+</mark> and <mark>CAT+</mark>s"
    kinds = spark.createDataFrame([("a.PY",), ("b.pdf",), ("c.md",)], "n string").select(text.document_kind(F.col("n"))).collect()
    assert [k[0] for k in kinds] == ["code", "pdf", "text"]
    assert spark.range(1).select(text.percent(F.lit(0.125)), text.token_estimate(F.lit("abcdef")), text.token_estimate(F.lit(""))).first() == (13, 2, 1)


def test_hash_embedding(spark):
    v = hash_embedding("Hello hello, world", 64)
    assert abs(np.linalg.norm(v) - 1) < 1e-9 and np.count_nonzero(v) <= 8
    assert not hash_embedding("… !", 16).any() and not hash_embedding(None, 16).any()
    got = spark.createDataFrame([("Hello hello, world",), (None,)], "t string").select(embedder(dim=64)(F.col("t"))).collect()
    assert np.allclose(got[0][0], v) and not any(got[1][0])


def test_what_rounds_to_zero_keeps_its_sign(spark, tmp_path):
    """DuckDB's round gives -0.0 for a small negative number: the queries on vectors have to give it too."""
    duckdb = pytest.importorskip("duckdb")
    from skarn import queries

    values = [[3e-7, -1e-7, 0.5, -0.5], [-4e-7, 0.0, -0.8, 0.6]]
    spark.createDataFrame([(k, v, k) for k, v in enumerate(values)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    for name in ("vec_normalize", "snapshot_json_roundtrip", "snapshot_binary_roundtrip"):
        found = {r[0]: list(map(str, r[1])) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
        assert found == {r[0]: list(map(str, r[1])) for r in duckdb.sql(queries.ORACLE_SQL[name]).fetchall()}, name
        assert "-0.0" in found[0] and "0.0" in found[1], name
