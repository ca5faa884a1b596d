import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.operators import density, keywords, projection, report, synth, vectors
from voxmill.operators.components import connected_components
from voxmill.plans import pipeline, queries
from voxmill.plans.tools import TopicTools
from voxmill.config import GeneratorConfig, PipelineConfig, check_range, find_settings, secret, service


def blobs(seed=0):
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(c, 0.3, (60, 2)) for c in ((0, 0), (5, 0), (0, 5))])


def test_three_blobs_and_shuffle():
    x = blobs()
    lab = density.cluster(x, 10)
    assert [len(set(lab[i : i + 60])) for i in (0, 60, 120)] == [1, 1, 1] and len(set(lab)) == 3
    p = np.random.default_rng(1).permutation(len(x))
    other = density.cluster(x[p], 10)
    assert ((lab[p][:, None] == lab[p][None, :]) == (other[:, None] == other[None, :])).all()


def test_isolated_points_are_noise():
    x = np.concatenate([blobs(), [[50, 50], [-50, 0], [0, -60], [90, 0], [30, -80]]])
    assert (density.cluster(x, 10)[180:] == -1).all()


@pytest.mark.parametrize("x", [np.empty((0, 2)), np.zeros((1, 2)), np.zeros((20, 2)), np.arange(10.0).reshape(5, 2)])
def test_small_and_equal_points(x):
    lab = density.cluster(x, 10)
    assert len(lab) == len(x)


def test_hdbscan_sample_and_rest(spark):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(blobs())] + [(999, None)], "id int, v array<double>")
    full = {r.id: r.cluster for r in density.hdbscan(df, "id", "v").collect()}
    part = {r.id: r.cluster for r in density.hdbscan(df, "id", "v", fit_rows=90).collect()}
    assert len(full) == len(part) == 180
    for a in (0, 60, 120):
        assert len({full[i] for i in range(a, a + 60)}) == 1
        assert len({part[i] for i in range(a, a + 60)} - {-1}) == 1


def test_hdbscan_keeps_small_topics_beside_many_rows(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(c, 0.3, (n, 2)) for c, n in (((0, 0), 700), ((9, 0), 700), ((0, 9), 15))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    full = {q.id: q.cluster for q in density.hdbscan(df, "id", "v").collect()}
    boxes = {q.id: q.cluster for q in density.hdbscan(df, "id", "v", fit_rows=100).collect()}
    small = {boxes[i] for i in range(1400, 1415)} - {-1}
    assert boxes == full and len(small) == 1 and not small & {boxes[i] for i in range(1400)}


@pytest.mark.parametrize("x", [np.random.default_rng(1).normal(size=(900, 5)), np.round(np.random.default_rng(2).normal(size=(700, 3)), 1), np.repeat(np.arange(40.0).reshape(20, 2), 30, 0)])
def test_boxed_tree_is_a_minimum_spanning_tree(x):
    e = density.boxed_tree(x)
    assert len(e) == len(x) - 1 and np.allclose(np.sort(e[:, 2]), np.sort(density.spanning_tree(x)[:, 2]))


def test_graph_and_metrics():
    x = np.random.default_rng(0).normal(size=(80, 16))
    i, j, w = projection.fuzzy_graph(x, 10)
    assert (i < j).all() and (w > 0).all() and (w <= 1).all()
    assert projection.metrics(np.empty((0, 2)), 5)["bbox_area"] == 0
    assert projection.clamp_neighbors(15, 5) == 4 and projection.clamp_neighbors(1, 50) == 2


def test_sweep_and_choice(spark):
    x = np.random.default_rng(0).normal(size=(40, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<double>")
    e = projection.sweep(df, "id", "embedding", 5, 3)
    assert sorted(r.n_neighbors for r in e.collect()) == [3, 4, 5]
    assert projection.choose(e) in (3, 4, 5) and projection.choose(e, override=9) == 9


def test_neighbours_are_exact():
    u = projection.unit(np.concatenate([np.random.default_rng(0).normal(size=(1500, 16)), np.ones((40, 16))]))
    got, dist = projection.nearest(u, u.astype("float32"), 700, 1540, 12)
    d = np.maximum(1 - u[700:] @ u.T, 0)
    d[np.arange(840), np.arange(700, 1540)] = np.inf
    assert np.allclose(np.sort(d, axis=1)[:, :12], dist) and np.allclose(np.take_along_axis(d, got, 1), dist)


def test_cells_find_the_exact_neighbours_of_fewer_pairs(monkeypatch):
    r = np.random.default_rng(4)
    x = np.concatenate([*(r.normal(size=64) / 8 + r.normal(0, 0.05, (1_000, 64)) for _ in range(9)), r.normal(0, 0.2, (500, 64)), np.zeros((30, 64)), np.ones((60, 64))])
    x = x[r.permutation(len(x))]
    pairs, meet = [], projection.Found.meet
    monkeypatch.setattr(projection.Found, "meet", lambda f, rows: (pairs.append(len(f.who) * len(rows)), meet(f, rows)))
    near, dist = projection.all_nearest(x, 15)
    u = projection.unit(x)
    for a in range(0, len(x), 1_000):
        d = np.maximum(1 - u[a : a + 1_000] @ u.T, 0)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        assert np.allclose(np.sort(d, axis=1)[:, :15], dist[a : a + 1_000]) and np.allclose(np.take_along_axis(d, near[a : a + 1_000], 1), dist[a : a + 1_000])
    assert (near[~x.any(1)] < 16).all() and sum(pairs) < 0.6 * len(x) ** 2
    some = projection.all_nearest(x[:50], 60)[0]
    assert some.shape == (50, 49) and all(set(row) == set(range(50)) - {i} for i, row in enumerate(some))


def test_boxes_compare_few_pairs(monkeypatch):
    x, pairs = np.random.default_rng(6).normal(size=(6_000, 5)), []
    real = np.zeros
    monkeypatch.setattr(density.np, "zeros", lambda shape, *a, **k: (pairs.append(np.prod(shape) if np.ndim(shape) and shape[-1] > 512 else 0), real(shape, *a, **k))[1])
    e = density.boxed_tree(x)
    monkeypatch.undo()
    assert sum(pairs) < 20e6 and np.allclose(np.sort(e[:, 2]), density.spanning_tree(x)[:, 2])


def test_layout_on_threads():
    x = np.random.default_rng(1).normal(size=(900, 8))
    assert (projection.layout(x, 10, 5, epochs=20) == projection.layout(x, 10, 5, epochs=20, threads=4)).all()


def test_vectors_of_single_precision_stay_so(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(1).normal(size=(60, 4)).astype("float32"))]
    got = [projection._rows(spark.createDataFrame(rows, f"id int, embedding array<{kind}>"), "id", "embedding")[1] for kind in ("float", "double")]
    assert [v.dtype.name for v in got] == ["float32", "float64"] and (got[0] == got[1]).all()
    assert (projection.layout(got[0], 8, 2, epochs=20) == projection.layout(got[1], 8, 2, epochs=20)).all()


def test_sweep_and_projection_take_every_row(spark, data):
    x = np.random.default_rng(1).normal(size=(5_300, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9_999, None)], "id int, embedding array<double>")
    m = projection.sweep(df, "id", "embedding", 3, 3).first()
    whole = projection.layout(x, 3, 2)
    want = projection.metrics(whole, 3)
    assert (m.n_clusters, m.n_noise_points) == (want["n_clusters"], want["n_noise_points"]) and np.isclose(m.spread_x, want["spread_x"])
    got = {r.id: r.point for r in projection.project(df, "id", "embedding", 3, 2).collect()}
    assert len(got) == 5_300 and np.allclose([got[i] for i in range(5_300)], whole)
    swept = queries.QUERIES["umap_sweep"](spark, data).select("n_neighbors").collect()
    assert sorted(r.n_neighbors for r in swept) == list(range(15, 26))


def test_knn_against_brute_force(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 8))
    x[5] = x[6]
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(x)] + [(100, None, ""), (101, [0.0] * 8, ""), (102, [1.0] * 3, "")]
    df = spark.createDataFrame(rows, "id int, v array<double>, neighbour string")
    got = {}
    for q in vectors.knn(df, 4, "id", "v").collect():
        got.setdefault(q.id, {})[q.rank] = q.neighbour
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for i in range(60):
        s = np.round(u @ u[i], 12)
        s[i] = -9
        assert [got[i][k] for k in (1, 2, 3, 4)] == np.lexsort((np.arange(60), -s))[:4].tolist()
    assert vectors.knn(df.limit(0), 3, "id", "v").count() == 0


def test_scaling(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],), (None,)], "embedding array<double>")
    get = lambda m: [r.embedding for r in vectors.scaled(df, m).collect()]
    assert get("standard") == [[-1.0, 0.0], [1.0, 0.0], None]
    assert get("minmax") == [[0.0, 0.0], [1.0, 0.0], None]
    zero = spark.createDataFrame([([0.0, 0.0],)], "embedding array<double>")
    assert vectors.scaled(zero, "l2").first()["embedding"] == [0.0, 0.0]
    with pytest.raises(ValueError):
        vectors.scaled(df, "other")


def test_vector_checks(spark):
    good = spark.createDataFrame([([1.0, 2.0],)], "embedding array<double>")
    assert vectors.checked(good).count() == 1 and vectors.checked(good.limit(0)).count() == 0
    with pytest.raises(Exception, match="several lengths"):
        vectors.checked(good.union(spark.createDataFrame([([1.0],)], "embedding array<double>"))).collect()


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 1), (3, 1), (9, 8), (8, 10)], "a int, b int")
    assert {r.node: r.component for r in connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8, 9: 8, 10: 8}
    assert connected_components(e.limit(0)).count() == 0
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "a int, b int")
    assert {r.component for r in connected_components(path).collect()} == {0}


def test_keywords(spark):
    docs = spark.createDataFrame([(1, 0, "refund delay at the branch"), (2, 0, "refund delay again"), (3, 1, None), (4, 1, "  "), (5, 2, "card card blocked")], "id int, cluster int, document string")
    k = keywords.extract(docs, 5).toPandas()
    assert set(k.cluster) == {0, 2} and (k.groupby("cluster").size() <= 5).all()
    assert np.allclose(k.groupby("cluster").weight.sum(), 1)
    b = {r.cluster: r.blob for r in keywords.blobs(docs, 20).collect()}
    assert b[0] == "refund delay at the " and set(b) == {0, 2}
    zero = keywords.weighted(spark.createDataFrame([(0, "a", 0.0)], keywords.KEYWORDS)).first()
    assert zero.weight == 0


def test_report(spark):
    kw = keywords.weighted(spark.createDataFrame([(c, f"w`{c} x y z", s) for c in (-1, 0, 1, 10) for s in (0.6625,)], keywords.KEYWORDS))
    summ = spark.createDataFrame([(c, "text", 3) for c in (2, 10, 1, 0, -1)], "cluster int, text_summary string, cluster_count int")
    rows = report.frame(summ, kw).orderBy("position").collect()
    assert [r.cluster for r in rows] == [-1, 0, 1, 10, 2]
    assert rows[-1].keyword_lines == report.NO_KEYWORDS and rows[-1].label == "Cluster 2"
    assert "relevance 0.662, weight 1.000" in rows[0].keyword_lines and "`w'-1" in rows[0].keyword_lines
    assert "| -1 |" in report.markdown(report.frame(summ, kw))
    with pytest.raises(ValueError, match="cosine_similarities, keywords, weight"):
        report.require(summ, "weight", "keywords", "cosine_similarities")


def test_counts_keep_null_cluster(spark):
    df = spark.createDataFrame([(None, "a"), (None, None), (1, "b")], "cluster int, document string")
    assert {r.cluster: r.cluster_count for r in report.counts(df).collect()} == {None: 1, 1: 1}
    assert report.n_clusters(df).first().asDict() == {"n_clusters": 2, "n_topics": 1}


def test_end_to_end(spark, tmp_path):
    r = np.random.default_rng(0)
    words = ("refund delay", "card blocked", "app crash")
    centres = r.normal(size=(3, 16))
    rows = [(f"{k}-{i}", f"{words[k]} number {i}", (centres[k] + r.normal(0, 0.05, 16)).tolist()) for k in range(3) for i in range(30)]
    pts = spark.createDataFrame(rows, "id string, document string, embedding array<double>")
    res = pipeline.topics(pts, PipelineConfig(n_neighbors_low=8, n_neighbors_high=9))
    got = {x.id: x.cluster for x in res.labelled.collect()}
    assert [len({got[f"{k}-{i}"] for i in range(30)}) for k in range(3)] == [1, 1, 1] and res.n_documents == 90
    pipeline.write_topics(res, str(tmp_path))
    assert (tmp_path / "report.md").read_text().count("###") >= 3


def test_tools_and_planes(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"{k}-{i}", f"Card fee refund number {i} of group {k}.", (np.eye(8)[k] + rng.normal(0, 0.05, 8)).tolist()) for k in range(3) for i in range(25)]
    t = TopicTools(spark.createDataFrame(rows, "id string, document string, embedding array<double>"), str(tmp_path))
    got = t.evaluate({"low": 5, "high": 6})
    assert [r["n_neighbors"] for r in got["candidates"]] == [5, 6] and got["suggested"] in (5, 6)
    a, b = t.visualise({"n_neighbors": 5}), t.visualise({"n_neighbors": 5})
    assert a == b and list(t.explorer.made) == [5] and spark.read.parquet(a["folder"]).columns == ["id", "x", "y", "cluster"]
    assert spark.read.parquet(a["folder"]).count() == 75 and a["spread_x"] > 0 and a["largest_cluster"] <= 75
    done = t.finalise({"n_neighbors": 5})
    assert done["n_documents"] == 75 and sum(done["clusters"].values()) == 75 and (tmp_path / "report.md").exists()


def test_metrics_of_empty_tables(spark):
    none = spark.createDataFrame([], "cluster int, x double, y double")
    assert projection.cluster_metrics(none).first().asDict() == {"n_clusters": 0, "n_noise_points": 0, "n_tiny_islands": 0, "largest_cluster": 0, "largest_cluster_share": 0.0}
    assert tuple(projection.spread(none).first()) == (0.0, 0.0, 0.0)


def test_knn_blocks_ties_and_lengths(spark):
    rows = [(i, [1.0, 0.0]) for i in range(6)] + [(10, [0.0, 1.0]), (11, [0.0, 0.0]), (12, None), (13, [1.0]), (14, [1.0, 1.0])]
    got = [tuple(r) for r in vectors.knn(spark.createDataFrame(rows, "id int, embedding array<double>"), 2, "id").select("id", "neighbour", "rank").orderBy("id", "rank").collect()]
    assert got[:6] == [(0, 1, 1), (0, 2, 2), (1, 0, 1), (1, 2, 2), (2, 0, 1), (2, 1, 2)] and {r[0] for r in got} == {0, 1, 2, 3, 4, 5, 10, 14}
    assert [r[1] for r in got if r[0] == 10] == [14, 0]
    assert vectors.knn(spark.createDataFrame([], "id int, embedding array<double>"), 2, "id").count() == 0


def test_synthetic(spark):
    f = synth.feedback(spark, n_branches=4, rows_min=3, rows_max=6)
    a, b = f.orderBy("case_id").collect(), f.repartition(3).orderBy("case_id").collect()
    assert a == b and [r.case_id for r in a] == [f"BK-2026-{i + 1:08d}" for i in range(len(a))]
    assert all(120 <= len(r.verbatim) <= 600 for r in a) and all(r.updated_at is None or r.updated_at > r.created_at for r in a)
    s = synth.dialogue_specs(spark, 6)
    n = {r.conversation_id: r.n for r in synth.dialogues(s).groupBy("conversation_id").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert all(r.word_count_min <= n[r.conversation_id] <= r.word_count_max for r in s.collect())
    with pytest.raises(ValueError):
        synth.feedback(spark, rows_min=5, rows_max=2)


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "config.yaml").write_text("gemini:\n  api_key_env: MY_KEY\n")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "config.yaml").write_text(": [broken")
    path, got = find_settings(str(tmp_path / "a"), "gemini")
    monkeypatch.setenv("MY_KEY", "k")
    assert path.parent == tmp_path and secret(None, got, "OTHER") == "k" and secret("x", got, "OTHER") == "x"
    assert service(str(tmp_path / "a"), "gemini", "OTHER_KEY") == ({"api_key_env": "MY_KEY"}, "k") and os.environ.pop("OTHER_KEY") == "k"
    with pytest.raises(ValueError, match="no key"):
        service(str(tmp_path), "none", "OTHER_KEY")
    assert GeneratorConfig.near(str(tmp_path)).chunk_size == 10
    assert GeneratorConfig.of({"timeout_ms": 0, "chunk_size": 0}).timeout_ms is None
    with pytest.raises(ValueError):
        check_range("n", 3, 2)
