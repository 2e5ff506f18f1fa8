"""Figures without SQL oracle, edge cases, and plan shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel import plans, sources, streaming
from vexel.functions import filters as L
from vexel.functions import text as X
from vexel.functions import vectors as V
from vexel.operators import access, indexes, kmeans, knn, learned, quantize, rag, recommend, shared, store
from vexel.operators.running import running_total


@pytest.fixture(scope="module")
def vecs(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label").persist()


@pytest.fixture(scope="module")
def asked(vecs):
    return vecs.where("id < 5").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))


def one(spark, expr, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).select(expr.alias("v")).first()["v"]


def arr(*x):
    return F.array(*(F.lit(float(v)) for v in x)) if x else F.array().cast("array<double>")


def test_distances_at_the_edges(spark):
    a, b = arr(0, 0), arr(3, 4)
    assert one(spark, V.cosine_distance("a", "b"), a=a, b=b) == 1.0
    assert one(spark, V.euclidean("a", "b"), a=a, b=b) == 5.0
    assert one(spark, V.jaccard("a", "b"), a=a, b=a) == 0.0
    assert one(spark, V.euclidean("a", "b"), a=a, b=arr(1)) is None
    assert one(spark, V.density("a"), a=arr()) is None and one(spark, V.magnitude("a"), a=arr()) == 0.0
    assert one(spark, V.normalize("a"), a=a) == [0.0, 0.0]
    assert one(spark, V.angle("a", "b"), a=b, b=b) == 0.0
    assert one(spark, V.wasserstein("a", "b"), a=arr(1, 0, 0), b=arr(0, 0, 1)) == pytest.approx(2.0)


def test_mahalanobis_with_identity_is_euclidean(spark):
    identity = F.lit([[1.0, 0.0], [0.0, 1.0]])
    assert one(spark, V.mahalanobis("a", "b", identity), a=arr(1, 2), b=arr(4, 6)) == pytest.approx(5.0)


def test_transport(spark):
    cost = np.abs(np.arange(3)[:, None] - np.arange(3)[None, :]).astype(float)
    cols = {"a": arr(1, 0, 0), "b": arr(0, 0, 1)}
    assert one(spark, quantize.greedy_transport(cost)("a", "b"), **cols) == pytest.approx(2.0)
    assert one(spark, quantize.sinkhorn(cost)("a", "b"), **cols) == pytest.approx(2.0, abs=1e-3)


def test_missing_keys_are_false_and_their_negation_true(spark):
    df = spark.createDataFrame([(1, '{"k": "a"}', [1.0]), (2, "{}", [1.0]), (3, "broken", []), (4, None, None)], "id int, metadata string, vector array<double>")
    ids = lambda t: [r["id"] for r in df.where(L.compile_filter(t)).orderBy("id").collect()]
    assert ids(L.Where("k", "equals", "a")) == [1] and ids(L.Where("k", "not_equals", "b")) == [1]
    assert ids(L.Not((L.Where("k", "equals", "a"),))) == [2, 3, 4]
    assert ids(L.Where("k", "not_in", "x,y")) == [1]
    assert ids(L.VectorRange("magnitude", 0, 0)) == [3] and ids(L.VectorRange("density", 0, 1)) == [1, 2]
    assert ids(L.Every()) == [1, 2, 3, 4] and ids(L.Some()) == []
    with pytest.raises(ValueError):
        L.parse("no colon")


def test_search_edges(spark, vecs, asked):
    assert knn.search(vecs, asked, 10_000).count() == 5 * vecs.count()
    assert knn.search(vecs, asked.limit(0), 3).count() == 0 and knn.search(vecs.limit(0), asked, 3).count() == 0
    assert knn.search(vecs, asked, 3, block=2).count() == 15
    with pytest.raises(ValueError):
        V.distance("a", "b", "nothing")


def test_exact_search_shuffles_no_rows_but_the_best(vecs, asked):
    plan = knn.search(vecs, asked, 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_filters_reach_the_scan(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").where(F.col("p_size") == 3).select("p_partkey")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_size,3)" in plan and "p_name" not in plan.split("ReadSchema")[1]


def test_inverted_lists_and_hashes(spark, vecs, asked):
    r = kmeans.fit(vecs, 8, 5)
    lists = indexes.build_lists(vecs, r.centroids)
    exact = knn.search(vecs, asked, 10)
    assert knn.recall(exact, indexes.search_lists(lists, r.centroids, asked, 10, 8)).agg(F.min("recall")).first()[0] == 1.0
    found = plans.search(vecs, asked, 10, "euclidean", "approximate", index=plans.Index(lists, r.centroids), config=plans.preset("quick", probes=6))
    assert knn.recall(exact, found).agg(F.avg("recall")).first()[0] > 0.7
    h = indexes.Hashes(64, 8, 4)
    table = indexes.hash_table(vecs, h)
    assert table.count() == 8 * vecs.count()
    wide = indexes.search_hashes(table, vecs, asked, h, 10, 4)
    assert knn.recall(knn.search(vecs, asked, 10, "cosine"), wide).agg(F.min("recall")).first()[0] == 1.0
    with pytest.raises(ValueError):
        indexes.probes_for("nothing", 8, 1)


def test_kmeans_equals_numpy(vecs):
    x = np.array([r["vector"] for r in vecs.orderBy("id").collect()], float)
    c = x[:6].copy()
    for _ in range(3):
        at, _d = kmeans.nearest(x, c)
        c = np.array([x[at == j].mean(axis=0) for j in range(6)])
    assert np.allclose(kmeans.fit(vecs, 6, 3, start=x[:6], tolerance=0).centroids, c)


def test_samples(vecs):
    assert kmeans.sample_reservoir(vecs, 50).count() == 50
    assert kmeans.sample_importance(vecs.withColumn("w", F.lit(1.0)), "w", 40).agg(F.sum("draws")).first()[0] == 40
    assert kmeans.sample_coreset(vecs, 4)[0] == 0 and kmeans.sample_size(10**6) < 10**6


def test_running_total_equals_a_window(spark):
    df = spark.range(1000).selectExpr("id", "cast(id * 7919 % 50 as double) as o", "id % 13 as v")
    rows = sorted((r["o"], r["id"], r["v"], r["running"]) for r in running_total(df, "o", "id", "v", ranges=7).collect())
    total = 0
    for *_, v, run in rows:
        total += v
        assert run == total


def test_codes_and_distances(vecs):
    books = quantize.fit_product(vecs, 8, 4, 3)
    coded = vecs.select("id", "vector", quantize.encode_product("vector", books).alias("codes"))
    for r in coded.limit(20).collect():
        v = np.array(r["vector"], float).reshape(8, 8)
        assert [int(((books.centroids[s] - v[s]) ** 2).sum(axis=1).argmin()) for s in range(8)] == r["codes"]
    with pytest.raises(ValueError):
        quantize.fit_product(vecs, 8, 9)


def test_pca_equals_numpy(vecs):
    x = np.array([r["vector"] for r in vecs.collect()], float)
    p = quantize.pca(vecs, 5)
    assert np.allclose(p.explained, np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:5] / np.trace(np.cov(x.T, bias=True)))


def test_chunks():
    text = "A sentence here. " * 200
    for cut in X.CHUNKERS.values():
        found = cut(text)
        assert all(text[a : a + len(t)] == t and len(t) <= 1000 for a, t in found)
        assert found[0][0] == 0 and found[-1][0] + len(found[-1][1]) >= len(text) - 100
    assert X.cut_fixed("x" * 50, 10, 9, 1)[-1][0] + len(X.cut_fixed("x" * 50, 10, 9, 1)[-1][1]) == 50
    assert X.cut_recursive("") == [] and len(X.cut_fixed("short")) == 1


def test_selection_passes_over_what_does_not_fit(spark):
    rows = [(1, i, s, t, d, i, "c") for i, (s, t, d) in enumerate([(0.9, 60, 1), (0.8, 50, 1), (0.7, 30, 2)])]
    c = spark.createDataFrame(rows, "query_id int, id int, score double, tokens long, doc_id int, ts int, content string")
    assert [r["id"] for r in rag.select_top(c, 100).orderBy("position").collect()] == [0, 2]
    assert [r["id"] for r in rag.select_diverse(c, 1000, 1).orderBy("position").collect()] == [0, 2]
    assert [r["id"] for r in rag.drop_near_duplicates(c).collect()] == [0]


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), 2)
    assert s.read() is None
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, float("nan")]), ("", [1.0, 1.0]), ("c", None), ("d", [1.0]), ("a", [1.0, 2.0])], "id string, vector array<double>")
    assert s.load(rows) == {"inserted": 1, "known": 0, "errors": 4}
    with pytest.raises(ValueError):
        s.load(rows, strict=True)
    assert s.load(rows.where("id = 'a'"), skip_duplicates=True)["known"] == 1
    assert s.versions() == [1, 2] and s.restore(1) == 3
    assert {r["problem"] for r in store.split(rows, 2)[1].collect()} == {"not_finite", "empty_id", "missing_vector", "wrong_dimension"}


def test_formats(spark, tmp_path, vecs):
    assert sources.format_of("a/b.JSON") == "json" and sources.format_of("x.csv.gz") == "csv" and sources.format_of("x", " [1]") == "json" and sources.format_of("x", "id,") == "csv"
    with pytest.raises(ValueError):
        sources.read(spark, "x.h5")
    (tmp_path / "a.json").write_text('[{"id": "x", "vector": [1, 2], "metadata": {"k": 1}}, {"id": "y"}]')
    got = {r["id"]: (r["vector"], r["metadata"]) for r in sources.read(spark, str(tmp_path / "a.json")).collect()}
    assert got == {"x": ([1.0, 2.0], '{"k":"1"}'), "y": (None, None)}


def test_streams_equal_batches(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.read_stream(spark, str(tmp_path / "in"), "ts timestamp, key string", 10)
    q = streaming.sessions(stream).writeStream.outputMode("append").format("memory").queryName("sess").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = e.groupBy("key", F.session_window("ts", "10 minutes")).agg(F.count("*").alias("n"))
    assert spark.table("sess").count() <= batch.count() and spark.table("sess").count() > 0


def test_online_centroids(spark, vecs, tmp_path):
    vecs.select("id", "vector").write.parquet(str(tmp_path / "in"))
    learner = streaming.OnlineCentroids(np.array([r["vector"] for r in vecs.limit(4).collect()], float))
    start = learner.centroids.copy()
    q = streaming.each_batch(streaming.read_stream(spark, str(tmp_path / "in"), "id long, vector array<float>"), learner, str(tmp_path / "c"))
    q.awaitTermination()
    assert learner.batches >= 1 and not np.allclose(start, learner.centroids)


def test_hot_share(spark):
    rows = [(str(k), n) for k, n in enumerate([10, 8, 5, 2, 1, 1, 1, 1, 1, 1]) for _ in range(n)]
    got = {r["key"]: r["heat"] for r in access.hot_and_cold(spark.createDataFrame(rows, "key string, ts int")).collect()}
    assert got["0"] == got["1"] == "hot" and got["2"] == "warm" and got["4"] == "cold"


def test_semantic_search_finds_long_texts(spark, tmp_path):
    from vexel.queries.texts import l10_semantic_search

    rows = [(0, "alpha beta gamma"), (1, "delta epsilon"), (500, "alpha beta gamma " * 400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert 500 in {r["id"] for r in l10_semantic_search(spark, str(tmp_path)).where("query_id = 0").collect()}


def test_search_by_text_ids_and_ties(spark):
    rows = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", None), ("e", [1.0, None]), ("f", [1.0])], "id string, vector array<double>").repartition(3)
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("r", None)], "query_id string, query array<double>")
    for metric in knn.BATCHED:
        got = [(r["rank"], r["id"]) for r in knn.search(rows, asked, 2, metric).orderBy("rank").collect()]
        assert got == [(1, "a"), (2, "b")], metric


@pytest.mark.parametrize("metric", knn.BATCHED)
def test_search_and_radius_equal_numpy(spark, vecs, asked, metric):
    x = {r["id"]: np.array(r["vector"], float) for r in vecs.collect()}
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    got, near = {}, {}
    for r in knn.search(vecs.repartition(5), asked, 7, metric).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], r["distance"])
    for q in range(5):
        d = knn.paired(m, np.tile(x[q], (len(m), 1)), metric)
        order = np.lexsort((ids, d))[:7]
        assert [got[q][i + 1][0] for i in range(7)] == ids[order].tolist() and np.allclose([got[q][i + 1][1] for i in range(7)], d[order])
        near[q] = set(ids[d <= np.sort(d)[20] + 1e-12].tolist()), float(np.sort(d)[20] + 1e-12)
    for q, (want, within) in near.items():
        found = knn.radius(vecs, asked.where(F.col("query_id") == q), within, metric)
        assert {r["id"] for r in found.collect()} == want


def test_an_index_lives_on_disk(spark, vecs, asked):
    index = indexes.train_index(vecs, 8, 4)
    assert index.lists.count() == vecs.count() and "label" in index.lists.columns
    path = shared.scratch(spark)
    index.save(path)
    again = indexes.load_index(spark, path)
    assert np.allclose(again.centroids, index.centroids)
    pick = lambda df: sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())
    assert pick(again.search(asked, 5, 3)) == pick(index.search(asked, 5, 3))
    assert again.retrained(2).lists.count() == vecs.count()
    twice = indexes.build_lists(vecs.unionByName(vecs), index.centroids)
    assert twice.count() == 2 * vecs.count()
    with pytest.raises(ValueError):
        indexes.train_index(vecs.limit(3), 8)
    sure = indexes.search_in_rounds(index.lists, index.centroids, asked, 5, 8, 2.0)
    assert pick(sure.drop("probed")) == pick(index.search(asked, 5, 8))


def test_learned_distances(spark):
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((400, 6)), rng.standard_normal((400, 6))
    same = np.sign(x[:, 0]) == np.sign(y[:, 0])
    net = learned.fit_neural(x, y, (~same).astype(float), 16, 800)
    assert np.mean((net(x, y) > 0.5) == ~same) > 0.9
    m = learned.update_metric(np.eye(6), (x[same], y[same]), (x[~same], y[~same]), 0.02, 60)
    gap = lambda a: np.linalg.norm((x - y) @ a.T, axis=1)
    assert gap(m)[~same].mean() / gap(m)[same].mean() > gap(np.eye(6))[~same].mean() / gap(np.eye(6))[same].mean()
    rows = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), (None, [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r["d"] for r in rows.select(learned.custom_distance(lambda p, q: np.abs(p - q).sum(axis=1))("a", "b").alias("d")).collect()]
    assert got == [4.0, None]


def test_chunks_overlap_by_whole_paragraphs():
    paragraphs = [f"paragraph {i} " + "x" * 120 for i in range(12)]
    found = X.cut_paragraphs("\n\n".join(paragraphs), 500, 150, 10)
    for (_, one), (_, two) in zip(found, found[1:]):
        assert two.startswith(one.split("\n\n")[-1]) and len(one) <= 500
    assert {p for _, c in found for p in c.split("\n\n")} == set(paragraphs)
    assert X.cut_paragraphs("a" * 30 + "\n\n" + "b" * 2000 + "\n\n" + "c" * 30, 500, 100, 10)[-1][1] == "c" * 30


def test_embeddings(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "b a"), (3, None), (4, "a b"), (5, "")], "id int, t string")
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return X.word_buckets(texts, 8)

    got = {r["id"]: r["vector"] for r in X.embed_distinct(rows, "t", embed).collect()}
    assert got[3] is None and got[1] == got[4] == got[2] and got[5] == [0.0] * 8 and calls.value == 3
    one, two = X.word_buckets(["a b", "b a"], 64, 0.1)
    assert not np.allclose(one, two) and np.isclose((one * one).sum(), 1)


def test_nearest_users_leave_themselves_out(spark):
    v = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(12)], "id int, vector array<double>")
    near = recommend.nearest_users(v, 3).collect()
    assert len(near) == 36 and all(r["user_id"] != r["other"] and r["distance"] < 1e-9 for r in near)


def test_tiers_move_by_one_step(spark):
    items = spark.createDataFrame([(1, "archive"), (2, "memory"), (3, "ssd"), (4, "memory")], "id int, tier string")
    asked = spark.createDataFrame([(1, "promote"), (2, "promote"), (3, "demote")], "id int, decision string")
    assert {r["id"]: (r["tier"], r["moved"]) for r in store.migrated(items, asked).collect()} == {1: ("ssd", True), 2: ("memory", False), 3: ("archive", True), 4: ("memory", False)}
    copy = store.copy_verified(items, shared.scratch(spark))
    assert copy.count() == 4


def plan(df):
    return df._jdf.queryExecution().toString()


def test_users_with_equal_vectors_are_searched_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    kinds = np.vstack([rng.integers(0, 4, (30, 5)), np.zeros((1, 5), int), np.full((1, 5), 2)]).astype(float)
    x = kinds[rng.integers(0, len(kinds), 300)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    searched, search = [], knn.search
    monkeypatch.setattr(knn, "search", lambda r, q, *a, **b: searched.append((r.count(), q.count())) or search(r, q, *a, **b))
    got = sorted((r["user_id"], r["distance"], r["other"]) for r in recommend.nearest_users(rows, 4).collect())
    assert searched == [(len({tuple(v) for v in x}),) * 2]
    norm = np.sqrt((x * x).sum(axis=1))
    size = norm[:, None] * norm[None, :]
    d = np.where(size == 0, 1.0, 1 - x @ x.T / np.where(size == 0, 1.0, size))
    assert got == sorted((i, d[i, j], j) for i in range(300) for j in sorted((j for j in range(300) if j != i), key=lambda j: (d[i, j], j))[:4])


def test_scores_of_users_are_dealt_out_once(spark):
    near = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.25), (2, 1, 0.5)], "user_id long, other long, distance double")
    taken = spark.createDataFrame([(1, 7), (2, 7), (2, 8), (3, 8), (3, 9)], "user_id long, item_id long")
    found = recommend.by_users(near, taken, 2)
    assert [tuple(r) for r in found.select("user_id", "rank", "item_id", "score").orderBy("user_id", "rank").collect()] == [(1, 1, 8, 1.25), (1, 2, 9, 0.75)]
    assert "hashpartitioning(user_id" in plan(found) and "item_id" not in "".join(p.split(")")[0] for p in plan(found).split("hashpartitioning(")[1:])


def test_product_of_matrices_shuffles_no_products(spark):
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal((40, 7)) * (rng.random((40, 7)) < 0.4), rng.standard_normal((7, 30)) * (rng.random((7, 30)) < 0.4)
    table = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in np.argwhere(m)], "i long, j long, x double")
    found = quantize.multiply(table(a), table(b))
    met = (a != 0).astype(int) @ (b != 0).astype(int)
    got = {(r["i"], r["j"]): r["x"] for r in found.collect()}
    assert set(got) == {tuple(x) for x in np.argwhere(met).tolist()} and all(abs(v - (a @ b)[k]) < 1e-12 for k, v in got.items())
    assert "Join" not in plan(found) and "Exchange" not in plan(found)


def test_an_index_is_trained_on_all_rows(spark):
    rows = spark.range(120_000).select("id", F.array(F.col("id").cast("double")).alias("vector"))
    assert indexes.train_index(rows, iterations=1, start=np.array([[0.0], [1e9]])).centroids[0, 0] == 59_999.5


def test_box_volume_of_the_sides_with_a_length(spark):
    cols = {"a": arr(1, 2, 5), "b": arr(3, 2, 8)}
    assert one(spark, V.box_volume("a", "b", flat=False), **cols) == 6.0 and one(spark, V.box_volume("a", "b"), **cols) == 0.0
    assert one(spark, V.box_volume("a", "a", flat=False), **cols) is None


def test_pairs_by_batches(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((50, 6)) + 100
    x[1] = x[0]
    x[2] = x[0] + 1e-7
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(50, None), (51, [None] * 6)], "id long, vector array<double>")
    q = rows.where("id in (0, 1, 2, 50)").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    for metric in knn.BATCHED:
        found = knn.pairs(rows, q, metric)
        got = {(r["query_id"], r["id"]): r["distance"] for r in found.collect()}
        assert len(got) == 4 * 52 and {k for k, v in got.items() if v is None} == {k for k in got if 50 in k or k[1] == 51}
        assert all(v == pytest.approx(float(knn.paired(x[[j]], x[[i]], metric)[0]), abs=1e-9) for (i, j), v in got.items() if v is not None)
        assert "MapInPandas" in plan(found)


def test_transport_of_long_vectors_takes_each_sum_once(spark):
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal(500), rng.standard_normal(500)
    p, q = ((v - min(v.min(), 0)) / (v - min(v.min(), 0)).sum() for v in (a, b))
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>").select(V.wasserstein("a", "b").alias("v"))
    assert df.first()["v"] == pytest.approx(np.abs(np.cumsum(p - q)).sum())
    assert plan(df.limit(1)).split("== Analyzed")[1].split("== Optimized")[0].count("aggregate(") <= 6


def test_chunks_are_made_a_few_at_a_time(spark):
    docs = spark.createDataFrame([(i, f"{i} " * 400_000) for i in range(6)] + [(6, None), (7, "")], "doc_id long, text string").coalesce(1)
    made = X.chunk(docs, lambda t, *_: [(0, t)])
    assert "MapInArrow" in plan(made) and "ArrowEvalPython" not in plan(made)
    assert made.count() == 6 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= shared.BATCH_BYTES


def test_texts_go_to_python_a_few_at_a_time(spark):
    docs = spark.createDataFrame([(i, f"{i} " * 400_000) for i in range(6)] + [(6, None), (7, "")], "doc_id long, text string").coalesce(1)

    def embed(texts):
        assert sum(map(len, texts)) <= 2 * X.BATCH_CHARS
        return np.array([[float(len(t))] for t in texts])

    got = {r["doc_id"]: r["v"] for r in docs.select("doc_id", X.embedding("text", embed).alias("v")).collect()}
    assert got == {i: [800_000.0] for i in range(6)} | {6: None, 7: [0.0]}


def test_hybrid_searches_neighbours_once(spark, sf):
    from vexel.queries import recommending

    assert "MapInPandas" not in plan(recommending.p4_hybrid(spark, sf))  # they are read where they were written


def test_asked_ids_do_not_depend_on_how_the_range_is_dealt_out(spark, sf):
    from vexel.queries.stores import s16_contains

    found = s16_contains(spark, sf)
    assert "Limit" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["id"] for r in found.collect()) == list(range(0, 14_000, 7))


def test_many_queries_stay_and_blocks_of_rows_go_to_them(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.integers(0, 4, (2500, 6)), np.zeros((3, 6), int), np.eye(6, dtype=int), 2 * np.eye(6, dtype=int)]).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [1.0])], "id long, vector array<double>")
    monkeypatch.setattr(knn, "VALUES", 7_000)
    found = knn.search(rows, rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query")), 5, "cosine", many=True)
    assert plan(found).split("== Physical")[0].count("MapInArrow") >= 2
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["id"]))
    assert sorted(got) == list(range(len(x)))
    for q in [*range(0, 2500, 50), *range(2500, len(x))]:
        d = knn.paired(x, np.tile(x[q], (len(x), 1)), "cosine")
        assert sorted(got[q]) == [(i + 1, d[j], j) for i, j in enumerate(np.lexsort((np.arange(len(x)), d))[:5])]


def test_items_of_users_travel_as_lists(spark):
    rng = np.random.default_rng(12)
    had = {(f"u{u}", f"i{i}") for u, i in rng.integers(0, 40, (400, 2))}
    near = [(f"u{u}", f"u{(u + s) % 40}", s / 8) for u in range(40) for s in (1, 2, 3)]
    taken = spark.createDataFrame(sorted(had) + sorted(had)[:50], "user_id string, item_id string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = recommend.by_users(spark.createDataFrame(near, "user_id string, other string, distance double"), taken, 4)
        assert "bool_or" not in plan(found) and "Generate" not in plan(found)  # no row for each item of each neighbour
        got = sorted((r["user_id"], r["rank"], r["item_id"], r["score"]) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    score = {}
    for u, o, d in near:
        for other, i in had:
            if other == o and (u, i) not in had:
                score[u, i] = score.get((u, i), 0.0) + 1 - d
    want = []
    for u in sorted({u for u, _ in score}):
        want += [(u, n + 1, i, s) for n, (s, i) in enumerate(sorted(((s, i) for (v, i), s in score.items() if v == u), key=lambda z: (-z[0], z[1]))[:4])]
    assert got == want


def test_hybrid_equals_all_pairs_of_users_and_items(spark):
    """Popular items below the content's bound don't displace those above it."""
    rng = np.random.default_rng(13)
    parts = [(i, f"c{i % 3}", float(rng.integers(0, 6) / 5), float(rng.integers(0, 3) / 2), float(rng.integers(0, 10) / 10), float(rng.integers(0, 20) / 40)) for i in range(300)]
    items = spark.createDataFrame(parts, "item_id long, category string, attribute double, price double, quality double, boost double")
    profiles = spark.createDataFrame([(f"u{u}", f"c{c}", float(rng.integers(1, 9))) for u in range(60) for c in range(4) if (u + c) % 5], "user_id string, category string, weight double")
    near = spark.createDataFrame([(f"u{u}", int(i), float(s) / 4) for u in range(0, 60, 2) for i, s in zip(rng.choice(320, 6, replace=False), rng.integers(0, 5, 6))], "user_id string, item_id long, score double")
    own = recommend.content_score(F.lit(0.0), F.col("attribute"), F.col("price"), F.col("quality"))
    found = recommend.hybrid(near, profiles, items.select("item_id", "category", own.alias("own"), "boost"), 3)
    mixed = recommend.fuse([(recommend.by_content(profiles, items), 0.6), (near, 0.4)], ["user_id", "item_id"])
    boosted = mixed.join(items.select("item_id", "boost"), "item_id").select("user_id", "item_id", F.round(F.col("score") + F.col("boost"), 9).alias("score"))
    want = recommend.best(recommend.diversify(boosted, items), 3)
    plain = lambda df: sorted((r["user_id"], r["rank"], r["item_id"], round(r["score"], 8)) for r in df.collect())
    assert plain(found) == plain(want) and len(plain(want)) == 180
