"""Neighbour descent, fuzzy weights, Leiden, UMAP and t-SNE against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.operators import communities, graphs, layout, ml
from ionloom.plans import all_queries


def blobs(n=420, groups=6, width=8, seed=2, spread=0.35):
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(size=(groups, width)) * 2
    return [(3 * i, (centers[i % groups] + rnd.normal(size=width) * spread).tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(blobs(), "cell long, v array<double>").persist()


@pytest.fixture(scope="module")
def near(points):
    return ml.neighbours(points, 12, vector="v").persist()


@pytest.fixture(scope="module")
def edges(near):
    return graphs.fuzzy_graph(near, 12).persist()


def test_descent_recall(spark, points, near):
    got = graphs.descend(points, 12, vector="v", bucket_rows=40, tables=2).collect()
    exact = {(r.src, r.dst): r.distance for r in near.collect()}
    assert len(got) == len(exact) == 420 * 12
    assert sum((r.src, r.dst) in exact for r in got) >= 0.95 * len(exact)
    where = dict(blobs())
    for r in got[::97]:
        assert r.distance == pytest.approx(math.dist(where[r.src], where[r.dst]), rel=1e-12)


def test_descent_on_hard_data(spark):
    rnd = np.random.default_rng(8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rnd.normal(size=(900, 24)))], "cell long, v array<double>")
    got = {(r.src, r.dst) for r in graphs.descend(df, 10, vector="v", bucket_rows=64).collect()}
    exact = {(r.src, r.dst) for r in ml.neighbours(df, 10, vector="v").collect()}
    assert len(got & exact) >= 0.9 * len(exact)


def test_descent_of_little_and_of_copies(spark):
    schema = "cell long, v array<double>"
    assert graphs.descend(spark.createDataFrame([], schema), 3, vector="v").count() == 0
    assert graphs.descend(spark.createDataFrame([(1, [0.0])], schema), 3, vector="v").count() == 0
    few = graphs.descend(spark.createDataFrame([(i, [float(i)]) for i in range(5)], schema), 8, vector="v").collect()
    assert len(few) == 20
    same = spark.createDataFrame([(i, [1.0, 2.0] if i % 3 == 0 else [float(i), 0.0]) for i in range(600)], schema)
    got = graphs.descend(same, 5, vector="v", bucket_rows=64).groupBy("src").agg(F.count("*").alias("n"), F.max("distance").alias("far")).collect()
    assert all(r.n == 5 for r in got) and all(r.far == 0 for r in got if r.src % 3 == 0)


def test_fuzzy_weights(near, edges):
    lists = {}
    for r in near.collect():
        lists.setdefault(r.src, []).append((r.distance, r.dst))
    one = {}
    for src, found in lists.items():
        found.sort()
        rho = min(d for d, _ in found if d > 0)
        low, high = 0.0, 1e6
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if sum(math.exp(-max(0, d - rho) / mid) for d, _ in found) > math.log2(13) else (mid, high)
        one |= {(src, dst): math.exp(-max(0, d - rho) / high) for d, dst in found}
    want = {(min(p), max(p)): one.get(p, 0) + one.get(p[::-1], 0) - one.get(p, 0) * one.get(p[::-1], 0) for p in one}
    got = {(r.a, r.b): r.weight for r in edges.collect()}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], abs=1e-9) for p in want)


def quality(pairs, labels, resolution=1.0):
    k, twice, inside = {}, 0.0, 0.0
    for a, b, w in pairs:
        k[a], k[b], twice = k.get(a, 0) + w, k.get(b, 0) + w, twice + 2 * w
        inside += 2 * w * (labels[a] == labels[b])
    groups = {}
    for node, degree in k.items():
        groups[labels[node]] = groups.get(labels[node], 0) + degree
    return inside / twice - resolution * sum((g / twice) ** 2 for g in groups.values())


def partitions(items):
    if not items:
        yield {}
        return
    for rest in partitions(items[1:]):
        for label in {*rest.values(), len(items)}:
            yield {items[0]: label, **rest}


def connected(pairs, nodes):
    nodes, todo = set(nodes), [next(iter(nodes))]
    seen = set(todo)
    while todo:
        x = todo.pop()
        for a, b, _ in pairs:
            for y in ((b,) if a == x else (a,) if b == x else ()):
                if y in nodes and y not in seen:
                    seen.add(y)
                    todo.append(y)
    return seen == nodes


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long, weight double")


def test_leiden_against_all_partitions(spark):
    rnd = np.random.default_rng(4)
    for seed, resolution in ((0, 1.0), (1, 0.5)):
        pairs = [(a, b, float(rnd.integers(1, 4))) for a, b in itertools.combinations(range(8), 2) if rnd.random() < 0.45]
        nodes = sorted({x for a, b, _ in pairs for x in (a, b)})
        best = max(quality(pairs, p, resolution) for p in partitions(nodes))
        got = {r.node: r.community for r in communities.leiden(frame(spark, pairs), resolution).collect()}
        assert quality(pairs, got, resolution) >= best - 0.03
        assert all(connected(pairs, [x for x in nodes if got[x] == c]) for c in set(got.values()))


def test_leiden_finds_planted_groups(spark):
    groups = [range(8 * g, 8 * g + 8 + (g == 2)) for g in range(3)]
    pairs = [(a, b, 1.0) for g in groups for a, b in itertools.combinations(g, 2)] + [(0, 8, 1.0), (9, 16, 1.0), (17, 1, 1.0), (5, 5, 100.0), (2, 3, -1.0)]
    extra = spark.createDataFrame([(100,), (0,)], "node long")
    labels = communities.leiden(frame(spark, pairs), nodes=extra).collect()
    got = {r.node: r.community for r in labels}
    assert [got[g[0]] for g in groups] == [1, 2, 0] and all(len({got[x] for x in g}) == 1 for g in groups) and got[100] == 3
    plain = [(a, b, w) for a, b, w in pairs if a != b and w > 0]
    q = communities.modularity(frame(spark, pairs), spark.createDataFrame(labels).select("node", "community")).first()[0]
    assert q == pytest.approx(quality(plain, got), abs=1e-12)


def test_leiden_of_nothing(spark):
    assert communities.leiden(frame(spark, [])).count() == 0
    alone = communities.leiden(frame(spark, [(1, 1, 2.0)]), nodes=spark.createDataFrame([(7,), (5,)], "node long")).collect()
    assert [tuple(r) for r in sorted(alone)] == [(5, 0), (7, 1)]


def test_curve_has_the_known_parameters():
    assert layout.curve(0.5) == pytest.approx((0.583, 1.334), abs=2e-3) and layout.curve(0.1) == pytest.approx((1.577, 0.895), abs=2e-3)


def start(points):
    scores = ml.pca(points, 2, vector="v")["scores"]
    return scores.select(F.col("cell").alias("id"), F.col("pcs").alias("y"))


def kept(spark, near, placed):
    rows = spark.createDataFrame([(r.id, list(r.y)) for r in placed.collect()], "cell long, y array<double>")
    return layout.preservation(near, ml.neighbours(rows, 12, vector="y"))


def test_umap_keeps_neighbours(spark, points, near, edges):
    first = start(points)
    placed = layout.umap_layout(edges, first, rounds=6, part_rows=150, most_edges=10)
    assert kept(spark, near, placed) > max(0.3, kept(spark, near, first))
    again = layout.umap_layout(edges.repartition(7), first.repartition(3), rounds=6, part_rows=150, most_edges=10)
    near_to = {r.id: r.y for r in again.collect()}
    assert all(np.allclose(r.y, near_to[r.id], atol=1e-6) for r in placed.collect())
    # groups stand apart: most neighbours in the plane are of the same group
    rows = spark.createDataFrame([(r.id, list(r.y)) for r in placed.collect()], "cell long, y array<double>")
    assert ml.neighbours(rows, 5, vector="y").where("src div 3 % 6 = dst div 3 % 6").count() > 0.9 * 420 * 5


def test_umap_of_little(spark, edges):
    none = spark.createDataFrame([], "id long, y array<double>")
    assert layout.umap_layout(edges, none).count() == 0
    lone = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "id long, y array<double>")
    assert layout.umap_layout(edges.limit(0), lone, rounds=1).count() == 2


def plain_gradient(pairs, ids, y, exaggeration=1.0):
    at = {x: i for i, x in enumerate(ids)}
    p = np.zeros((len(ids), len(ids)))
    for r in pairs:
        p[at[r.a], at[r.b]] = r.p
    away = y[:, None] - y[None]
    k = 1 / (1 + (away**2).sum(-1))
    np.fill_diagonal(k, 0)
    pull, push = 4 * ((exaggeration * p * k)[:, :, None] * away).sum(1), 4 * ((k * k / k.sum())[:, :, None] * away).sum(1)
    return pull - push, push


def test_tsne_gradient_is_near_the_exact_one(spark, near):
    pairs = layout.affinities(near, 5)
    held = pairs.collect()
    assert sum(r.p for r in held) == pytest.approx(1) and all(p == pytest.approx(q) for p, q in ((r.p, {(s.a, s.b): s.p for s in held}[r.b, r.a]) for r in held[:20]))
    ids = sorted({r.a for r in held})
    for width, limit in ((8.0, 0.01), (0.001, 0.01), (40.0, 0.01)):
        y = np.random.default_rng(5).normal(size=(len(ids), 2)) * width
        now = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, y)], "id long, y array<double>")
        got = np.stack([r.gradient for r in layout.tsne_gradient(pairs, now, 4.0).orderBy("id").collect()])
        want, push = plain_gradient(held, ids, y, 4.0)
        assert np.linalg.norm(got - want) < limit * np.linalg.norm(push)


def test_affinities_have_the_perplexity(near):
    rows = {}
    for r in near.where("src < 30").collect():
        rows.setdefault(r.src, []).append(r.distance)
    for found in rows.values():
        low, high = 0.0, 1e9
        d2 = np.array(sorted(found)) ** 2
        d2 -= d2[0]
        for _ in range(200):
            beta = (low + high) / 2
            w = np.exp(-d2 * beta)
            p = w / w.sum()
            low, high = (beta, high) if -(p * np.log(np.maximum(p, 1e-300))).sum() > math.log(5) else (low, beta)
        assert -(p * np.log(np.maximum(p, 1e-300))).sum() == pytest.approx(math.log(5), abs=1e-6)


def test_tsne_keeps_neighbours(spark, points, near):
    first = start(points)
    placed = layout.tsne_layout(layout.affinities(near, 4), first, early=18, late=28, exaggeration=4.0, rate=200.0, width=10.0)
    assert kept(spark, near, placed) > max(0.3, kept(spark, near, first))
    assert layout.tsne_layout(layout.affinities(near, 4), spark.createDataFrame([], "id long, y array<double>")).count() == 0


def test_queries(spark, tmp_path):
    rows = [(i, v, i % 3) for i, v in blobs(150, width=12)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    known = all_queries()
    got = known["leiden"](spark, str(tmp_path)).collect()
    assert len(got) == 150 and len({r.community for r in got}) == 6
    assert known["neighbour_descent"](spark, str(tmp_path)).count() == 150 * 15
    assert known["graph_modularity"](spark, str(tmp_path)).first()[0] is not None


def test_edges_are_made_once(spark):
    """Both directions of an edge come from one pass over what makes the edges."""

    def counted(rows, schema):
        made = spark.sparkContext.accumulator(0)

        def run(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        return spark.createDataFrame(rows, schema).mapInArrow(run, schema), made

    links = [(1, 2, 0.5), (2, 3, 1.0), (3, 1, 0.25), (4, 5, 1.0)]
    edges, made = counted(links, "a long, b long, weight double")
    labels = spark.createDataFrame([(i, i // 4) for i in range(1, 6)], "node long, community long")
    assert communities.modularity(edges, labels).first()[0] is not None and made.value == 4
    near, made = counted(links[:3], "src long, dst long, distance double")
    assert layout.affinities(near, 2).count() == 6 and made.value == 3
    edges, made = counted(links, "a long, b long, weight double")
    start = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 6)], "id long, y array<double>")
    assert layout.umap_layout(edges, start, rounds=1, epochs=1).count() == 5 and made.value == 4
