import numpy as np

from quillspan.llm import embedding

SCHEMA = "vec_id long, embedding array<float>, label int, node long"


def brute(rows, threshold=embedding.THRESHOLD):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.abs(v).max(initial=0) > 0]
    links = {i: 0 for i, _ in rows}
    comp = {i: i for i, _ in rows}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in range(len(ok)):
        for b in range(a):
            (i, x), (j, y) = ok[a], ok[b]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[i] += 1
                links[j] += 1
                comp[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (links[i], find(i)) for i, _ in rows}


def clouds(n=700, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 7 == 0:
            centre = rng.normal(size=dim)
        spread = 0.05 if (i // 7) % 2 else 1.0
        rows.append((i, (centre + spread * rng.normal(size=dim)).astype(np.float32).tolist()))
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(i, v, i and i % 3, 0) for i, v in rows], SCHEMA)
    return embedding.near_duplicates(df)


def test_near_brute_force(spark):
    rows = clouds()
    found = {r["vec_id"]: r for r in run(spark, rows).collect()}
    truth = brute(rows)
    assert all(found[i]["n_links"] <= truth[i][0] for i in truth)
    assert sum(r["n_links"] for r in found.values()) >= 0.97 * sum(t[0] for t in truth.values()) > 0
    assert np.mean([found[i]["component_id"] == truth[i][1] for i in truth]) > 0.98
    assert found[0]["recall"] >= 0.9


def test_large_ball_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding, "BLOCK", 64)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=16)
    rows = [(i, (centre + 0.02 * rng.normal(size=16)).tolist()) for i in range(200)] + [(1000 + i, rng.normal(size=16).tolist()) for i in range(50)]
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in run(spark, rows).collect()}
    assert found == brute(rows)


def test_awkward_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(5, v), (3, v), (9, [2.0, 4.0, 6.0]), (1, None), (2, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (8, []), (10, [1.0, 2.0]), (11, [3.0, -1.0, 0.0])]
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in run(spark, rows).collect()}
    assert found == {i: (n, c, i == c) for i, (n, c) in brute(rows).items()}
    assert found[3] == (2, 3, True) and found[9] == (2, 3, False)


def test_empty(spark):
    assert run(spark, []).count() == 0
    assert [tuple(r)[:4] for r in run(spark, [(1, None)]).collect()] == [(1, 0, 1, True)]


def test_scaling_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [3.0, 4.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [-inf, 1.0]), (6, []), (7, [0.0, 0.0]), (8, [3e300, 4e300]), (9, [3e-300, 4e-300]), (10, [0.0, 0.0, -2.0]), (None, [3.0, 4.0]), (11, [5.0])]
    for kind in ("array<double>", "array<float>"):
        usual = [r for r in rows if kind == "array<double>" or r[0] not in (8, 9)]
        found = {r["vec_id"]: r["v"] for r in embedding.usable(spark.createDataFrame(usual, f"vec_id long, embedding {kind}").coalesce(1)).collect()}
        assert len(found) == len(usual)
        assert all(found[i] is None for i in (2, 3, 4, 5, 6, 7))
        alike = [found[i] for i in (1, None, 8, 9) if i in found]
        assert all(np.allclose(v, [0.6, 0.8], atol=1e-15) for v in alike)
        assert found[10] == [0.0, 0.0, -1.0] and found[11] == [1.0]


def at_cosine(n, dim, cosine, seed):
    """n pairs (x, y) with the given cosine, in directions of their own."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1)[:, None] * x
    return x, cosine * x + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away, axis=1)[:, None]


def test_overlap_grows_with_the_pivots():
    found = []
    for k in (100, 500, 2000):
        pivots = at_cosine(k, 64, 0.95, k + 7)[0]
        found.append(embedding.overlap_for(pivots, 0.95))
        near = [np.argsort(-(v @ pivots.T), 1)[:, : found[-1]] for v in at_cosine(1000, 64, 0.95, 1)]
        assert np.mean([bool(set(a) & set(b)) for a, b in zip(*near, strict=True)]) >= 0.95
    assert 2 < found[0] <= found[1] <= found[2] <= embedding.OVERLAP_MOST


def nodes_and_links(spark, rows, links):
    nodes = spark.createDataFrame([(i, 1, v) for i, v in rows], "node long, copies long, v array<double>")
    return nodes, spark.createDataFrame(links, "node long, links long")


def test_audit_without_true_links_measures_nothing(spark):
    rows = [(i, np.eye(80)[i].tolist()) for i in range(80)]
    assert embedding.audit(*nodes_and_links(spark, rows, [(0, 0)]), 0.95) is None
    assert {r["recall"] for r in run(spark, [(i, v) for i, v in rows]).collect()} == {None}


def test_audit_sees_rare_links_and_not_only_a_large_group(spark):
    x, y = at_cosine(20, 64, 0.97, 3)
    ball = np.eye(64)[0] + 0.005 * np.random.default_rng(5).normal(size=(100, 64))
    lone = at_cosine(1500, 64, 0.9, 6)[0]
    every = np.concatenate([ball / np.linalg.norm(ball, axis=1)[:, None], x, y, lone])
    nodes, links = nodes_and_links(spark, list(enumerate(every.tolist())), [(i, 99) for i in range(100)] + [(i, 1) for i in range(100, 110)])
    assert abs(embedding.audit(nodes, links, 0.95) - 0.25) < 1e-9  # of 40 nodes in pairs, 10 have their link


def test_all_pairs_where_the_index_falls_short(spark, monkeypatch):
    monkeypatch.setattr(embedding, "BLOCK", 64)
    monkeypatch.setattr(embedding, "OVERLAP_MOST", 2)
    monkeypatch.setattr(embedding, "graph_links", lambda nodes, *a: nodes.selectExpr("node", "0L AS links", "node AS root"))
    rows = clouds(300) + [(1000, [1.0, 2.0]), (1001, [1.0, 2.01])]
    out = run(spark, rows).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == brute(rows)
    assert out[0]["recall"] == 1.0


def nodes_of(spark, rows):
    unit = [(i, 1, (np.array(v) / np.linalg.norm(v)).tolist()) for i, v in rows]
    return spark.createDataFrame(unit, "node long, copies long, v array<double>"), np.array([v for _, _, v in unit])


def test_united_lists_lead_across_shards(spark, monkeypatch):
    """Chains of near vectors cut by many pivots: what no shard holds together is found along the united lists."""
    rng = np.random.default_rng(8)
    rows = []
    for c in range(40):
        a, b = np.linalg.qr(rng.normal(size=(16, 2)))[0].T
        rows += [(100 * c + k, (np.cos(k / 9) * a + np.sin(k / 9) * b).tolist()) for k in range(12)]
    nodes, x = nodes_of(spark, rows)
    truth = int((x @ x.T >= 0.95).sum()) - len(rows)
    pivots = x  # a shard for each vector: itself and few others
    count = lambda across: embedding.graph_links(nodes, pivots, 0.95, 2, 40, across).agg({"links": "sum"}).first()[0]
    apart, together = count(False), count(True)
    assert 0 < 1.1 * apart < together <= truth


def test_counts_are_symmetric_with_few_hops(spark, monkeypatch):
    monkeypatch.setattr(embedding, "BEAM", 2)
    rows = clouds(400)
    nodes, x = nodes_of(spark, rows)
    links = {r[0]: r[1] for r in embedding.graph_links(nodes, embedding.pivots_of(nodes, 400), 0.95, 2, 1).groupBy("node").sum("links").collect()}
    label = x @ x.T >= 0.95
    assert sum(links.values()) % 2 == 0
    assert all(links[i] == label[i].sum() - 1 for i in range(400))


def test_vectors_around_a_common_direction(spark):
    rng = np.random.default_rng(9)
    mean = rng.normal(size=48)
    rows = [(i, (3.2 * mean + rng.normal(size=48)).tolist()) for i in range(1500)]
    rows += [(2000 + i, (np.array(rows[i][1]) + 0.02 * rng.normal(size=48)).tolist()) for i in range(200)]
    nodes, x = nodes_of(spark, rows)
    cos = np.median(x @ x.T)
    pivots = embedding.pivots_of(nodes, len(rows), 0.97)
    assert 0.85 < cos < 0.95 and len(pivots) == 3
    found = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), threshold=0.97).collect()
    truth = (x @ x.T >= 0.97).sum(1) - 1
    assert truth.sum() >= 400 and sum(r["n_links"] for r in found) >= 0.97 * truth.sum()


def test_shards_within_shards(spark, monkeypatch):
    for name, value in (("PIVOT_SAMPLE", 4), ("PER_SHARD", 40), ("SALT_ROWS", 90)):
        monkeypatch.setattr(embedding, name, value)
    rows = clouds(700) + [(9000, [1.0, 2.0]), (9001, [1.0, 2.01])]
    nodes, _ = nodes_of(spark, [r for r in rows if len(r[1]) == 16])
    placed = embedding.placed_rows(nodes, embedding.pivots_of(nodes, 700), 3).collect()
    assert len(placed) == 700 and all(1 <= len(r["shards"]) <= 3 for r in placed)
    assert len({s for r in placed for s in r["shards"]}) > 8
    found = {r["vec_id"]: r for r in run(spark, rows).collect()}
    truth = brute(rows)
    assert sum(r["n_links"] for r in found.values()) >= 0.95 * sum(t[0] for t in truth.values()) > 0
    assert found[9000]["n_links"] == 1
