import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.functions import features, nulls, raster, signal, text
from quillspan.operators import dag, metrics, models, pack, resolve, rollup, split
from quillspan.sources import readers, writers
from quillspan.streaming import rollup as streamed

NAN = float("nan")


def test_null_rules(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", NAN, None), ("a", None, NAN), ("b", 4.0, 1.0), (None, 9.0, 9.0)], "k string, x double, y double")
    rows = {r["k"]: r for r in rollup.rollup(df, ["k"], ["x", "y", "absent"], ["x"], ["y"]).collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"]["n_rows"] == 3 and rows["a"]["x"] == pytest.approx(1 / 3) and rows["b"]["x_std"] == 0
    assert rows["a"]["x_std"] == pytest.approx(math.sqrt(1 / 3 - 1 / 9))
    one = spark.createDataFrame([(1.0, None, NAN, float("inf"))], "a double, b double, c double, d double")
    r = one.select(nulls.strict_max(F.col("a"), F.col("b")), nulls.row_mean("a", "b", "c"), nulls.finite_or_zero("d"), nulls.row_range("a", "b")).first()
    assert r[0] is None and r[1] == 1.0 and r[2] == 0.0 and r[3] == 0.0


def test_rollup_is_the_same_under_any_partitioning(spark):
    rng = random.Random(0)
    df = spark.createDataFrame([(rng.randrange(5), rng.random()) for _ in range(500)], "k int, x double")
    a, b = ({r["k"]: (r["n_rows"], round(r["x"], 9)) for r in rollup.rollup(d, ["k"], ["x"]).collect()} for d in (df.repartition(1), df.repartition(7)))
    assert a == b


def test_features(spark):
    df = spark.createDataFrame([("2020-09-05 07:00", 52.225, 20.999), ("2020-12-01", 0.0, None)], "t string, lat double, lon double")
    rows = df.select(features.hour_of("t").alias("h"), features.month_key("t").alias("m"), features.distance_km("lat", "lon").alias("d")).collect()
    assert rows[0][0] == 7 and rows[0][1] == "2020_9" and rows[0][2] < 1
    assert rows[1][0] is None and rows[1][1] == "2020_12" and rows[1][2] is None


def naive_soft(p, edges):
    p = dict(p)
    for _ in range(len(p) + 1):
        for c, a in edges:
            p[c] = min(p[c], p[a])
    for _ in range(len(p) + 1):
        for c, a in edges:
            p[a] = max(p[a], p[c])
    return p


def test_soft_propagation_closed_form(spark):
    rng = random.Random(3)
    edges = [(c, a) for c in range(1, 12) for a in range(c) if rng.random() < 0.3]
    p = {c: round(rng.random(), 6) for c in range(12)}
    probs = spark.createDataFrame([(1, c, v) for c, v in p.items()], "id int, class_id long, prob double")
    e = spark.createDataFrame(edges, "child long, parent long")
    assert {r["class_id"]: r["prob"] for r in dag.soft_propagate(probs, e, "id").collect()} == naive_soft(p, edges)


def test_hard_bridges_missing_classes_soft_does_not(spark):
    e = spark.createDataFrame([("c", "b"), ("b", "a")], "child string, parent string")
    labels = spark.createDataFrame([(1, "c", 1), (1, "a", 0)], "id int, class_id string, label int")
    columns = spark.createDataFrame([("a",), ("c",)], "node string")
    assert {(r["class_id"], r["label"]) for r in dag.hard_propagate(labels, dag.closure(e), "id", columns=columns).collect()} == {("a", 1), ("c", 1)}
    probs = spark.createDataFrame([(1, "c", 0.9), (1, "a", 0.1)], "id int, class_id string, prob double")
    assert {(r["class_id"], r["prob"]) for r in dag.soft_propagate(probs, e, "id").collect()} == {("a", 0.1), ("c", 0.9)}


def test_cycles_raise(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    with pytest.raises(ValueError, match="cycle"):
        dag.closure(e)


def test_threshold_branches(spark):
    rng = random.Random(1)
    rows = [("none", rng.random(), 0) for _ in range(30)] + [("few", i / 20, int(i > 15)) for i in range(20)] + [("many", i / 100, int(i >= 40)) for i in range(100)]
    df = spark.createDataFrame(rows, "class_id string, prob double, label int")
    t = {r["class_id"]: r["threshold"] for r in metrics.tuned_thresholds(df).collect()}
    assert t["none"] == 0.5 and t["few"] == 0.8 and 0.39 < t["many"] <= 0.4
    grid = {r["class_id"]: r["threshold"] for r in metrics.grid_thresholds(df).collect()}
    for c in ("few", "many", "none"):
        best = (-1.0, 0.0)
        for i in range(50):
            at = 0.05 + i * (0.95 - 0.05) / 49
            tp = sum(y and p >= at for k, p, y in rows if k == c)
            fp, fn = sum((not y) and p >= at for k, p, y in rows if k == c), sum(y and p < at for k, p, y in rows if k == c)
            f1 = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
            if f1 > best[0]:
                best = (f1, at)
        assert grid[c] == pytest.approx(best[1])


def test_group_split_keeps_groups_together(spark):
    df = spark.createDataFrame([(i, f"g{i % 11}") for i in range(100)], "id int, g string")
    rows = split.group_split(df, "g").collect()
    assert len(rows) == 33 and all(sum(r["is_val"] for r in rows if r["fold"] == f) == 3 for f in range(3))


def test_packing_against_loops(spark):
    rng = random.Random(2)
    sizes = [rng.randint(1, 60) for _ in range(40)]
    df = spark.createDataFrame([("g", i, s, s // 3) for i, s in enumerate(sizes)], "g string, i int, size long, short long")
    used, prefix, skip, used2 = 0, [], [], 0
    for i, s in enumerate(sizes):
        if used + s > 200:
            break
        used += s
        prefix.append(i)
    for i, s in enumerate(sizes):
        if used2 + s <= 200:
            used2 += s
            skip.append(i)
    assert [r["i"] for r in pack.pack_prefix(df, ["g"], ["i"], "size", 200).orderBy("i").collect()] == prefix
    assert [r["i"] for r in pack.pack_skip(df, ["g"], ["i"], ["i"], "size", 200).orderBy("pos").collect()] == skip
    sub = pack.pack_prefix_with_substitute(df, ["g"], ["i"], "size", "short", 200, least=0).orderBy("i").collect()
    assert [r["i"] for r in sub if not r["substituted"]] == prefix and [r["i"] for r in sub if r["substituted"]] in ([], [len(prefix)])


def test_text_functions(spark):
    df = spark.createDataFrame([("Über_x A1 _b\n2nd line\n3", None)], "t string, n string")
    r = df.select(text.code_tokens("t"), text.code_tokens("n"), text.alnum_tokens("t"), text.last_lines("t", 2), text.first_lines("t", 9), text.strip(F.lit("  a  "))).first()
    assert r[0] == ["ber_x", "a1", "_b", "nd", "line"] and r[1] == []
    assert r[2] == ["über", "x", "a1", "b", "2nd", "line", "3"] and r[3] == "2nd line\n3" and r[4].endswith("3") and r[5] == "a"


def test_resolution_join_prefers_exact_then_scan_order(spark):
    files = spark.createDataFrame([("r", "x/foo.py", 0), ("r", "barfoo.py", 1), ("r", "foo/__init__.py", 2)], "repo string, path string, ord int")
    asked = spark.createDataFrame([("r", 1, ["foo.py", "foo/__init__.py"]), ("r", 2, ["oo.py"]), ("r", 3, ["zzz.py"]), ("q", 4, ["foo.py"])], "repo string, k int, candidates array<string>")
    found = {r["k"]: (r["path"], r["how"]) for r in resolve.resolve(asked, files, ["repo"], ["k"]).collect()}
    assert found == {1: ("foo/__init__.py", "exact"), 2: ("x/foo.py", "suffix")}


def test_signals():
    y = np.linspace(0, 5, 40)
    gaps = y.copy()
    gaps[[5, 6, 20]] = np.nan
    assert np.allclose(signal.pchip_fill(gaps), y)
    assert np.allclose(signal.savgol(y**3), y**3)
    assert np.allclose(signal.als_baseline(y), y, atol=1e-6)
    bumps = y + np.where(np.arange(40) % 10 == 5, 3.0, 0)
    z = signal.als_baseline(bumps, lam=1e3)
    assert np.abs(z - y)[3:-3].max() < 1
    diag, o1, o2 = np.full(6, 6.0), np.full(6, -2.0), np.full(6, 0.5)
    dense = np.diag(diag) + sum(np.diag(o[: 6 - k], s * k) for k, o in ((1, o1), (2, o2)) for s in (1, -1))
    assert np.allclose(signal._penta_solve(diag, o1, o2, np.arange(6.0)), np.linalg.solve(dense, np.arange(6.0)))
    assert signal.savgol(np.ones(3)).tolist() == [1, 1, 1] and signal.pchip_fill(np.array([np.nan])).tolist() == [0]


def test_signal_expressions(spark):
    df = spark.createDataFrame([([1.0, 3.0, 5.0],), ([2.0],), ([],)], "a array<double>")
    got = [r[0] for r in df.select(signal.resample("a", 5)).collect()]
    assert got == [[1, 2, 3, 4, 5], [2] * 5, None]
    mv = df.select(signal.to_millivolts(F.array(*map(F.lit, [1.0, 2.0, 3.0, 4.0, 10.0])), F.lit(29.7)), signal.to_millivolts("a", F.lit(1)), signal.lead_name(F.lit("lead_avr"))).first()
    assert mv[0] == pytest.approx([-2, -1, 0, 1, 7]) and mv[1] == [0, 0, 0] and mv[2] == "AVR"


def test_rasters(spark):
    rng = np.random.default_rng(0)
    image = rng.integers(0, 255, (13, 17)).astype(np.uint8)
    assert (raster.read_png(raster.write_png(image)) == image).all()
    assert np.allclose(raster.resize_area(np.full((8, 6), 3.0), 5, 4), 3)
    assert raster.resize_area(np.arange(16.0).reshape(4, 4), 2, 2).tolist() == [[2.5, 4.5], [10.5, 12.5]]
    tilted = np.zeros((100, 100), int)
    for x in range(100):
        tilted[np.clip([30 + round(x * 0.1), 60 + round(x * 0.1)], 0, 99), x] = 1
    angle = raster.deskew_angle(tilted)
    assert 5 < angle < 6.5 and abs(raster.deskew_angle(raster.rotate_nearest(tilted, angle))) < 1
    df = spark.createDataFrame([(1, [[0, 9], [9, 0]])], "id int, im array<array<int>>")
    assert df.select(raster.flip(raster.flip(F.col("im")))).first()[0] == [[0, 9], [9, 0]]
    patch = raster.lead_patches(df.select("id", raster.resize_nearest(F.col("im"), 16, 16).alias("im")), "id", "im").first()
    assert patch["patch"] == []  # the margin is 0
    t = raster.trace(raster.column_envelope(df, ["id"], "im"), ["id"], least=1).first()
    assert t["signal"] == [1.0, 2.0] and raster.trace(raster.column_envelope(df, ["id"], "im"), ["id"]).first()["signal"] == [0.0] * 1250


def test_readers_and_writers(spark, tmp_path):
    src = tmp_path / "repo" / "a"
    src.mkdir(parents=True)
    (src / "x.py").write_bytes(b"a = 1\r\nb = 2\r\n")
    (src / "bad.py").write_bytes(b"\xff\xfe = 1\n")
    (src / "y.kt").write_text("fun x() {}")
    root = f"file://{tmp_path}/repo"
    files = {r["path"]: r["content"] for r in readers.repository(spark, root).collect()}
    assert files["a/x.py"] == "a = 1\nb = 2\n" and "�" in files["a/bad.py"] and len(files) == 2
    assert readers.repository(spark, root, strict=True, least_lines=2).count() == 1
    assert readers.repository(spark, root, "kotlin").count() == 1
    with pytest.raises(ValueError, match="language"):
        readers.repository(spark, root, "cobol")
    (tmp_path / "o.obo").write_text("[Term]\nid: class_2\nis_a: class_1\n\n[Term]\nid: OTHER:9\nis_a: class_1\n[Term]\nid: class_3\nis_a: class_2 ! a name\n")
    assert [(r["child"], r["parent"]) for r in readers.obo(spark, f"file://{tmp_path}/o.obo").orderBy("pos").collect()] == [("class_2", "class_1"), ("class_2", "class_1"), ("class_3", "class_2 ! a name")]
    (tmp_path / "img").mkdir()
    (tmp_path / "img/1.png").write_bytes(raster.write_png(np.array([[0, 255]])))
    (tmp_path / "img/2.png").write_bytes(b"broken")
    (tmp_path / "reg.csv").write_text("record_id,png_path,split\nr1,img/1.png,test\nr2,img/2.png,test\nr3,img/3.png,train\n")
    reg = readers.registry(spark, f"file://{tmp_path}/reg.csv", "test")
    shown = {r["record_id"]: r for r in readers.images(spark, reg, f"file://{tmp_path}/img").collect()}
    assert shown["r1"]["image"] == [[0, 255]] and shown["r2"]["error"]
    assert tuple(writers.outcome_counts(readers.images(spark, reg, f"file://{tmp_path}/img")).first()) == (2, 1, 1)
    with pytest.raises(ValueError, match="no rows"):
        readers.registry(spark, f"file://{tmp_path}/reg.csv", "none")
    df = spark.createDataFrame([(2, None, "b"), (1, "x", "a")], "i int, p string, c string")
    writers.json_lines(df, f"{tmp_path}/j")
    assert "p" not in [x for f in (tmp_path / "j").glob("part*") for x in f.read_text().splitlines() if '"i":2' in x][0]
    writers.sorted_csv(df, ["i"], f"{tmp_path}/c")
    assert readers.csv(spark, f"{tmp_path}/c", "i int, p string, c string").count() == 2
    writers.parquet_like(df, ["c", "i"], f"{tmp_path}/p")
    assert readers.parquet_columns(spark, f"{tmp_path}/p") == ["c", "i"]
    assert readers.class_columns(["class_10", "x", "class_2", "class_0"]) == ["class_2", "class_10"]
    (tmp_path / "t.txt").write_text("0.35\n")
    assert readers.threshold_override(spark, f"file://{tmp_path}/t.txt", 0.5) == 0.35 and readers.threshold_override(spark, f"file://{tmp_path}/no.txt", 0.5) == 0.5


def test_archives_within_archives(spark, tmp_path):
    import io
    import zipfile

    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a/x.py", "x = 1\r\n")
        z.writestr("a/x.txt", "no")
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("repo.zip", inner.getvalue())
        z.writestr("top.py", "y = 2")
    (tmp_path / "bad.zip").write_bytes(b"broken")
    rows = readers.archives(spark, f"file://{tmp_path}").collect()
    assert sorted((r["path"], r["content"]) for r in rows if r["error"] is None) == [("repo/a/x.py", "x = 1\n"), ("top.py", "y = 2")]
    assert len([r for r in rows if r["error"]]) == 1


def test_stream_gives_the_batch_result(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    late = events.selectExpr("max(ts) + interval 60 days as ts").crossJoin(events.limit(1).drop("ts")).select(*events.columns)
    stream = streamed.stream_files(spark, f"{tmp_path}/in", events.schema, 1)
    streamed.run_once(streamed.windowed(stream, "ts", ["event_type"], "value", late="60 days"), f"{tmp_path}/out", f"{tmp_path}/state")
    late.write.mode("append").parquet(f"{tmp_path}/in")
    late.write.mode("append").parquet(f"{tmp_path}/in")
    stream = streamed.stream_files(spark, f"{tmp_path}/in", events.schema, 1)
    streamed.run_once(streamed.windowed(stream, "ts", ["event_type"], "value", late="60 days"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out")
    want = {(r["start"], r["event_type"]): r["n"] for r in streamed.windowed(events, "ts", ["event_type"], "value").collect()}
    rows = {(r["start"], r["event_type"]): r["n"] for r in got.collect()}
    assert rows and all(want[k] == n for k, n in rows.items())


def test_default_features(spark):
    df = spark.createDataFrame([("CC(=O)O",), ("",)], "smiles string")
    got = df.select(models.gram_counts("smiles", bins=32), "smiles").collect()
    assert sum(got[0][0]) == 5 and len(got[0][0]) == 32
    assert [r[0] for r in models.scaffold_key(df, "smiles").select("scaffold").collect()] == ["CCO", ""]


def test_packed_texts_are_joined_to_admitted_rows_only(spark):
    rows = [("a", 1, "x" * 90), ("a", 2, "y" * 30), ("a", 2, "z" * 30), ("a", 3, "w" * 5), ("a", 3, "w" * 5), ("a", 4, None), (None, 1, "v" * 100), (None, 2, "u" * 101)]
    df = spark.createDataFrame(rows, "g string, i int, text string").withColumn("size", F.length("text"))
    found = pack.pack_skip(df, ["g"], ["i"], ["i", "text"], "size", 100)
    assert sorted((r["g"] or "", r["i"], r["text"][0]) for r in found.collect()) == [("", 1, "v"), ("a", 1, "x"), ("a", 3, "w"), ("a", 3, "w")]
    assert found.columns == ["g", "pos", "i", "text", "size"]


def test_curve_threshold_is_the_one_of_a_loop(spark):
    import random

    rng = random.Random(5)
    rows = [(c, round(rng.random(), 3) if c else 0.5, int(rng.random() < 0.03 * c)) for c in range(4) for _ in range(400)]
    df = spark.createDataFrame(rows, "class_id int, prob double, label int")

    def best(mine):
        total, found = sum(y for _, y in mine), []
        for t in sorted({p for p, _ in mine}):
            picked = [y for p, y in mine if p >= t]
            p, r = sum(picked) / len(picked), sum(picked) / total if total else 1.0
            found.append((-(2 * p * r / (p + r + 1e-8)), t))
        return min(0.95, max(0.05, min(found)[1]))

    got = {r["class_id"]: r["threshold"] for r in metrics.curve_thresholds(df).collect()}
    assert got == {c: best([(p, y) for k, p, y in rows if k == c]) for c in range(4)}


def test_images_of_one_key_share_an_envelope(spark):
    df = spark.createDataFrame([(1, [[0.0, 1.0], [0.0, 0.0]]), (1, [[0.0, 0.0], [1.0, 1.0]]), (2, []), (3, None)], "id int, im array<array<double>>")
    got = sorted(tuple(r) for r in raster.column_envelope(df, ["id"], "im").select("id", "x", "y_min", "y_max", "mid").collect())
    assert got == [(1, 0, 1, 1, 1.0), (1, 1, 0, 1, 1.5)]


def test_signals_of_one_length_are_solved_together():
    rng = np.random.default_rng(3)
    xs = [rng.normal(size=n) for n in (64, 30, 64, 2, 64)]
    for x, z in zip(xs, signal.by_length(xs, signal.als_baseline), strict=True):
        n = len(x)
        w, one = np.ones(n), np.zeros(n)
        if n > 2:
            d = np.diff(np.eye(n), 2, axis=0)
            for _ in range(10):
                one = np.linalg.solve(np.diag(w) + 1e5 * d.T @ d, w * x)
                w = 0.01 * (x > one) + 0.99 * (x < one)
        assert np.allclose(z, one, atol=1e-6)


def _png(pixels: np.ndarray, w: int, depth: int, colour: int, kinds: list[int], step: int, palette: bytes = b"") -> bytes:
    """pixels: the unfiltered bytes of the rows; a filter for each row."""
    import struct
    import zlib

    rows, above = b"", np.zeros(pixels.shape[1], int)
    for line, kind in zip(pixels.astype(int), kinds, strict=True):
        left, corner = (np.concatenate([np.zeros(step, int), v])[: len(v)] for v in (line, above))
        pa, pb, pc = abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))
        guess = [np.zeros_like(line), left, above, (left + above) // 2, paeth][kind]
        rows += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    chunk = lambda k, v: struct.pack(">I", len(v)) + k + v + struct.pack(">I", zlib.crc32(k + v))
    parts = chunk(b"IHDR", struct.pack(">IIBBBBB", w, len(pixels), depth, colour, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"")
    return b"\x89PNG\r\n\x1a\n" + parts + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_png_depths_colours_and_filters():
    rng = np.random.default_rng(4)
    grey = rng.integers(0, 256, (5, 7))
    assert (raster.read_png(_png(grey, 7, 8, 0, [0, 1, 2, 3, 4], 1)) == grey).all()
    colour = rng.integers(0, 256, (5, 7 * 3))
    luma = np.round(colour.reshape(5, 7, 3) @ np.array([0.299, 0.587, 0.114]))
    assert (raster.read_png(_png(colour, 7, 8, 2, [4, 3, 1, 2, 0], 3)) == luma).all()
    deep = rng.integers(0, 256, (5, 14))
    assert (raster.read_png(_png(deep, 7, 16, 0, [1, 4, 3, 2, 1], 2)) == deep[:, ::2]).all()
    bits = rng.integers(0, 2, (5, 7))
    packed = np.packbits(bits.astype(np.uint8), axis=1)
    assert (raster.read_png(_png(packed, 7, 1, 0, [0, 1, 2, 3, 4], 1)) == bits * 255).all()
    table = rng.integers(0, 256, (2, 3)).astype(np.uint8)
    assert (raster.read_png(_png(packed, 7, 1, 3, [0] * 5, 1, table.tobytes())) == np.round(table[bits] @ np.array([0.299, 0.587, 0.114]))).all()
