import fractions

import numpy as np
import pytest

from tidewater.llm import neighbours as N


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        s = x.astype(np.float64) @ x[np.flatnonzero(ids == q)[0]].astype(np.float64)
        keep = ids != q
        out[q] = sorted(zip(-s[keep], ids[keep]))[:k]
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v], "clash") for i, v in zip(ids, x)], "vec_id long, embedding array<float>, codes string").repartition(3)


def results(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def check(spark, x, k=20):
    ids = np.arange(len(x))
    vectors = frame(spark, ids, x)
    got = results(N.search(N.build(vectors), vectors.filter("vec_id % 20 = 0"), k))
    want = brute(ids, x, range(0, len(x), 20), k)
    hits = 0
    for q, best in want.items():
        rows = got[q]
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
        assert all(abs(s - x[v].astype(np.float64) @ x[q].astype(np.float64)) < 1e-9 for _, v, s in rows)
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        hits += len({v for _, v, _ in rows} & {v for _, v in best})
    return hits / sum(map(len, want.values()))


def test_recall_on_unit_and_on_uneven_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    assert check(spark, x / np.linalg.norm(x, axis=1, keepdims=True)) > 0.9
    assert check(spark, x * rng.uniform(0.2, 2, (3000, 1)).astype(np.float32)) > 0.9


def test_a_third_of_copies_and_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[::3] = x[0]
    ids = np.arange(900)
    vectors = frame(spark, ids, x)
    got = results(N.search(N.build(vectors), vectors.filter("vec_id = 300")))
    best = got[300]
    copies = [r[1] for r in best if abs(r[2] - best[0][2]) < 1e-6]
    assert copies == [i for i in range(0, 900, 3) if i != 300][: len(copies)] and len(copies) == 20


def test_unusable_vectors_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [None, 1.0]), (100, [float("inf"), 1.0]), (7, [0.5, 0.5]), (7, [0.5, 0.5]), (120, [1.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = results(N.search(N.build(vectors), vectors.filter("vec_id % 20 = 0")))
    assert set(got) == {0} and [r[1] for r in got[0]] == [7, 7]
    assert N.build(spark.createDataFrame([], "vec_id long, embedding array<float>")) is None


def test_recall_with_very_long_vectors_and_lognormal_lengths(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    one, several = x.copy(), x.copy()
    one[77] *= 100
    several[:60] *= 100
    lognormal = x * rng.lognormal(0, 1, (3000, 1)).astype(np.float32)
    for vectors in (one, several, lognormal):
        assert check(spark, vectors) > 0.9
    monkeypatch.setattr(N, "WHOLE", 50)
    for vectors in (one, lognormal):
        assert check(spark, vectors) > 0.9


def cone(rng, n=3000, opposite=15):
    """Unit vectors about one axis, and a few that point the other way, as queries."""
    x = rng.normal(size=(n, 64)) * 0.05
    x[:, 0] += 1
    x[: 20 * opposite : 20, 0] -= 2
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_every_query_has_its_results(spark, tmp_path):
    rng = np.random.default_rng(4)
    for n in (2, 15, 40):
        x = rng.normal(size=(n, 64)).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ids = 20 * np.arange(n)
        frame(spark, ids, x).write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        got = results(N.op6_nearest_neighbours(spark, f"{tmp_path}/{n}"))
        want = brute(ids, x, ids, 20)
        assert {q: [v for _, v, _ in rows] for q, rows in got.items()} == {q: [v for _, v in rows] for q, rows in want.items()}


def test_queries_away_from_all_rows(spark, tmp_path):
    x = cone(np.random.default_rng(5))
    ids = np.arange(len(x))
    frame(spark, ids, x).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = results(N.op6_nearest_neighbours(spark, str(tmp_path)))
    want = brute(ids, x, range(0, 300, 20), 20)
    assert all(len(rows) == 20 for rows in got.values()) and len(got) == 150
    hits = sum(len({v for _, v, _ in got[q]} & {v for _, v in best}) for q, best in want.items())
    assert hits / 300 > 0.9


def test_every_width_is_searched(spark):
    rng = np.random.default_rng(6)
    sets = {16: np.arange(0, 90, 3), 7: np.arange(1, 90, 3), 1: np.arange(2, 30, 3)}
    rows = {w: (ids, rng.normal(size=(len(ids), w)).astype(np.float32)) for w, ids in sets.items()}
    frames = [frame(spark, *x) for x in rows.values()]
    vectors = frames[0].unionByName(frames[1]).unionByName(frames[2])
    got = results(N.search(N.build(vectors), vectors))
    for ids, x in rows.values():
        for q, best in brute(ids, x, ids, 20).items():
            assert [v for _, v, _ in got[q]] == [v for _, v in best]


def test_rotations_by_matrix_and_by_transform_agree(monkeypatch):
    x = np.random.default_rng(7).normal(size=(40, 12))
    one = N.Rotations(12, 5)
    monkeypatch.setattr(N.Rotations, "NARROW", 0)
    other = N.Rotations(12, 5)
    assert other.matrix is None and np.allclose(one(x), other(x), atol=1e-4)
    assert np.allclose((one(x) ** 2).sum(axis=2), (x**2).sum(axis=1)[:, None], rtol=1e-4)


def test_candidates_are_the_rows_of_probed_buckets(monkeypatch):
    """Lookup among sorted buckets against every row's bucket tried with every probe."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 16))
    x[::3] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked = x[:40] + rng.normal(size=(40, 16)) * 0.1
    for listed in (N.LISTED, 0):
        monkeypatch.setattr(N, "LISTED", listed)
        band = N.Band(16, 0, 500, None, 0.9)
        turn = band.rotations()
        codes = turn.buckets(x)
        want = np.zeros((40, 500), bool)
        for t, query, bucket in turn.probes(band.unit(asked), 0.9):
            for q, b in zip(query, bucket):
                want[q] |= codes[:, t] == b
        got = N.Cell(band, np.arange(500), x, codes).candidates(asked)
        assert (got == want).all() and 0 < want.mean() < 1


def test_doubles_keep_their_digits(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(50, 8))
    for kind in ("array<double>", "array<decimal(20,10)>"):
        vectors = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").selectExpr("vec_id", f"cast(embedding as {kind}) as embedding")
        got = results(N.search(N.build(vectors), vectors.filter("vec_id = 0")))
        for _, v, s in got[0]:
            assert abs(s - x[v] @ x[0]) < (1e-14 if "double" in kind else 1e-8)


def test_cells_of_any_size_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = frame(spark, np.arange(1500), x)
    index = N.build(vectors)
    first = results(N.search(index, vectors.filter("vec_id % 20 = 0")))
    monkeypatch.setattr(N, "ROW_NUMBERS", 16 * 200)
    monkeypatch.setattr(N, "QUERY_NUMBERS", 16 * 30)
    assert results(N.search(index, vectors.filter("vec_id % 20 = 0"))) == first


@pytest.mark.parametrize("length", [1e200, 1e-170, 1.7e308, 5e-324])
def test_longest_and_shortest_doubles(spark, length):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 6))
    x = x / np.abs(x).max(axis=1, keepdims=True) * length if length > 1e-300 else np.where(x > 0, length, 0.0)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 + i, rng.normal(size=6).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = N.search(N.build(df), df.filter("vec_id % 20 = 0"), 20).collect()
    asked = {i for i, v in rows if i % 20 == 0 and any(v)}
    assert {r["query_id"] for r in got} == asked and not any(np.isnan(r["score"]) for r in got)
    exact = lambda a, b: sum(fractions.Fraction(p) * fractions.Fraction(q) for p, q in zip(a, b, strict=True))
    vectors = dict(rows)
    usable = [i for i, v in rows if any(v)]
    for q in asked:
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in mine] == list(range(1, 21))
        for _, i, score in mine:
            want = exact(vectors[q], vectors[i])
            shown = float(want) if abs(want) < 1e308 else np.inf if want > 0 else -np.inf
            assert score == pytest.approx(shown, rel=1e-9, abs=1e-300) or abs(want) > 1e308
        best = sorted((exact(vectors[q], vectors[i]) for i in usable if i != q), reverse=True)[0]
        assert mine[0][2] == pytest.approx(float(best), rel=1e-9, abs=1e-300) if abs(best) < 1e308 else mine[0][2] > 1e300
