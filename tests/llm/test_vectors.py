"""Whitening, near copies of vectors and clustering against brute force, and on odd rows."""

import hashlib

import numpy as np
import pytest

from tabloom.llm import exact_spectrum, hadamard_clusters, projection_passes, whitening
from tabloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def vectors_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")


def turned(rng, x, cosine):
    """Unit vectors at the given cosine to the unit rows of *x*."""
    y = rng.standard_normal(x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cosine = np.asarray(cosine)[:, None]
    return cosine * x + np.sqrt(1 - cosine**2) * y


def brute_links(x, limit=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= limit
    np.fill_diagonal(near, False)
    return near


def brute_components(near, ids):
    root = dict(zip(range(len(ids)), ids))
    for start in np.argsort(ids):
        todo = [start] if root[start] == ids[start] else []
        while todo:
            k = todo.pop()
            for j in np.flatnonzero(near[k]):
                if root[j] > ids[start]:
                    root[j] = ids[start]
                    todo.append(j)
    return [root[k] for k in range(len(ids))]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """NULLs, empty, short, long, zero and non-finite vectors, repeats, and columns with clashing names."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((30, 64))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [rows[4], (40, rows[4][1]), (41, (2 * x[5]).tolist()), (None, rows[6][1]), (42, None), (43, []), (44, [0.0] * 64),
             (45, [1.0] * 63), (46, [1.0] * 65), (47, [float("nan")] + [1.0] * 63), (48, [None] + [1.0] * 63),
             (49, [float("inf")] + [1.0] * 63), (None, None), (7, (-x[7]).tolist())]
    return vectors_frame(spark, rows).selectExpr(
        "*", "1 as x", "2 as n", "3 as e", "'a' as h", "'b' as node", "4 as cluster", "5 as root", "6 as `a.b`")


def test_characteristic_polynomials_and_roots():
    m = np.array([[2, 1, 0], [1, 2, 0], [0, 0, 3]], dtype=object)
    assert exact_spectrum.characteristic_polynomial(m) == [-9, 15, -7, 1]
    assert [round(float(e), 12) for e, _ in exact_spectrum.eigenpairs(m, 3)] == [3, 3, 1]
    rng = np.random.default_rng(1)
    for rows, d in ((40, 9), (3, 6), (200, 16)):
        x = rng.integers(-50, 50, (rows, d)).astype(object)
        m = x.T @ x
        found = exact_spectrum.eigenpairs(m, d)
        true = np.linalg.eigvalsh(m.astype(float))[::-1][:min(rows, d)]
        assert len(found) == min(rows, d)  # eigenvalues of zero are no components
        np.testing.assert_allclose([float(e) for e, _ in found], true, rtol=1e-9)
        v = np.array([x for _, x in found])
        np.testing.assert_allclose(v @ v.T, np.eye(len(v)), atol=1e-12)
    poly = exact_spectrum.characteristic_polynomial(np.diag([10**30, 10**30, 1, 0]).astype(object))
    assert exact_spectrum.roots_above(poly, 0, 0) == 3 and exact_spectrum.roots_above(poly, 1, 0) == 2


def test_close_eigenvalues_keep_their_own_vectors():
    # a relative gap of 1e-20, out of reach of doubles
    a = 10**20
    m = np.array([[a, 1, 0], [1, a, 0], [0, 0, 5]], dtype=object)
    (big, v), (small, w), _ = exact_spectrum.eigenpairs(m, 3)
    assert int(big - small) == 2
    np.testing.assert_allclose(np.abs(v), [0.5**0.5, 0.5**0.5, 0], atol=1e-15)
    np.testing.assert_allclose(np.abs(w), [0.5**0.5, 0.5**0.5, 0], atol=1e-15)


def check_whitening(frame, count=16):
    got = whitening.whiten_vectors(frame).toPandas()
    rows = [(r.vec_id, r.embedding) for r in frame.collect()
            if r.embedding and len(r.embedding) == 64 and all(v is not None and np.isfinite(v) for v in r.embedding)]
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(0)
    values, basis = np.linalg.eigh(centred.T @ centred / len(fit))
    k = min(count, int((values > 1e-6).sum()))
    assert len(got) == len(rows) * k and (got.n == len(fit)).all() and got.identity_error.max() < 1e-9
    white = np.abs((x - fit.mean(0)) @ basis[:, ::-1][:, :k] / np.sqrt(values[::-1][:k]))
    deviation = ((len(fit) * x - fit.sum(0)) ** 2).sum(1)
    true = sorted((str(i), int(d), *np.round(w, 6) + 0.0) for (i, _), d, w in zip(rows, deviation, white))
    wide = got.groupby(got.index // k)
    mine = sorted(
        (str(int(g.vec_id.iloc[0])) if g.vec_id.notna().all() else "None", int(g.deviation.iloc[0]),
         *np.round(np.abs(g.sort_values("component").whitened.to_numpy()), 6) + 0.0) for _, g in wide)
    assert [a[:2] for a in mine] == [a[:2] for a in true]
    np.testing.assert_allclose(np.array([a[2:] for a in mine]), np.array([a[2:] for a in true]), atol=2e-5)
    explained = got.drop_duplicates("component").sort_values("component").explained.to_numpy()
    np.testing.assert_allclose(explained, values[::-1][:k] / values.sum(), rtol=1e-9)


def test_whitening(spark, odd_vectors):
    check_whitening(spark.read.parquet(f"{SF}/embeddings.parquet"))
    check_whitening(odd_vectors)
    check_whitening(odd_vectors.filter("vec_id < 5"))  # fewer components than 16
    assert whitening.whiten_vectors(odd_vectors.filter("vec_id = 4")).count() == 0  # one distinct vector
    assert whitening.whiten_vectors(odd_vectors.limit(0)).count() == 0


def test_whitening_of_large_entries(spark):
    rng = np.random.default_rng(8)
    x = np.floor(rng.standard_normal((40, 3)) * 2.0**40)
    got = whitening.whiten_vectors(vectors_frame(spark, [(k, v.tolist()) for k, v in enumerate(x)])).toPandas()
    whole = (64 * x).astype(object)
    assert got.identity_error.max() < 1e-9 and got.deviation.isna().all()  # beyond a long
    centred = (whole - whole.sum(0) / 40).astype(float)
    values, basis = np.linalg.eigh(centred.T @ centred / 40)
    first = np.abs(got[got.component == 1].sort_values("vec_id").whitened.to_numpy())
    np.testing.assert_allclose(first, np.abs(centred @ basis[:, -1] / values[-1] ** 0.5), rtol=1e-6, atol=1e-9)


def check_links(frame, ids, x, **options):
    got = {r.vec_id: r for r in projection_passes.near_vectors(frame, **options).collect()}
    near = brute_links(x)
    roots = brute_components(near, ids)
    share = np.mean([got[i].n_links == n and got[i].component_id == r and got[i].kept == (i == r)
                     for i, n, r in zip(ids.tolist(), near.sum(1), roots)])
    return share, sum(got[i].n_links for i in ids.tolist()) / max(1, near.sum())


@pytest.mark.parametrize("crowd", [300, 3_000])
def test_near_vectors_at_the_limit(spark, crowd):
    rng = np.random.default_rng(crowd)
    base = rng.standard_normal((crowd, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    pairs = turned(rng, base[:crowd // 3], rng.uniform(0.9501, 0.96, crowd // 3))
    below = turned(rng, base[crowd // 2:crowd // 2 + 50], np.full(50, 0.9499))
    x = np.concatenate((base, pairs, below))
    ids = rng.permutation(len(x))
    share, recall = check_links(vectors_frame(spark, [(int(i), v.tolist()) for i, v in zip(ids, x)]), ids, x)
    assert share >= 0.99 and 0.99 <= recall <= 1


@pytest.mark.parametrize("members", [400, 1_600])
def test_hot_group_of_near_vectors(spark, members):
    """A third within half the limit's angle of each other, a third around them at the limit, a third elsewhere."""
    rng = np.random.default_rng(members)
    hub = rng.standard_normal((1, 64))
    hub /= np.linalg.norm(hub)
    hubs = np.repeat(hub, members, 0)
    x = np.concatenate((hub, turned(rng, hubs, rng.uniform(0.99, 0.9999, members)),
                        turned(rng, hubs, rng.uniform(0.95, 0.97, members)), rng.standard_normal((members, 64))))
    ids = rng.permutation(len(x))
    frame = vectors_frame(spark, [(int(i), v.tolist()) for i, v in zip(ids, x)])
    share, recall = check_links(frame, ids, x, window=8, block=64, cell=100)
    assert share == 1 and recall == 1


def test_near_odd_vectors(odd_vectors):
    rows = projection_passes.near_vectors(odd_vectors).collect()
    assert len(rows) == odd_vectors.count()
    at = lambda i: sorted((r.n_links, r.component_id, r.kept) for r in rows if r.vec_id == i)
    assert at(4) == [(2, 4, True), (2, 4, True)] and at(40) == [(2, 4, False)]
    assert at(5) == [(1, 5, True)] and at(41) == [(1, 5, False)]
    assert at(6) == [(0, 6, True)]  # a copy without an id links with nothing
    assert at(None) == [(0, None, True), (0, None, True)]
    assert all(at(i) == [(0, i, True)] for i in range(42, 50))
    assert at(7) == [(0, 7, True), (0, 7, True)]
    assert projection_passes.near_vectors(odd_vectors.limit(0)).count() == 0


def test_passes_grow_slowly():
    few, many = projection_passes.passes_for(10**4, 0.95), projection_passes.passes_for(10**8, 0.95)
    assert few < many < 8 * few


def test_transform_keeps_distances():
    rng = np.random.default_rng(2)
    x, y = rng.integers(-900, 900, (50, 64)), rng.integers(-900, 900, (7, 64))
    tx, ty = hadamard_clusters.transform(x), hadamard_clusters.transform(y)
    true = ((x[:, None] - y[None]) ** 2).sum(2)
    assert (((tx[:, None] - ty[None]) ** 2).sum(2) == 64 * true).all()
    signs = np.sign(hadamard_clusters.transform(np.eye(64, dtype=np.int64)))
    assert ((np.diff(signs, axis=0) != 0).sum(0) == np.arange(64)).all()  # coarse to fine
    best, total, formed = hadamard_clusters.nearest_centroids(tx, ty)
    assert (best == true.argmin(1)).all() and (total == 64 * true.min(1)).all()
    best, total, _ = hadamard_clusters.nearest_centroids(tx.astype(object) * 2**40, ty.astype(object) * 2**40)
    assert (best == true.argmin(1)).all() and total[0] == 64 * int(true.min(1)[0]) * 2**80


def test_progressive_search_forms_fewer_differences():
    rng = np.random.default_rng(4)
    y = np.cumsum(rng.integers(-50, 50, (256, 64)), axis=1)  # smooth rows: coarse coefficients tell them apart
    x = y[rng.integers(0, 256, 400)] + rng.integers(-9, 9, (400, 64))
    best, _, formed = hadamard_clusters.nearest_centroids(hadamard_clusters.transform(x), hadamard_clusters.transform(y))
    assert (best == ((x[:, None] - y[None]) ** 2).sum(2).argmin(1)).all()
    assert formed < 0.2 * 400 * 256 * 64


def brute_clusters(rows):
    """Rows (id, whole-number vector) and, for each, cluster and distance after ten rounds, with the centroids."""
    digest = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centres = [list(r[1]) for r in sorted(rows, key=digest)[:8]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centres))

    for _ in range(10):
        own = [nearest(x)[1] for _, x in rows]
        for k in range(len(centres)):
            mine = [x for (_, x), j in zip(rows, own) if j == k]
            if mine:
                centres[k] = [sum(col) // len(mine) for col in zip(*mine)]
    return [nearest(x) for _, x in rows], centres


def test_clusters_of_odd_vectors(odd_vectors):
    kept = [(r.vec_id, [int(np.floor(1024 * v)) for v in r.embedding]) for r in odd_vectors.collect()
            if r.embedding and len(r.embedding) == 64 and all(v is not None and np.isfinite(v) for v in r.embedding)]
    true, centres = brute_clusters(kept)
    total = sum(d for d, _ in true)
    inertia = [sum(d for d, j in true if j == k) for k in range(8)]
    hashes = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in centres]
    want = sorted((str(i), k, d, inertia[k], total, hashes[k]) for (i, _), (d, k) in zip(kept, true))
    assert sorted((str(r[0]), *r[1:]) for r in hadamard_clusters.cluster_vectors(odd_vectors).collect()) == want
    assert hadamard_clusters.cluster_vectors(odd_vectors.limit(0)).count() == 0
    assert {r.distance for r in hadamard_clusters.cluster_vectors(odd_vectors.filter("vec_id < 3")).collect()} == {0}


@pytest.mark.parametrize("name", ["op11_exact_whitening", "op12_projection_passes"])
def test_queries_return_every_row(spark, name):
    rows = QUERIES[name](spark, SF)
    assert rows.select("vec_id").distinct().count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()
