import numpy as np
import pytest

from chatlens.llm.pivots import choose_pivots, drop_near_duplicates, heads, linked, op11_embedding_near_dedup, pair_links, shared_counts, unit

from conftest import SF001


def brute(rows, threshold=0.95):
    """{place: (links, component)} by comparing all vectors."""
    def fit(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    link = [set() for _ in range(n)]
    by = {}
    for k, (_, v) in enumerate(rows):
        if fit(v):
            by.setdefault(len(v), []).append(k)
    for ks in by.values():
        x = np.array([rows[k][1] for k in ks], dtype=float)
        x /= np.abs(x).max(axis=1)[:, None]
        x /= np.linalg.norm(x, axis=1)[:, None]
        for p, q in zip(*np.nonzero(x @ x.T >= threshold)):
            if p != q:
                link[ks[p]].add(ks[q])
    out, seen = {}, set()
    for k in range(n):
        if k in seen:
            continue
        part, todo = {k}, [k]
        while todo:
            for j in link[todo.pop()] - part:
                part.add(j)
                todo.append(j)
        seen |= part
        ids = [rows[j][0] for j in part if rows[j][0] is not None]
        for j in part:
            out[j] = (len(link[j]), min(ids) if ids else None)
    return out


def check(df, rows, **options):
    got = linked(df, **options).collect()
    key = lambda v, e: (str(v), str(e))
    want = brute(rows, options.get("threshold", 0.95))
    assert sorted((key(r["vec_id"], r["row"]["embedding"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == sorted(
        (key(*rows[k]), n, str(c), rows[k][0] == c) for k, (n, c) in want.items())


def clustered(rng, n, dim, copies=0.3):
    x = rng.normal(size=(n, dim))
    for k in range(1, n):
        if rng.random() < copies:
            x[k] = x[rng.integers(0, k)] + rng.normal(size=dim) * rng.choice([0, 0.1, 0.2, 0.3])
    return x


@pytest.mark.parametrize("dim,block", [(2, 16), (16, 256), (64, 32)])
def test_all_links_of_clustered_vectors(spark, dim, block):
    rng = np.random.default_rng(dim)
    rows = [(int(k), [float(v) for v in x]) for k, x in enumerate(clustered(rng, 400, dim))]
    rows += [(1000 + k, rows[7][1]) for k in range(60)]  # copies
    near = unit(np.array([rows[11][1]]) + rng.normal(size=(80, dim)) * 0.02)
    rows += [(2000 + k, [float(v) for v in x]) for k, x in enumerate(near)]
    check(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), rows, block=block)


def test_edges(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]),
            (None, [1.0, 2.0]), (9, [1.0, 2.0, 0.0]), (10, [-1.0, -2.0]), (7, [1.0, 2.0]), (7, [5.0, -1.0]), (11, [1e300, 2e300]), (12, [1e-300, 2e-300]), (None, [0.0, 1.0, 9.0])]
    check(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows)
    check(spark.createDataFrame([], "vec_id long, embedding array<double>"), [])


def test_rows_kept_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], "a", 5), (2, [1.0, 0.01], "b", 6), (3, [0.0, 1.0], "c", 7)]
    got = drop_near_duplicates(spark.createDataFrame(rows, "vec_id int, embedding array<float>, KEPT string, n_links int"))
    assert got.columns == ["vec_id", "embedding", "KEPT", "n_links", "component_id"]
    assert sorted((r["vec_id"], r["KEPT"], r["n_links"], r["component_id"]) for r in got.collect()) == [(1, "a", 1, 1), (3, "c", 0, 3)]


@pytest.mark.parametrize("dim", [16, 64])
def test_recall_at_the_threshold(spark, dim):
    """Pairs of a cosine between 0.95 and 0.96 only, the hardest there are, among 3,000 vectors."""
    rng = np.random.default_rng(9)
    x = unit(rng.normal(size=(2000, dim)))
    away = rng.normal(size=(1000, dim))
    away = unit(away - (away * x[:1000]).sum(axis=1)[:, None] * x[:1000])
    c = rng.uniform(0.9501, 0.96, 1000)[:, None]
    rows = [(int(k), [float(v) for v in y]) for k, y in enumerate(np.concatenate([x, c * x[:1000] + np.sqrt(1 - c * c) * away]))]
    want = sum(n for n, _ in brute(rows).values())
    found = sum(r["n_links"] for r in linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert 0.97 * want <= found <= want


def test_query_links_what_brute_force_links(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op11_embedding_near_dedup(spark, SF001).collect()}
    assert got == {rows[k][0]: v for k, v in want.items()}


def test_links_are_stars_and_counts(spark):
    """A group of n vectors that are all linked writes about n rows, not n * n."""
    rng = np.random.default_rng(2)
    x = unit(np.ones((300, 8)) + rng.normal(size=(300, 8)) * 0.01)
    classes = spark.createDataFrame([(k, [float(v) for v in y], 1) for k, y in enumerate(x)], "cid long, v array<double>, copies long")
    got = pair_links(classes, block=64).collect()
    assert len(got) < 300 * 8 * 10
    assert sum(r["n"] for r in got) == 300 * 299


def test_parts_of_the_index():
    rng = np.random.default_rng(4)
    x = unit(rng.normal(size=(50, 6)))
    pivots = choose_pivots(np.concatenate([x, x + 1e-6]), 80, 0.95)
    assert len(pivots) <= 50 and np.tril(pivots @ pivots.T, -1).max() < 0.95
    h = heads(x, pivots, 4)
    assert (h == np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :4]).all()
    assert (shared_counts(h, h[:9]) == np.array([[len(set(p) & set(q)) for q in h[:9]] for p in h])).all()
