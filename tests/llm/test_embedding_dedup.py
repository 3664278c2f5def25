import numpy as np
import pytest

from tessera.llm import embedding_dedup as ed


def brute(rows, threshold=0.98):
    ok = lambda i, v, c: i is not None and c is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    nodes = sorted({(i, tuple(v), c) for i, v, c, *_ in rows if ok(i, v, c)})
    links, join = {}, {}
    for i, v, c in nodes:
        for j, w, d in nodes:
            if (i, v, c) != (j, w, d) and c == d and len(v) == len(w):
                x, y = np.array(v), np.array(w)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] = links.get(i, 0) + 1
                    join.setdefault(i, set()).add(j)
    out = []
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in join.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp = min(seen) if i is not None else None
        out.append((i, links.get(i, 0), comp, i is not None and comp == i))
    return sorted(out, key=str)


@pytest.mark.parametrize("dim,slab", [(2, 1500), (64, 40), (64, 1500)])
def test_against_brute_force(spark, monkeypatch, dim, slab):
    monkeypatch.setattr(ed, "SLAB", slab)
    rng = np.random.default_rng(dim + slab)
    base = rng.standard_normal((60, dim))
    near = base[rng.integers(0, 60, 150)] * rng.uniform(0.1, 9, (150, 1)) + rng.standard_normal((150, dim)) * 0.1
    vecs = np.concatenate((base, near, near[:20]))
    rows = [(i, v.tolist(), int(rng.integers(0, 3)), "c") for i, v in enumerate(vecs)]
    rows += [(900, None, 1, "c"), (901, [0.0] * dim, 1, "c"), (902, [1.0, None], 1, "c"), (903, [float("nan")] * dim, 1, "c"), (904, vecs[0].tolist(), None, "c"), (905, [], 1, "c"), (None, vecs[0].tolist(), 1, "c"), (906, [1.0] * (dim + 1), 1, "c"), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string")
    assert sorted((tuple(r) for r in ed.near_duplicates(df).collect()), key=str) == brute(rows)


def test_recall_of_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    a = ed._unit([v.tobytes() for v in rng.standard_normal((3000, 64))])
    d = rng.standard_normal((3000, 64))
    d -= (d * a).sum(axis=1, keepdims=True) * a
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    b = 0.9801 * a + np.sqrt(1 - 0.9801**2) * d
    half, reach, least = ed.window(64, 0.98)
    p, q = a @ ed.directions(64).T, b @ ed.directions(64).T
    found = ((np.abs(p - q) <= half).sum(axis=1) >= least) & (np.abs(p - q) <= reach).all(axis=1)
    assert found.mean() > 0.998


def test_empty(spark):
    assert ed.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_hot_label_beside_others_and_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(ed, "SLAB", 50)
    rng = np.random.default_rng(3)
    far = rng.standard_normal((200, 64)) + 5 * np.eye(64)[0]  # a label that lies elsewhere
    rows = [(i, v.tolist(), int(i % 9 == 0)) for i, v in enumerate(np.concatenate((rng.standard_normal((100, 64)), far, far[:30] + 1e-3)))]
    rows += [(1000 + i, far[7].tolist(), 0) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted((tuple(r) for r in ed.near_duplicates(df).collect()), key=str) == brute(rows)
