import numpy as np
import pytest

from tallylog.llm import op4_knn as m


def brute(rows, queries, k):
    ints = [(i, [int(np.floor(1024.0 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted(queries):
        v = min(x for i, x in ints if i == q)
        best = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i) for i, x in ints if i != q and i is not None and len(x) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best[:k])]
    return out


@pytest.mark.parametrize(("pivots", "chunk", "block"), [(64, 4096, 32768), (5, 7, 2), (1, 3, 1)])
def test_against_brute_force(spark, pivots, chunk, block):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(0, 0.2, 6)]) for i in range(150)]
    rows += [(200 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(80)]  # one vector many times
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, [2.0, 1.0]), (305, [1.0, 1.0]), (306, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ids = [0, 10, 200, 300, 303, 304, 140]
    got = sorted(tuple(x) for x in m.top_k(df, df.where(df.vec_id.isin(ids)), 10, pivots=pivots, chunk=chunk, block=block).collect())
    assert got == brute(rows, [0, 10, 140, 200, 304], 10)


def test_large_values_are_exact(spark):
    rows = [(0, [3e12, 1.0]), (1, [3e12, 1.0]), (2, [3e12, 2.0]), (3, [-3e12, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(x) for x in m.top_k(df, df.where("vec_id = 0"), 3).orderBy("rank").collect()]
    clip = (1 << 63) - 1
    assert [g[2] for g in got] == [1, 2, 3] and got[0][3] == clip and got[2][3] == -clip - 1


def test_repeated_ids_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (1, [1.0]), (None, [5.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in m.top_k(df, df.where("vec_id = 0")).collect())
    assert got == [(0, 1, None, 1024 * 5120), (0, 2, 1, 1024 * 1024)]
    assert m.top_k(df.limit(0), df.limit(0)).count() == 0


def test_chunks_go_only_where_they_are_needed(spark, monkeypatch):
    """Two far clusters: no query of one needs a cell of the other, so no chunk is copied there."""
    seen = []
    whole = m.written
    monkeypatch.setattr(m, "written", lambda df: seen.append(whole(df)) or seen[-1])
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(0, 0.01, 3) + ([5, 0, 0] if i % 2 else [0, 5, 0])]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in m.top_k(df, df.where("vec_id < 40"), 10, pivots=6, chunk=20, block=8).collect())
    assert got == brute(rows, range(40), 10)
    side = {int(x["cell"]): x["id"] % 2 for x in seen[0].toPandas().to_dict("records")}
    sides = {}
    for x in seen[-2].toPandas().to_dict("records"):
        sides.setdefault(x["block"], set()).add(x["id"] % 2)
    met = seen[-1].toPandas().to_dict("records")
    # A block meets the cells of its own queries' side; one block lies where the sides meet.
    assert 5 <= len(sides) <= 10 and len(met) and all(side[x["cell"]] in sides[x["block"]] for x in met) and sum(len(x) > 1 for x in sides.values()) <= 1


def test_cells_are_packed_into_blocks():
    pivots = np.array([[0.0, 0], [10, 0], [1, 0], [11, 0], [5, 0]])
    got = {c: (b, n) for c, b, n in m._laid_out({0: 3, 1: 4, 2: 2, 3: 25, 4: 9}, pivots, 10)}
    assert sorted(got) == [0, 1, 2, 3, 4] and got[0][0] == got[2][0] and got[3][1] == 3
    held = {}
    for c, n in {0: 3, 1: 4, 2: 2, 3: 25, 4: 9}.items():
        for k in range(got[c][1]):
            held[got[c][0] + k] = held.get(got[c][0] + k, 0) + -(-n // got[c][1])
    assert max(held.values()) <= 10


def test_many_lengths_and_extra_columns(spark):
    from pyspark.sql import functions as F

    rows = [(i, [float(1 + i % 5)] * (1 + i % 30)) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit(7).alias(c) for c in ("id", "v", "dim", "cell", "part", "home", "block")])
    got = sorted(tuple(x) for x in m.top_k(df, df.where("vec_id < 60"), 3).collect())
    assert got == brute(rows, range(60), 3)
