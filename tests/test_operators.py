"""Small hand-made cases, invariants and plans."""

import importlib
import inspect
import math
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowmill import catalog
from sparrowmill.functions import ratio_round
from sparrowmill.operators import als, reco
from sparrowmill.plans import ntile_distributed, pushed
from sparrowmill.sources import io, retail
from sparrowmill.streaming import events as live


def test_ratio_round(spark):
    df = spark.createDataFrame([(1, 8), (-1, 8), (5, 0), (1, 3)], "a long, b long")
    assert [r[0] for r in df.select(ratio_round(F.col("a"), F.col("b"), 2)).collect()] == [0.13, -0.13, None, 0.33]


def test_rollup_invariants(spark, data):
    rows = catalog.queries()["geo_revenue_rollup_exact"](spark, data).collect()
    sub = [r for r in rows if r["row_type"] == "country_subtotal"]
    total = next(r for r in rows if r["row_type"] == "grand_total")
    assert sum(r["orders"] for r in sub) == total["orders"]
    assert math.isclose(sum(r["gmv"] for r in sub), total["gmv"])
    assert {r["gmv_share_in_country_pct"] for r in sub} == {50.0}


def test_cohorts_are_complete(spark, data):
    rows = catalog.queries()["cohort_retention"](spark, data).collect()
    per = {}
    for r in rows:
        per.setdefault(r["cohort_month"], []).append(r)
    assert all(len(v) == 7 for v in per.values())
    assert sum(v[0]["cohort_size"] for v in per.values()) == 150


@pytest.mark.parametrize("n", [0, 1, 4, 5, 13])
def test_ntile(spark, n):
    df = spark.range(n).withColumn("x", F.col("id") % 3)
    got = sorted(r["tile"] for r in ntile_distributed(df, 5, "x", "id").collect())
    q, r = divmod(n, 5)
    assert got == sorted(t for k in range(5) for t in [k + 1] * (q + (k < r)))


def test_filters_reach_the_scan(spark, data):
    plan = pushed(retail.orders(spark, data).where("user_id > 10").select("order_id"))
    assert "GreaterThan(o_custkey,10)" in plan and "o_orderpriority" not in plan


def test_metrics(spark):
    recs = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 9, 1)], "user long, item long, rank long")
    test = spark.createDataFrame([(1, 2), (1, 9), (3, 1)], "user long, item long")
    m = {r["user"]: r for r in reco.user_metrics(recs, test, "user", "item", (3,)).collect()}
    assert set(m) == {1, 3}
    assert m[1]["precision_3"] == 1 / 3 and m[1]["recall_3"] == 0.5 and m[1]["map_3"] == 0.25 and m[1]["mrr"] == 0.5 and m[1]["hr_3"] == 1.0
    assert math.isclose(m[1]["ndcg_3"], (1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert m[3]["mrr"] == 0.0 and m[3]["ndcg_3"] == 0.0


def test_random_items_come_from_the_whole_catalogue(spark):
    n_items = 5000
    rows = [(u, i) for i in range(n_items) for u in [1000 + i % 50]] + [(u, i) for u in range(400) for i in (u, u + 1)]
    train = spark.createDataFrame(rows, "user_id long, item_id long")
    got = {}
    for r in reco.random_items(train, "user_id", "item_id", 10).collect():
        got.setdefault(r["user_id"], []).append((r["rank"], r["item_id"]))
    seen = set(rows)
    assert len(got) == 450 and all([k for k, _ in sorted(v)] == list(range(1, 11)) for v in got.values())
    assert not any((u, i) in seen for u, v in got.items() for _, i in v)
    drawn = {i for v in got.values() for _, i in v}
    assert len(drawn) > 2500  # 4,500 draws from 5,000 items; one pool for all users would hold 110
    few = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3)], "user_id long, item_id long")
    assert sorted((r["user_id"], r["item_id"]) for r in reco.random_items(few, "user_id", "item_id", 10).collect()) == [(1, 3), (2, 2)]


def test_split_is_disjoint(spark, data):
    r = catalog.queries()["leak_check"](spark, data).first()
    assert (r["train_val"], r["train_test"], r["val_test"]) == (0, 0, 0)


def test_kcore_reaches_its_fixpoint(spark):
    rows = [(u, i) for u in range(4) for i in range(4)] + [(9, 0), (0, 8)]
    got = reco.kcore(spark.createDataFrame(rows, "u long, i long"), "u", "i", 3, 3)
    assert {tuple(r) for r in got.collect()} == {(u, i) for u in range(4) for i in range(4)}


@pytest.fixture(scope="module")
def blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(u, int(i)) for u in range(30) for i in rng.choice(10, 6, replace=False) + 10 * (u % 2)]
    return spark.createDataFrame(rows, "user long, item long")


def test_exact_als(spark, blocks, tmp_path):
    m = als.fit(blocks, factors=4, iterations=3, engine="exact")
    losses = [h["train_loss"] for h in m.history]
    assert losses == sorted(losses, reverse=True)
    # items were solved last: their normal equations hold
    users = {r["id"]: np.array(r["features"], float) for r in m.users.collect()}
    items = {r["id"]: np.array(r["features"], float) for r in m.items.collect()}
    g = sum(np.outer(u, u) for u in users.values())
    seen = {}
    for r in blocks.distinct().collect():
        seen.setdefault(r["item"], []).append(users[r["user"]])
    for i, us in seen.items():
        a = g + 40 * sum(np.outer(u, u) for u in us) + 0.01 * np.eye(4)
        assert np.allclose(a @ items[i], 41 * sum(us), rtol=1e-3, atol=1e-2)
    als.save(m, str(tmp_path / "model"))
    again = als.load(spark, str(tmp_path / "model"))
    assert again.params == m.params and again.users.count() == 30


@pytest.mark.parametrize("head", [1 << 20, 0])
def test_exact_als_moves_no_matrices(spark, blocks, monkeypatch, head):
    """Plain normal equations in numpy are met with hot entities, several rounds and entities without interactions, and the loss is that of the final factors."""
    monkeypatch.setattr(als, "LIST", 8)
    all_items = spark.range(25)
    m = als.fit(blocks, factors=4, iterations=2, engine="exact", all_items=all_items, head=head, most=3000)
    pairs = {(r["user"], r["item"]) for r in blocks.collect()}
    start = lambda i, seed: np.random.default_rng([seed, i]).standard_normal(4).astype(np.float32) / np.sqrt(4)
    u, v = np.stack([start(i, 42) for i in range(30)]), np.stack([start(i, 43) for i in range(25)])
    seen = np.zeros((30, 25))
    for a, b in pairs:
        seen[a, b] = 1
    losses = []
    for _ in range(2):
        for x, y, s in ((u, v, seen), (v, u, seen.T)):
            y = y.astype(float)
            for k in np.flatnonzero(s.sum(axis=1)):
                own = y[s[k] > 0]
                x[k] = np.linalg.solve(y.T @ y + 40 * own.T @ own + 0.01 * np.eye(4), 41 * own.sum(axis=0))
        losses.append(41 * (seen * (1 - u.astype(float) @ v.T) ** 2).sum() + 0.01 * ((u.astype(float) ** 2).sum() + (v.astype(float) ** 2).sum()))
    for got, want in ((m.users, u), (m.items, v)):
        got = {r["id"]: r["features"] for r in got.collect()}
        assert sorted(got) == list(range(len(want))) and np.allclose([got[k] for k in range(len(want))], want, rtol=1e-3, atol=1e-4)
    assert np.allclose([h["train_loss"] for h in m.history], losses, rtol=1e-4)
    assert np.isclose(m.history[-1]["train_loss"], als.loss(blocks, m), rtol=1e-6)


def test_exact_als_on_blocks(spark, monkeypatch):
    """Factors beyond `head` bytes were joined to each interaction, a round at a time."""
    rng = np.random.default_rng(9)
    rows = [(u * 3, int(i)) for u in range(80) for i in rng.choice(60, int(rng.integers(1, 14)), replace=False)]
    pairs = spark.createDataFrame([*rows, *rows[:9]], "user long, item long")
    monkeypatch.setattr(als.als_blocks, "PAIRS", 100)
    moved = []
    monkeypatch.setattr(als, "update", lambda *a, _u=als.update, **k: moved.append(1) or _u(*a, **k))
    seen = lambda it, m: {"n": m.users.count() + m.items.count()}
    got = als.fit(pairs, factors=8, iterations=3, engine="exact", head=0, each=seen)
    assert not moved
    want = als.fit(pairs, factors=8, iterations=3, engine="exact", each=seen)
    assert moved and [h["n"] for h in got.history] == [h["n"] for h in want.history]
    assert np.allclose([h["train_loss"] for h in got.history], [h["train_loss"] for h in want.history], rtol=1e-4)
    for a, b in ((got.users, want.users), (got.items, want.items)):
        a, b = ({r["id"]: r["features"] for r in x.collect()} for x in (a, b))
        assert a.keys() == b.keys() and np.allclose([a[k] for k in a], [b[k] for k in a], rtol=1e-3, atol=1e-3)
    assert np.isclose(got.history[-1]["train_loss"], als.loss(pairs.distinct(), got), rtol=1e-5)


def test_als_disk_follows_the_interactions(spark, tmp_path, monkeypatch):
    """A sweep shuffled a matrix of 2,080 doubles for about every interaction."""
    rng = np.random.default_rng(5)
    rows = [(u, int(i)) for u in range(600) for i in rng.choice(400, 8, replace=False)]
    pairs = spark.createDataFrame(rows, "user long, item long")
    written = lambda: sum(s.shuffleWriteBytes() for s in _stages(spark))
    before = written()
    als.fit(pairs, factors=64, iterations=1, engine="exact")
    assert written() - before < 4800 * 256


def _stages(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    got = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return [got.apply(i) for i in range(got.size())]


def test_mllib_deletes_what_its_iterations_moved(spark, blocks, monkeypatch):
    from pyspark.ml.recommendation import ALS

    class Asked(Exception):
        pass

    def fit(solver, data):
        raise Asked(solver.getCheckpointInterval(), solver.getNumUserBlocks(), solver.getNumItemBlocks())

    monkeypatch.setattr(ALS, "fit", fit)
    with pytest.raises(Asked) as e:
        als.fit(blocks, factors=4, iterations=2)
    assert e.value.args == (1, als.BLOCKS, als.BLOCKS)


def test_recommend_in_blocks_moves_no_vectors(spark):
    """Every user's vector was shuffled once for each block of items."""
    rng = np.random.default_rng(8)
    frame = lambda: spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(64)]) for i in range(300)], "id long, features array<float>")
    model = als.Model(frame(), frame(), {"factors": 64})
    written = lambda: sum(s.shuffleWriteBytes() for s in _stages(spark))
    before = written()
    assert als.recommend(model, spark.range(300).withColumnRenamed("id", "user"), None, 1, 0, 10).count() == 300
    assert written() - before < 1 << 20


@pytest.mark.parametrize("wide", [False, True])
def test_best_by_brute_force(wide):
    rng = np.random.default_rng(6)
    s = rng.integers(0, 9, (50, 1500 if wide else 40)).astype(np.float32)
    s[rng.random(s.shape) < 0.3] = -np.inf
    s[7, 4:] = -np.inf
    r, c = als._best(s, 6)
    for k in range(50):
        want = [j for j in sorted(range(s.shape[1]), key=lambda j: (-s[k, j], j)) if s[k, j] > -np.inf][:6]
        assert c[r == k].tolist() == want


def test_als_learns_the_blocks(spark, blocks):
    m = als.fit(blocks, factors=4, iterations=5, engine="mllib")
    recs = als.recommend(m, blocks.select("user"), blocks, 3).collect()
    assert len(recs) == 90 and sum(r["item"] // 10 == r["user"] % 2 for r in recs) > 80


@pytest.mark.parametrize("head", [1 << 20, 0])
def test_recommend_by_brute_force(spark, head):
    """Ties, users without history, one who has seen all but two items, and blocks of users and items."""
    rng = np.random.default_rng(4)
    us, vs = rng.integers(-2, 3, (40, 3)), rng.integers(-2, 3, (57, 3))
    frame = lambda m, by: spark.createDataFrame([(i * by, [float(x) for x in r]) for i, r in enumerate(m)], "id long, features array<float>")
    seen = {(u, int(i) * 7) for u in range(0, 40, 2) for i in rng.choice(57, 9)} | {(3, i * 7) for i in range(55)}
    model = als.Model(frame(us, 1), frame(vs, 7), {"factors": 3})
    got = als.recommend(model, spark.range(50).withColumnRenamed("id", "user"), spark.createDataFrame([*seen, *seen], "user long, item long"), 5, head, 10)
    plan = pushed(got)
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    want = []
    for u in range(40):
        best = sorted((-float(us[u] @ v), i * 7) for i, v in enumerate(vs) if (u, i * 7) not in seen)
        want += [(u, i, -s, r + 1) for r, (s, i) in enumerate(best[:5])]
    assert sorted((r["user"], r["item"], r["score"], r["rank"]) for r in got.collect()) == sorted(want)
    none = als.Model(frame(us, 1), frame([], 7), {"factors": 3})
    assert als.recommend(none, spark.range(3).withColumnRenamed("id", "user"), None, 5, head, 10).count() == 0


def test_mllib_refuses_ids_that_it_would_cut(spark):
    with pytest.raises(ValueError):
        als.fit(spark.createDataFrame([(1, 1 << 40)], "user long, item long"), factors=2, iterations=1)


@pytest.mark.parametrize("name", ["als_recommend", "als_evaluate", "als_exact_history"])
def test_als_queries_run_the_whole_job(spark, data, monkeypatch, name):
    class Fitted(Exception):
        pass

    def fit(*args, **kwargs):
        raise Fitted(inspect.signature(whole).bind(*args, **kwargs))

    whole = als.fit
    monkeypatch.setattr(als, "fit", fit)
    with pytest.raises(Fitted) as e:
        catalog.queries()[name](spark, data)
    bound = e.value.args[0]
    bound.apply_defaults()
    a = bound.arguments
    assert (a["factors"], a["iterations"], a["reg"], a["alpha"], a["seed"]) == (64, 20, 0.01, 40.0, 42)
    assert a["engine"] == ("exact" if name == "als_exact_history" else "mllib")


def test_pca(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 1)) @ np.array([[3.0, 1.0, 0.0]]) + 0.01 * rng.standard_normal((200, 3)) + 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    p, share = als.pca(df, "k", "v")
    assert p.columns == ["k", "pc1", "pc2"] and share[0] > 0.99
    assert abs(p.agg(F.avg("pc1")).first()[0]) < 1e-6


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", 2.5), (2, "b", None)], "id long, s string, x double")
    io.write_csv(df, str(tmp_path / "c"))
    assert io.read_csv(spark, str(tmp_path / "c"), df.schema).orderBy("id").collect() == df.orderBy("id").collect()
    (tmp_path / "u.item").write_bytes("1|Toy Story|x\n2|Amélie|y\n".encode("latin-1"))
    assert [tuple(r) for r in io.read_titles(spark, str(tmp_path / "u.item")).orderBy("item_id").collect()] == [(1, "Toy Story"), (2, "Amélie")]
    (tmp_path / "u.data").write_text("1\t2\t3\t4\n")
    assert tuple(io.read_ratings(spark, str(tmp_path / "u.data")).first()) == (1, 2, 3, 4)
    (tmp_path / "q.sql").write_text("SELECT 1 AS one")
    assert io.run_sql_file(spark, str(tmp_path / "q.sql")).first()["one"] == 1
    old = spark.createDataFrame([(1, "a")], "id long, s string")
    new = spark.createDataFrame([(1, "z"), (2, "b"), (2, "b")], "id long, s string")
    assert sorted(tuple(r) for r in io.upsert_ignore(old, new, ["id"]).collect()) == [(1, "a"), (2, "b")]
    io.swap_in(df, str(tmp_path / "t"))
    io.swap_in(df.limit(1), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_generators(spark):
    a = io.synthetic_interactions(spark, 50, 40, per_user=5, seed=1)
    assert a.count() == 250 and a.dropDuplicates(["user_id", "item_id"]).count() == 250
    assert a.exceptAll(io.synthetic_interactions(spark, 50, 40, per_user=5, seed=1)).count() == 0
    g = io.retail_data(spark, users=40, products=20, orders=100)
    total = g["items"].groupBy("order_id").agg(F.sum(F.col("quantity") * F.col("unit_price")).alias("t"))
    assert g["orders"].join(total, "order_id").where(F.abs(F.col("t") - F.col("total_amount")) > 0.005).isEmpty()
    assert g["orders"].count() == 100 and g["users"].count() == 40


def test_stream_equals_batch(spark, data, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "e.parquet").write_bytes(open(f"{data}/events.parquet", "rb").read())
    schema = spark.read.parquet(str(src)).schema
    q = live.counts(spark.readStream.schema(schema).parquet(str(src))).writeStream.format("memory").queryName("live_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("live_counts").collect()}
    assert got == {tuple(r) for r in live.counts(spark.read.schema(schema).parquet(str(src))).collect()}


def test_entry_without_the_text_operators(tmp_path):
    code = "import sys; sys.modules['sparrowmill.llm'] = None; import __spark_entry__ as e; assert 'rolling_revenue' in e.queries() and not any(k.startswith('op') for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=importlib.import_module("sparrowmill").__path__[0] + "/..")


def test_results_come_in_their_order(spark, data):
    q = catalog.queries()
    rows = q["cohort_retention"](spark, data).collect()
    assert rows == sorted(rows, key=lambda r: (r["cohort_month"], r["months_since_signup"]))
    rows = q["conversion_funnel"](spark, data).collect()
    assert rows == sorted(rows, key=lambda r: (-(r["overall_conversion_pct"] if r["overall_conversion_pct"] is not None else -1), r["category_name"]))
    rows = q["rfm_segmentation"](spark, data).collect()
    assert rows == sorted(rows, key=lambda r: (-r["rfm_score"], -r["monetary"], r["user_id"]))
    days = [r["order_date"] for r in q["rolling_revenue"](spark, data).collect()]
    assert days == sorted(days)
    kinds = [r["row_type"] for r in q["geo_revenue_rollup"](spark, data).collect()]
    assert kinds == sorted(kinds, key=["detail", "country_subtotal", "grand_total"].index) and kinds[-1] == "grand_total"


def test_no_window_over_all_rows(spark, data):
    for name in ("rfm_segmentation", "win_cumshare", "win_ntile"):
        plan = pushed(catalog.queries()[name](spark, data))
        windows = [x for x in plan.split("\n\n") if ") Window" in x and "Arguments" in x]
        assert "SinglePartition" not in plan or all("_p" in w for w in windows), name


def test_pairs_of_large_orders(spark, monkeypatch):
    from itertools import combinations

    from sparrowmill.operators import retail

    orders = {1: range(40), 2: [3, 5, 7], 3: [5], 4: range(0, 80, 2)}
    items = spark.createDataFrame([(o, p) for o, ps in orders.items() for p in ps] + [(2, 3)], "order_id long, product_id long")
    want = {}
    for ps in orders.values():
        for pair in combinations(sorted(ps), 2):
            want[pair] = want.get(pair, 0) + 1
    for large, chunk in ((256, 64), (10, 7), (2, 1)):
        monkeypatch.setattr(retail, "LARGE", large)
        monkeypatch.setattr(retail, "CHUNK", chunk)
        assert {(r["a"], r["b"]): r["n"] for r in retail.product_pairs(items).collect()} == want


def test_binarize(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 2.0)], "u long, i long, rating double")
    assert reco.binarize(df).count() == 2 and [r["i"] for r in reco.binarize(df, "rating", 4).collect()] == [1]
