from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from cpgdomains.functions.states import state_code, state_name
from cpgdomains.operators import cluster, hmm, metrics, rules
from cpgdomains.schema import POINTS, STATES, Assignment, Resolution, StateCutoffs, WindowCutoffs, by_size, default_windows

W = "beta double, w_int_pct double, w_std double, w_high_pct double, w_low_pct double"


def state_of(spark, *row):
    return rules.label_by_rules(spark.createDataFrame([row], W), StateCutoffs.default(["w"])).first().state


def test_rules_at_the_cutoffs(spark):
    assert state_of(spark, 0.29, 0.56, 0.264, 0.246, 0.246) == "PMD"
    assert state_of(spark, 0.694, 0.56, 0.264, 0.246, 0.246) == "PMD"
    assert state_of(spark, 0.29, 0.55, 0.264, 0.246, 0.246) == "LOW"
    assert state_of(spark, 0.694, 0.56, 0.265, 0.246, 0.246) == "HIGH"
    assert state_of(spark, 0.5, 0.56, 0.264, 0.25, 0.246) == "INTERMEDIATE"
    assert state_of(spark, 0.1, 0.9, 0.1, 0.1, 0.1) == "LOW"
    assert state_of(spark, None, None, None, None, None) == "INTERMEDIATE"
    with pytest.raises(KeyError):
        rules.label_by_rules(spark.createDataFrame([(0.5,)], "beta double"), StateCutoffs.default(["w"]))
    with pytest.raises(ValueError):
        rules.rule_state(StateCutoffs())


def test_cutoffs_mapping():
    c = StateCutoffs({"a": WindowCutoffs(0.5, 0.2, 0.3, None)}, 0.2, 0.8)
    assert StateCutoffs.from_mapping({"state_cutoffs": c.to_mapping()}).windows["a"].low == 0.3
    with pytest.raises(ValueError):
        StateCutoffs.from_mapping({"beta_low_max": 1})
    with pytest.raises(ValueError):
        StateCutoffs.from_mapping({"beta_low_max": 0, "beta_high_min": 1, "pmd_cutoffs": {"a": {"int_min": 1}}})
    assert "int >= 0.5" in c.describe()


def test_enums_and_windows():
    assert Resolution("WGBS") is Resolution.WGBS and Assignment(" KMeans ") is Assignment.KMEANS
    assert [w for _, w in default_windows("450K")] == ["40kb", "450kb"] and by_size([(9, "b"), (1, "a")]) == ["a", "b"]
    with pytest.raises(ValueError):
        default_windows("27k")


def test_state_names(spark):
    rows = spark.createDataFrame([("1",), ("1.0",), ("Low",), (" high ",), ("",), (None,), ("other",), ("7",)], "s string")
    assert [r[0] for r in rows.select(state_name("s")).collect()] == ["PMD", "PMD", "LOW", "HIGH", None, None, "other", "7"]
    assert [r[0] for r in rows.select(state_code("s")).collect()] == [1, 1, 0, 3, None, None, None, None]


def test_rule_search_prefers_the_generating_rule(spark):
    rng = np.random.default_rng(0)
    rows = [tuple(float(x) for x in rng.random(5)) for _ in range(400)]
    table = rules.label_by_rules(spark.createDataFrame(rows, W), StateCutoffs.default(["w"]), "truth")
    trials = rules.draw_trials(["w"], 40, 1)
    found = rules.search_rules(table, "truth", ["w"], 40, 1)
    scores = []
    for t in trials:
        pairs = [(r.truth, r.state) for r in rules.label_by_rules(table, t).select("truth", "state").collect()]
        labels = {x for p in pairs for x in p}
        f1 = [2 * sum(a == b == s for a, b in pairs) / max(1, sum((a == s) + (b == s) for a, b in pairs)) for s in labels]
        scores.append(np.mean(f1))
    assert found.best == trials[int(np.argmax(scores))] and found.history.orderBy("trial").first().f1_macro == pytest.approx(scores[0])
    assert rules.search_rules(table, "truth", ["w"], 40, 1).best == found.best


def test_absorption_and_assignment(spark):
    assert cluster.absorption([(0, 10_000, 0.1), (1, 10_000, 0.9), (2, 3, 0.8)]) == {0: 0, 1: 1, 2: 1}
    assert cluster.absorption([(0, 10_000, 0.25), (1, 10_000, 0.75), (2, 3, 0.5)])[2] == 0  # a tie goes to the lowest
    scores = {0: (5.0, 0, 0, 4), 1: (6.0, 0, 0, 0), 7: (0.0, 1, 2, 3)}
    assert cluster.assign(scores) == {0: "HIGH", 1: "LOW", 7: "INTERMEDIATE"}
    best = max(((sum(scores[c][s] for c, s in zip(scores, p, strict=True)), tuple(scores[c][s] for c, s in zip(scores, p, strict=True))), p) for p in product(range(4), repeat=3) if len(set(p)) == 3)[1]
    assert [STATES[s] for s in best] == list(cluster.assign(scores).values())
    assert cluster.assign({3: (0.0, 9.0, 0, 0)}) == {3: "PMD"} and cluster.assign({}) == {}
    with pytest.raises(ValueError):
        cluster.assign({i: (0.0,) * 4 for i in range(5)})


def test_kmeans_finds_separated_clusters(spark):
    rng = np.random.default_rng(4)
    rows = [(float(k + rng.normal(0, 0.01)), float(-k + rng.normal(0, 0.01)), None if i == 3 else 1.0, k) for k in range(3) for i in range(40)]
    table = spark.createDataFrame(rows, "a double, b double, c double, k int")
    for space in ("pca", "raw"):
        model = cluster.fit(table, ["a", "b", "c"], 3, space, 2, restarts=2)
        got = model.apply(table).groupBy("k").agg(F.count_distinct("cluster").alias("n"), F.first("cluster").alias("c")).collect()
        assert {r.n for r in got} == {1} and len({r.c for r in got}) == 3
    assert cluster.top_loadings(cluster.fit(table, ["a", "b"], 3).loadings(table), 1).count() == 2
    with pytest.raises(KeyError):
        model.apply(table.drop("a"))
    with pytest.raises(ValueError):
        cluster.fit(table, ["a"], space="other")


def test_agreement(spark):
    pairs = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("c", "a")]
    r = metrics.agreement(spark.createDataFrame(pairs, "t string, p string"), "t", "p").first()
    assert r.accuracy == pytest.approx(8 / 11)
    f1 = [2 * 5 / 13, 2 * 3 / 8, 0]
    assert r.f1_macro == pytest.approx(np.mean(f1)) and r.f1_weighted == pytest.approx((f1[0] * 7 + f1[1] * 3) / 11)
    assert r.recall_macro == pytest.approx((5 / 7 + 1 + 0) / 3) and r.precision_macro == pytest.approx((5 / 6 + 3 / 5) / 3)
    same = metrics.agreement(spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "y")], "t string, p string"), "t", "p").first()
    assert same.ari == pytest.approx(1) and same.nmi == pytest.approx(1) and same.accuracy == 0
    one = metrics.agreement(spark.createDataFrame([("a", "a")] * 3, "t string, p string"), "t", "p").first()
    assert one.ari == 1 and one.nmi == 1


def test_cluster_quality(spark):
    x = np.array([[0.0, 0], [0, 1], [5, 5], [5, 6], [9, 0]])
    k = [0, 0, 1, 1, 2]
    table = spark.createDataFrame([(float(a), float(b), c) for (a, b), c in zip(x, k, strict=True)], "a double, b double, k int")
    c = [x[:2].mean(0), x[2:4].mean(0), x[4]]
    s = [0.5, 0.5, 0.0]
    d = np.mean([max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in range(3) if j != i) for i in range(3)])
    assert metrics.davies_bouldin(table, ["a", "b"], "k").first()[0] == pytest.approx(d)
    dist = np.linalg.norm(x[:, None] - x[None], axis=2)
    want = []
    for i in range(5):
        own = [j for j in range(5) if k[j] == k[i] and j != i]
        if not own:
            want.append(0.0)
            continue
        a = dist[i, own].mean()
        b = min(dist[i, [j for j in range(5) if k[j] == q]].mean() for q in set(k) - {k[i]})
        want.append((b - a) / max(a, b))
    assert metrics.silhouette(table, ["a", "b"], "k") == pytest.approx(np.mean(want))
    assert metrics.silhouette(table.where("k = 0"), ["a", "b"], "k") is None
    assert metrics.hexagons(table, "a", "b", "k", 1.0).agg(F.sum("n")).first()[0] == 5


def sequence(spark, states, step=10):
    return spark.createDataFrame([("s", "c", i * step, i * step + 2, 0.5, i, s) for i, s in enumerate(states)], POINTS + ", state string")


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_against_exhaustive_search(seed):
    rng = np.random.default_rng(seed)
    n, k = 7, 3
    t, e = rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(k), k)
    obs = rng.integers(0, k, n)
    score = lambda p: np.log(e[p[0], obs[0]]) + sum(np.log(t[a, b]) + np.log(e[b, obs[i + 1]]) for i, (a, b) in enumerate(zip(p, p[1:])))
    best = max(product(range(k), repeat=n), key=score)
    assert tuple(hmm.viterbi(obs, t, e)) == best
    pairs, loglik = hmm.transition_counts(obs, t, e)
    weights = {p: np.exp(score(p)) / k for p in product(range(k), repeat=n)}
    total = sum(weights.values())
    assert loglik == pytest.approx(np.log(total))
    want = np.zeros((k, k))
    for p, w in weights.items():
        for a, b in zip(p, p[1:]):
            want[a, b] += w / total
    assert np.allclose(pairs, want)


@pytest.mark.parametrize("length", [1, 2, 3, 10, 50, 101])
def test_blocks_give_what_one_step_after_another_gives(length):
    rng = np.random.default_rng(length)
    k = 4
    t, e = rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(k), k)
    obs = rng.integers(0, k, length)
    told = e[:, obs].T
    forward, scale = np.zeros((length, k)), np.zeros(length)
    for i in range(length):
        x = told[0] / k if not i else (forward[i - 1] @ t) * told[i]
        scale[i] = x.sum()
        forward[i] = x / scale[i]
    back = np.ones((length, k))
    for i in range(length - 2, -1, -1):
        back[i] = t @ (told[i + 1] * back[i + 1]) / scale[i + 1]
    for want, got in zip((forward, back, scale), hmm.forward_backward(told, t[None], np.zeros(max(0, length - 1), int)), strict=True):
        assert np.allclose(want, got)


@pytest.mark.parametrize("seed", range(8))
def test_ties_of_paths_go_as_one_step_after_another_decides(seed):
    rng = np.random.default_rng(seed)
    n = 4
    step = np.full((n, n), -3)
    np.fill_diagonal(step, 0)
    told = np.full((200, n), -2)
    told[np.arange(200), np.where(rng.random(200) < 0.4, rng.integers(0, n, 200), np.arange(200) // 23 % n)] = -1
    score, back = told[0].copy(), np.zeros((200, n), int)
    for t in range(1, 200):
        reach = score[:, None] + step
        back[t] = reach.argmax(axis=0)
        score = reach.max(axis=0) + told[t]
    path = [int(score.argmax())]
    for t in range(199, 0, -1):
        path.append(int(back[t, path[-1]]))
    assert hmm._likeliest(told.astype(np.int64), step.astype(np.int64)[None], np.zeros(199, int)).tolist() == path[::-1]


def test_impossible_steps_are_never_taken():
    obs = np.array([0] * 50 + [1] * 60)
    assert set(hmm.viterbi(obs, np.eye(2), np.array([[0.9, 0.1], [0.1, 0.9]])).tolist()) == {1}


def decoded(spark, states, **options):
    rows = sequence(spark, states)
    codes = hmm.observation_codes(rows)
    return [r.hmm_state for r in hmm.StickyModel(len(codes), **options).predict(rows, codes=codes).orderBy("input_row_index").collect()]


def test_excursions_need_seventeen_points(spark):
    all_four = ["HIGH"] * 60 + ["LOW"] * 60 + ["PMD"] * 60 + ["INTERMEDIATE"] * 60
    for n, kept in ((16, False), (17, True)):
        path = decoded(spark, all_four + ["HIGH"] * 60 + ["LOW"] * n + ["HIGH"] * 60)
        assert (0 in path[300 : 300 + n]) == kept
    for n, kept in ((8, False), (9, True)):
        assert (0 in decoded(spark, all_four + ["HIGH"] * 60 + ["LOW"] * n)[300:]) == kept


def test_encoding_and_parameters(spark):
    rows = sequence(spark, ["HIGH", "PMD", None, "HIGH"])
    assert hmm.observation_codes(rows) == {1: 0, 3: 1}
    with pytest.raises(ValueError):
        hmm.observation_codes(rows, supported=1)
    assert hmm.StickyModel(1).transitions.tolist() == [[1.0]] and hmm.StickyModel(2, stay=1.0).transitions.tolist() == [[1, 0], [0, 1]]
    for bad in ({"stay": 1.1}, {"noise": 0}, {"n_iter": 0}, {"strength": -1}):
        with pytest.raises(ValueError):
            hmm.StickyModel(4, **bad)
    assert decoded(spark, ["LOW"]) == [0]


class Reversed(hmm.Backend):
    """A smoother of one's own: the codes turned round."""

    def decode(self, obs, positions, n):
        return np.where(np.isnan(obs), 0, n - 1 - obs).astype(int)


def test_own_backend_and_encoding_by_scope(spark):
    rows = [("a", "c", i, i + 2, 0.5, i, s) for i, s in enumerate(["HIGH", "PMD", None, "HIGH"])] + [("b", "c", i, i + 2, 0.5, 10 + i, "HIGH") for i in range(2)] + [("a", "d", 5, 7, 0.5, 20, "HIGH")]
    table = spark.createDataFrame(rows, POINTS + ", state string")
    found = {r.input_row_index: (r.obs, r.n) for r in hmm.encoded(table).collect()}
    assert found == {0: (1, 2), 1: (0, 2), 2: (None, 2), 3: (1, 2), 10: (0, 1), 11: (0, 1), 20: (1, 2)}
    assert {r.input_row_index: r.n for r in hmm.encoded(table, scope=("sample_id", "CpG_chrm")).collect()}[20] == 1
    assert {r.input_row_index: r.hmm_state for r in hmm.smooth(table, Reversed()).collect()} == {0: 0, 1: 1, 2: 0, 3: 0, 10: 0, 11: 0, 20: 0}
    with pytest.raises(Exception, match="more states"):
        hmm.smooth(table, Reversed(), supported=1).collect()
    assert hmm.smooth(table.where("state IS NULL"), Reversed()).first().hmm_state is None


def test_sticky_fit_raises_the_likelihood(spark):
    rng = np.random.default_rng(9)
    states = [STATES[3 if (i // 15) % 2 else 0] for i in range(300)]
    rows = sequence(spark, [s if rng.random() > 0.1 else STATES[0] for s in states])
    codes = hmm.observation_codes(rows)
    model = hmm.StickyModel(2, stay=0.5, noise=0.1, strength=0.0, n_iter=8)
    fitted = model.fit(rows, codes=codes)
    obs = np.array([codes[0 if r.state == "LOW" else 3] for r in rows.orderBy("CpG_beg").collect()])
    assert np.allclose(fitted.transitions.sum(axis=1), 1)
    assert hmm.transition_counts(obs, fitted.transitions, fitted.emissions)[1] > hmm.transition_counts(obs, model.transitions, model.emissions)[1]


def test_continuous_time_model(spark):
    q = hmm.ContinuousModel(3, holding=50.0).rates()
    assert np.allclose(q.sum(axis=1), 0)
    p = hmm.Propagator(q)
    assert np.allclose(p.at(np.array([7.0]))[0], hmm._expm(q * 7.0)) and np.allclose(p.at(np.array([3.0, 4.0]))[0] @ p.at(np.array([4.0]))[0], p.at(np.array([7.0]))[0])
    jordan = hmm.Propagator(np.array([[-1.0, 1, 0], [0, -1, 1], [0, 0, 0]]))
    assert np.allclose(jordan.at(np.array([2.0]))[0].sum(axis=1), 1)
    rng = np.random.default_rng(3)
    a = np.array([[-0.3, 0.1, 0.2], [0.05, -0.1, 0.05], [0.2, 0.2, -0.4]])
    w = rng.random((1, 3, 3))
    steps = np.linspace(0, 5, 2001)
    exact = sum(hmm._expm(a * s).T @ w[0] @ hmm._expm(a * (5 - s)).T for s in (steps[:-1] + steps[1:]) / 2) * (5 / 2000)
    assert np.allclose(hmm.Propagator(a).integrals(np.array([5.0]), w), exact, rtol=1e-4)
    broken = hmm.Propagator(a)
    broken.ok = False
    assert np.allclose(broken.integrals(np.array([5.0]), w), exact, rtol=1e-4)
    obs = np.repeat([0, 1, 0, 2, 1], 40)
    times = np.cumsum(rng.integers(1, 20, 200)).astype(float)
    fitted, history = hmm.fit_rates(obs, times, q, hmm.ContinuousModel(3).emissions(), 15, 1e-6)
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:])) and np.allclose(fitted.sum(axis=1), 0)
    post = hmm.posterior(obs, times, fitted, hmm.ContinuousModel(3).emissions())
    assert np.allclose(post.sum(axis=1), 1) and (post.argmax(axis=1) == obs).mean() > 0.95
    rows = sequence(spark, ["LOW"] * 30 + ["HIGH"] + ["LOW"] * 30)
    for how in ("forward-backward", "viterbi"):
        out = hmm.ContinuousModel(2, holding=10_000.0, noise=0.1, max_iter=1, decode_by=how).smooth(rows, codes={0: 0, 3: 1})
        assert {r.hmm_state for r in out.collect()} == {0}
    with pytest.raises(ValueError):
        hmm.ContinuousModel(decode_by="other")


def test_paths_by_blocks_are_those_of_whole_sequences(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [("s", c, int(p), i, [0, 1, 2, 3, None][k]) for i, (c, p, k) in enumerate(zip(rng.choice(["chr1", "chr2", "chr3"], 3000, p=[0.7, 0.29, 0.01]), rng.integers(0, 300, 3000), rng.integers(0, 5, 3000), strict=True))]
    rows += [("t", "chr1", 5, 0, 2), ("t", "chr2", 5, 1, 0), ("u", "chr1", 1, 2, None)]
    table = spark.createDataFrame(rows, "sample_id string, CpG_chrm string, CpG_beg long, input_row_index long, state int")
    encoded = hmm.encoded(table).repartition(3)
    monkeypatch.setattr(hmm, "ROWS", 7)
    blocks = hmm._in_blocks(encoded)
    assert blocks.count() > 3000 / 7 and blocks.agg(F.max(F.length("rows"))).first()[0] == 7 * 8
    for stay, noise in ((0.9, 0.3), (0.5, 0.75), (1.0, 0.2)):  # ties at every step where noise says nothing
        model = hmm.StickyModel(4, stay, noise)
        key = lambda r: (r.sample_id, r.CpG_chrm, r.input_row_index, r.hmm_state if r.hmm_state is not None else -1)
        assert sorted(map(key, model.paths(encoded).collect())) == sorted(map(key, hmm.Backend.paths(model, encoded).collect()))


def test_equal_rows_are_weights_of_one(spark, monkeypatch):
    sizes, kmeans = [], cluster.KMeans

    class Counted(kmeans):
        def _fit(self, dataset):
            sizes.append((dataset.count(), dataset.agg(F.sum("weight")).first()[0]))
            return super()._fit(dataset)

    monkeypatch.setattr(cluster, "KMeans", Counted)
    rows = spark.range(900).select((F.col("id") % 3 / 2).alias("a"), (F.col("id") % 9 / 100 + F.col("id") % 3).alias("b"))
    for space in ("pca", "raw"):
        model = cluster.fit(rows, ["a", "b"], 3, space, restarts=2)
        assert model.cost == pytest.approx(model.apply(rows).agg(F.sum(F.pow(F.array_min("distances"), 2))).first()[0], rel=1e-6)
    assert sizes == [(9, 900.0)] * 4
