"""As-of joins, folds, significance, comparisons, files and the search, on small fixtures."""

import json
import math
import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from causalpanel.functions.guards import null_safe_clip, safe_div
from causalpanel.operators import asof, boost, compare, model, prices, profile, quality, reporting, resample, selection
from causalpanel.operators.rank import monthly_rank_ic, spearman
from causalpanel.plans import expr, folds, run, search
from causalpanel.sources import io


@pytest.mark.parametrize("cut", [date(2020, 3, 1), date(2020, 7, 15), date(2021, 1, 1)])
def test_asof_is_causal(spark, cut):
    rng = random.Random(1)
    day = lambda: date(2020, rng.randint(1, 12), rng.randint(1, 28))
    keys = spark.createDataFrame(sorted({(rng.randint(1, 3), day()) for _ in range(60)}), "id int, d date")
    source = spark.createDataFrame([(rng.randint(1, 4), day(), rng.choice([None, rng.random()])) for _ in range(60)], "id int, d date, v double")
    run = lambda k, s: {(r["id"], r["d"]): r["v"] for r in asof.asof_carry(k, s, "v", "id", "d", "id", "d", 30).collect()}
    whole, part = run(keys, source), run(keys.where(F.col("d") <= cut), source.where(F.col("d") <= cut))
    assert part == {k: v for k, v in whole.items() if k[1] <= cut}
    rows = source.where("v is not null").collect()
    for (i, d), v in whole.items():
        past = [(r["d"], r["v"]) for r in rows if r["id"] == i and r["d"] <= d]
        assert v == (max(past)[1] if past and (d - max(past)[0]).days <= 30 else None)


def test_asof_keeps_key_rows(spark):
    keys = spark.createDataFrame([(1, date(2020, 1, 5), "a"), (1, date(2020, 1, 5), "b"), (None, None, "c")], "id int, d date, _value string")
    source = spark.createDataFrame([(1, date(2020, 1, 5), 2.0), (1, date(2020, 1, 5), 1.0)], "id int, d date, v double")
    found = sorted(asof.asof_carry(keys, source, "v", "id", "d", "id", "d", 10).collect(), key=lambda r: r["_value"])
    assert [(r["_value"], r["v"]) for r in found] == [("a", 2.0), ("b", 2.0), ("c", None)]


def test_fill_turns_infinities_and_stale_values_into_null(spark):
    d = spark.createDataFrame([(1, date(2020, 1, 1), 1.0), (1, date(2020, 3, 1), float("inf")), (1, date(2020, 12, 1), None)], "id int, d date, x double")
    assert [r["x"] for r in asof.causal_fill(d, ["x"], "id", "d").orderBy("d").collect()] == [1.0, 1.0, None]


def test_guards(spark):
    d = spark.createDataFrame([(1.0, 0.0), (1.0, -1e-9), (None, 1.0), (6.0, 3.0)], "n double, d double")
    assert [r[0] for r in d.select(safe_div(F.col("n"), F.col("d"))).collect()] == [1e6, -1e6, None, 2.0]
    c = [r[0] for r in d.select(null_safe_clip(F.col("n"), F.lit(2.0), F.lit(5.0))).collect()]
    assert c == [2.0, 2.0, None, 5.0]


def test_monthly_ic_skips_constant_months(spark):
    rows = [("m1", 1.0, 1.0), ("m1", 2.0, 2.0), ("m1", 3.0, 3.0), ("m2", 1.0, 3.0), ("m2", 2.0, 2.0), ("m3", 1.0, 1.0), ("m3", 1.0, 2.0), ("m4", 1.0, 1.0), ("m5", float("nan"), 1.0)]
    found = {r["month"]: r["ic"] for r in monthly_rank_ic(spark.createDataFrame(rows, "month string, label double, prediction double")).collect()}
    assert found == {"m1": pytest.approx(1.0), "m2": pytest.approx(-1.0)}


def test_fold_boundaries():
    found = folds.fold_boundaries(list(range(2001, 2027)), 2, 5, 5)
    dev, final = [f for f in found if f.category == "development"], [f for f in found if f.category == "final_test"]
    assert (dev[0].test[0], dev[-1].test[1], final[0].test, final[-1].test) == (2007, 2016, (2017, 2018), (2025, 2026))
    assert final[0].train == (2001, 2014) and final[0].validation == (2015, 2016)
    assert folds.embargo_end(2014, 1) == date(2014, 11, 30) and folds.embargo_end(2014, 0) == date(2014, 12, 31)
    small = folds.fold_boundaries(list(range(1995, 2002)), 1, 2, 2)
    assert [f.test[0] for f in small] == [1998, 1999, 2000, 2001]
    assert folds.derive_seed(1, "a") == folds.derive_seed("1", "a") != folds.derive_seed(1, "b")
    a = folds.fingerprint(["x", "y"], small[0], {"k": 1, "output_dir": "here"})
    assert a == folds.fingerprint(["y", "x"], small[0], {"k": 1, "output_dir": "there"}) != folds.fingerprint(["x"], small[0], {"k": 1})


def plain_bootstrap(series, block, replicates, seed):
    rng, means = random.Random(seed), []
    for _ in range(replicates):
        pooled = []
        for x in series.values():
            if len(x) <= block:
                pooled += x
                continue
            laid = []
            for _ in range(math.ceil(len(x) / block)):
                k = rng.randint(0, len(x) - block)
                laid += x[k : k + block]
            pooled += laid[: len(x)]
        means.append(np.mean(pooled))
    seen = np.mean([v for x in series.values() for v in x])
    return seen, 2 * seen - np.percentile(means, 95), np.mean(np.array(means) >= 2 * seen)


def test_block_bootstrap_equals_plain_python(spark):
    rng = random.Random(9)
    series = {f"f{k}": [rng.gauss(0.01, 0.05) for _ in range(n)] for k, n in enumerate((12, 7, 3, 2, 10))}
    d = spark.createDataFrame([(f, date(2000 + k // 12, k % 12 + 1, 1), v) for f, x in series.items() for k, v in enumerate(x)], "fold string, month date, delta double")
    starts = resample.draw_starts(spark, {f: len(x) for f, x in series.items()}, 3, 200, 42)
    got = resample.bootstrap(d, starts).first()
    assert (got["observed"], got["lower_bound"], got["p_value"]) == pytest.approx(plain_bootstrap(series, 3, 200, 42))
    few = resample.bootstrap(d.where("fold < 'f3'"), starts).first()
    assert few["insufficient"] and few["p_value"] is None
    assert compare.verdict(spark.createDataFrame([(0.1, 0.01, 0.01, False), (0.1, -0.1, 0.2, False), (0.1, None, None, True)], "delta double, lower_bound double, p_value double, insufficient boolean")).select("verdict").toPandas()["verdict"].tolist() == ["SUPPORTED", "NOT SUPPORTED", "PENDING"]


def test_holm_by_family(spark):
    d = spark.createDataFrame([("a", 0, 0.01), ("a", 1, 0.04), ("a", 2, 0.03), ("b", 0, 0.9), ("b", 1, 0.9)], "family string, position int, p_value double")
    found = {(r["family"], r["position"]): r["adjusted"] for r in compare.holm(d, family=("family",)).collect()}
    assert found == {("a", 0): pytest.approx(0.03), ("a", 1): pytest.approx(0.06), ("a", 2): pytest.approx(0.06), ("b", 0): 1.0, ("b", 1): 1.0}


def test_clusters_and_greedy_choice():
    far = np.array([[0, 0.1, 0.5, 0.9], [0.1, 0, 0.25, 0.9], [0.5, 0.25, 0, np.nan], [0.9, 0.9, np.nan, 0]])
    assert selection.average_linkage(list("abcd"), far, 0.2) == {"a": 0, "b": 0, "c": 1, "d": 2}
    assert selection.average_linkage(list("abcd"), far, 0.4) == {"a": 0, "b": 0, "c": 0, "d": 1}
    assert selection.greedy_uncorrelated([("a", 1.0), ("b", 2.0), ("c", 0.5)], {("a", "b"): -0.9, ("c", "a"): 0.1}) == ["b", "c"]


def test_quality_filters(spark):
    d = spark.createDataFrame([(1, "x", None, 1.0, 5), (1, "y", float("nan"), 1.0, 6), (2, "z", 1.0, 1.0, 7)], "e int, s string, a double, b double, c bigint")
    assert quality.drop_non_numeric(d, ["s"])[1] == [] and quality.drop_non_numeric(d, [])[1] == ["s"]
    assert quality.drop_missing(d, ["a", "b"])[1] == ["a"] and quality.drop_missing(d.limit(0), ["a"])[1] == []
    assert quality.column_cap(d, ["s"], 3).columns == ["s", "e", "a"]
    assert {r["feature"]: r["correlation"] for r in quality.pearson(d, ["b", "c"], "e").collect()}["b"] is None


def test_strict_lags(spark):
    d = spark.createDataFrame([(1, "s", date(2020, 1, 1), 0.1), (1, "s", date(2020, 3, 1), 0.2)], "entity int, sector string, month date, monthly_return double")
    loose, strict = (prices.lag_predictors(d, strict_month=s).orderBy("month").collect()[1]["prev_month_return"] for s in (False, True))
    assert loose == 0.1 and strict is None


def test_files(spark, tmp_path):
    d = spark.createDataFrame([(1, "train", 0.5), (2, "test", 1.5)], "entity int, split string, x double")
    fold = folds.Fold("fold_01", "final_test", (2000, 2001), (2003, 2003), (2002, 2002))
    folder = io.write_fold(d, fold, str(tmp_path), ["x"], {"rows": 2})
    assert io.discover_folds(spark, str(tmp_path))[0]["rows"] == 2
    assert spark.read.parquet(f"{folder}/panel").where("split = 'test'").count() == 1
    result = f"{tmp_path}/run/fold_01/fold_result.json"
    io.save_json(spark, result, {"winner": "b"})
    io.save_json(spark, result, {"winner": "a", "fingerprint": "f"})
    assert io.load_json(spark, result, "f")["winner"] == "a"
    assert io.load_json(spark, result, "g") is None and io.load_json(spark, f"{tmp_path}/none") is None
    assert io.load_results(spark, str(tmp_path / "run")).first()["fold"] == "fold_01"
    io.write_csv(d, str(tmp_path / "csv"), single=True)
    assert io.read_csv(spark, str(tmp_path / "csv"), "entity int, split string, x double").count() == 2
    assert io.checkpoint_table(d, str(tmp_path / "t"), ["split"]).count() == 2
    assert json.loads(open(f"{folder}/fold_metadata.json").read())["train"] == [2000, 2001]
    assert open(f"{folder}/selected_features.txt").read() == "x"
    io.write_tables({"scores": d, "clusters": d}, f"{tmp_path}/selection", "csv")
    assert io.read_csv(spark, f"{tmp_path}/selection/scores", "entity int, split string, x double").count() == 2


def test_search_improves_and_repeats():
    grammar = expr.Grammar(["a", "b", "c"], most_leaves=3)
    score = lambda es: {e: e.leaves().count("c") - 0.1 * len(e.leaves()) + ("growth" in e.families()) for e in es}
    settings = search.Settings(population=12, generations=15)
    runs = [search.search(score, grammar, settings, 7) for _ in range(2)]
    assert str(runs[0][0]) == str(runs[1][0]) and runs[0][1].best == runs[1][1].best
    assert all(a <= b for a, b in zip(runs[0][1].best, runs[0][1].best[1:], strict=False))
    assert search.random_search(score, grammar, 20, 1)[1]
    rates = [search.mutation_rate(search.Settings(schedule=s), n) for s in ("flat", "increasing", "decreasing") for n in (9, 36)]
    assert rates == pytest.approx([0.6, 0.6, 0.6, 0.1, 0.1, 0.6])
    assert search.roulette({expr.Leaf("a"): 1.0, expr.Leaf("b"): 0.0}, random.Random(0)) == expr.Leaf("a")


def test_fit_beats_the_mean(spark):
    rng = random.Random(0)
    rows = [(k, 1, x := rng.random(), rng.random(), 2 * x) for k in range(200)]
    d = spark.createDataFrame(rows, "entity int, month int, a double, b double, y double")
    p = model.fit_predict(d.where("entity < 150"), d.where("entity >= 150"), ["a", "b"], "y", ["entity", "month"], 5, 3)
    assert model.errors(p, "y").first()["rmse"] < 0.3
    mi = {r["feature"]: r["score"] for r in model.mutual_information(d, ["a", "b"], "y").collect()}
    assert mi["a"] > 2 * mi["b"]


def test_consensus_selection(spark):
    rng = random.Random(3)
    rows = []
    for k in range(150):
        a, b = rng.random(), rng.random()
        rows.append((k % 10, "s", a, a + 0.001 * rng.random(), b, rng.random(), 1.0, a + 0.5 * b))
    d = spark.createDataFrame(rows, "entity int, sector string, a double, a2 double, b double, noise double, flat double, y double")
    found = selection.select_features(d, ["a", "a2", "b", "noise", "flat"], "y", "entity", "sector", trees=10, repeats=2)
    kept = {r["feature"] for r in found["selected"].collect()}
    assert len(kept & {"a", "a2"}) == 1 and "noise" not in kept and "flat" not in kept
    assert {r["feature"]: r["stage"] for r in found["rejected"].collect()}["noise"] == "consensus"
    assert kept | {r["feature"] for r in found["rejected"].collect()} == {"a", "a2", "b", "noise", "flat"}
    flagged = selection.bottom_fraction(spark.createDataFrame([("x", 0.1), ("y", -0.5), ("z", None)], "feature string, score double"), 0.4)
    assert [r["feature"] for r in flagged.where("flagged").collect()] == ["z"]


def plain_boost(x, y, trees, depth, rate, bins):
    """Each split by looking at every cut of every input, row by row."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    made = np.full(len(y), y.mean())

    def grown(rows, left, level):
        best = (1e-12, None, None)
        for j, cuts in enumerate(edges):
            for c in cuts:
                low = [r for r in rows if x[r, j] <= c]
                high = [r for r in rows if x[r, j] > c]
                if low and high:
                    gain = sum(left[low]) ** 2 / len(low) + sum(left[high]) ** 2 / len(high) - sum(left[rows]) ** 2 / len(rows)
                    if gain > best[0] + 1e-12:
                        best = (gain, low, high)
        if level == depth or best[1] is None:
            return {r: rate * left[rows].mean() for r in rows}
        return grown(best[1], left, level + 1) | grown(best[2], left, level + 1)

    for _ in range(trees):
        step = grown(list(range(len(y))), y - made, 0)
        made = made + np.array([step[r] for r in range(len(y))])
    return made


def test_boosted_trees_equal_a_plain_version():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(80, 3)), 1)
    y = x[:, 0] + np.abs(x[:, 1]) + 0.1 * rng.normal(size=80)
    made = boost.fit(x, y, trees=4, depth=3, bins=8)
    assert made.predict(x) == pytest.approx(plain_boost(x, y, 4, 3, 0.1, 8))
    clipped = boost.fit(x, y, trees=2, clip=0.1, free=1)
    assert clipped.low[0] == -np.inf and (clipped.low[1:] == np.sort(x[:, 1:], axis=0)[7]).all()


def test_all_fits_of_a_pass_equal_one_by_one(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    rows = [(int(k), 1, *map(float, v), float(v[0] - v[2])) for k, v in enumerate(x)] + [(900, 1, None, 1.0, 2.0, 3.0), (901, 1, 1.0, float("nan"), 0.0, 1.0)]
    d = spark.createDataFrame(rows, "entity int, month int, a double, b double, c double, y double").repartition(5)
    sets = {"ab": ["a", "b"], "abc": ["a", "b", "c"], "c": ["c"]}
    models = boost.fit_all(d, sets, "y", ["entity", "month"], trees=5)
    p = boost.predict_all(d, sets, models, "y", ["entity"]).collect()
    assert {n: sum(r["model"] == n for r in p) for n in sets} == {"ab": 300, "abc": 300, "c": 302}
    again = boost.fit_all(d.repartition(2), sets, "y", ["entity", "month"], trees=5)
    assert all((models[n].values == again[n].values).all() for n in sets)
    by_id = {r["entity"]: r["prediction"] for r in p if r["model"] == "abc"}
    assert [by_id[k] for k in range(300)] == pytest.approx(models["abc"].predict(x).tolist())
    assert models["abc"].predict(x) == pytest.approx(boost.fit(x, x[:, 0] - x[:, 2], trees=5).predict(x))


@pytest.mark.parametrize("ranges", [2, 64])
def test_spearman_equals_plain_ranks(spark, monkeypatch, ranges):
    monkeypatch.setattr("causalpanel.operators.rank.RANGES", ranges)
    rng = np.random.default_rng(6)
    a, b = np.where(rng.random(400) < 0.4, 0.0, rng.normal(size=400)), np.round(rng.normal(size=400), 1)
    rank = lambda v: np.array([(v < x).sum() + (v == x).sum() / 2 for x in v])
    d = spark.createDataFrame([(float(x), float(y), 1.0) for x, y in zip(a, b, strict=True)], "a double, b double, c double")
    found = {r["b"]: (r["rho"], r["n"]) for r in spearman(d, [("a", "b"), ("a", "c")]).collect()}
    assert found["b"] == (pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1]), 400) and found["c"] == (None, 400)


def test_permutation_and_legacy_selection(spark):
    rng = random.Random(8)
    rows = [(a := rng.random(), a + 0.001 * rng.random(), rng.random(), rng.random(), 3 * a) for _ in range(200)]
    d = spark.createDataFrame(rows, "a double, a2 double, b double, noise double, y double")
    found = {r["feature"]: r["score"] for r in model.permutation_importance(d, ["a", "b"], "y", 10, 2).collect()}
    assert found["a"] > 0.3 > abs(found["b"])
    picked = selection.legacy_select(d, ["a", "a2", "b", "noise"], "y", share=0.25, trees=10, repeats=1)
    assert len({"a", "a2"} & set(picked["selected"])) == 1 and picked["weak"] and picked["correlated"]


def test_state_survives_json_and_a_run_resumes():
    grammar = expr.Grammar(["a", "b", "c"], most_leaves=3)
    score = lambda es: {e: e.leaves().count("c") - 0.1 * len(e.leaves()) for e in es}
    settings, kept = search.Settings(population=8, generations=9), []
    best, state, known = search.search(score, grammar, settings, 3, save=lambda s: kept.append(json.loads(json.dumps(search.to_json(s)))))
    asked = []
    again, state2, known2 = search.search(lambda es: asked.extend(es) or score(es), grammar, settings, 3, search.from_json(kept[3]))
    assert (again, known2, state2.best) == (best, known, state.best) and not set(asked) & set(search.from_json(kept[3]).known)


def test_lags_outside_the_vocabulary_stay_nested():
    lag = lambda k, e: expr.Temporal(expr.TemporalOp("lag", k), e)
    x = expr.Leaf("x")
    assert expr.canonical(lag(1, lag(1, x))) == lag(2, x) and expr.canonical(lag(4, lag(4, x))) == lag(4, lag(4, x))
    assert expr.canonical(lag(1, lag(4, x))) == expr.canonical(lag(4, lag(1, x))) == lag(4, lag(1, x))
    assert not expr.Grammar(["x"], most_depth=3, most_nesting=3).valid(lag(3, x)) and expr.Grammar(["x"]).valid(lag(2, x))


def test_folds_run_and_are_skipped_when_done(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    rows = []
    for e in range(12):
        for m in range(60):
            y, q = 2000 + m // 12, m // 3
            rows.append((e, date(2000 + q // 4, q % 4 * 3 + 1, 1), date(y, m % 12 + 1, 1), f := (e * 7 + q * 3) % 11 + 0.5, rng.random(), rng.random(), rng.random(), f / 50 + 0.01 * rng.random()))
    panel = spark.createDataFrame(rows, "entity int, period_end date, target_date date, f double, g double, prev_month_return double, prev_month_sector_return double, monthly_return double")
    wanted = [folds.Fold("fold_01", "development", (2000, 2001), (2002, 2002)), folds.Fold("fold_01", "final_test", (2000, 2002), (2004, 2004), (2003, 2003))]
    settings, grammar = search.Settings(population=4, generations=2), expr.Grammar(["f", "g"], most_leaves=2)
    d = run.run(panel, wanted, ["f", "g"], grammar, settings, 1, str(tmp_path), random_draws=2, trees=5)
    first = sorted(map(str, d.collect()))
    assert len(first) == 6 and {r["predictor"] for r in d.collect()} == {"winner", "base_a", "base_c"}
    assert next(r for r in d.collect() if r["predictor"] == "winner" and r["category"] == "final_test")["mean_ic"] > 0.5
    assert spark.read.parquet(f"{tmp_path}/final_test/fold_01/predictions").groupBy("model").count().count() == 3
    monkeypatch.setattr(search, "search", None)  # nothing is searched again
    assert sorted(map(str, run.run(panel, wanted, ["f", "g"], grammar, settings, 1, str(tmp_path), random_draws=2, trees=5).collect())) == first


def test_sweep(spark):
    rows = run.sweep(lambda chosen, made, arm: made.population / 10 + (arm == "on") * chosen["trees"], {"population": [4, 8], "trees": [1, 2]}, search.Settings())
    assert len(rows) == 8
    d = spark.createDataFrame([(r["trees"], r["arm"], r["mean_ic"]) for r in rows], "trees int, arm string, mean_ic double")
    table = {r["trees"]: r for r in reporting.sweep_table(d, "trees").collect()}
    assert table[2]["best"] and not table[1]["best"] and table[1]["objective"] == pytest.approx(1.1)


def test_cross_section_has_exact_quantiles(spark):
    rng = random.Random(3)
    months = {date(2020, 1, 1): 60_000, date(2020, 2, 1): 20, date(2020, 3, 1): 1, None: 7}
    rows = [(m, rng.gauss(0, 1) if rng.random() < 0.9 else 0.25) for m, n in months.items() for _ in range(n)]
    rows += [(date(2020, 1, 1), None), (date(2020, 4, 1), None)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "m date, x double").repartition(8)
    found = {r["month"]: r for r in profile.cross_section(d, "m", "x").collect()}
    assert set(found) == {*months, date(2020, 4, 1)}
    for m, n in months.items():
        x = sorted(v for k, v in rows if k == m and v is not None)
        assert found[m]["n"] == n and found[m]["mean"] == pytest.approx(sum(x) / n)
        assert [found[m][c] for c in ("low", "median", "high")] == [x[-(-n * p // 100) - 1] for p in (5, 50, 95)]
    assert found[date(2020, 4, 1)][1:] == (0, None, None, None, None, None)
