import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave import queries, reports, runner
from kinweave.functions import similarity as S
from kinweave.operators import linkage as L
from kinweave.operators import profile, stages, tuning
from kinweave.plans import matcher
from kinweave.sources import stage, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def world_and_rows(spark):
    return queries.scored(spark, SF)


def test_batched_similarities_equal_the_single_ones():
    rng = np.random.default_rng(3)
    text = lambda: "".join(rng.choice(list("abcdé "), rng.integers(0, 150)))
    pairs = [(text(), text()) for _ in range(150)] + [("", ""), ("", "a"), ("x" * 64, "x" * 130)]
    assert S.indels(pairs) == pytest.approx([S.indel(*p) for p in pairs])
    assert S.partials(pairs[:40]) == pytest.approx([S.partial(*p) for p in pairs[:40]])
    assert S.token_sets([("a b c", "c a"), ("a b", "c d"), ("", "")]) == pytest.approx([1.0, S.indel("a b", "c d"), 1.0])


def plain_rule(rows, rule):
    """The decisions of a rule by loops over rows (q, p, src, score)."""
    best, by_query = {}, {}
    for q, p, _, s in rows:
        best[p] = min(best.get(p, (1, 0)), (-s, q))
        by_query.setdefault(q, []).append((-s, p))
    place = {(q, p): k for q, own in by_query.items() for k, (_, p) in enumerate(sorted(own), 1)}
    left = [r for r in rows if r[3] >= (rule.t_s2 if r[2] == 2 else rule.t_s3) and (not rule.exclusive or best[r[1]] == (-r[3], r[0])) and (not rule.top_n or place[r[0], r[1]] <= rule.top_n)]
    top = {}
    for q, _, _, s in left:
        top[q] = max(top.get(q, 0), s)
    return {(q, p) for q, p, _, s in left if top[q] >= rule.t_anchor and s >= rule.rel * top[q]}


def macro(chosen, true, queries_):
    total = 0.0
    for q in queries_:
        pred, want = {p for a, p in chosen if a == q}, {p for a, p in true if a == q}
        hit = len(pred & want)
        total += 1.0 if not pred and not want else 0.0 if not hit else 1.25 * (hit / len(pred)) * (hit / len(want)) / (0.25 * hit / len(pred) + hit / len(want))
    return total / len(queries_)


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(8)
    rows = {(int(q), int(p)): (2 + int(p) % 2, round(float(rng.random()), 2)) for q, p in zip(rng.integers(0, 15, 120), rng.integers(100, 140, 120), strict=True)}
    rows = [(q, p, src, s) for (q, p), (src, s) in sorted(rows.items())]
    true = {(q, p) for q, p, _, s in rows if rng.random() < s * s}
    frame = spark.createDataFrame([(q, p, src, s, int((q, p) in true)) for q, p, src, s in rows], "q_id long, p_id long, src int, p double, y int")
    judged = spark.createDataFrame([(q, sum(a == q for a, _ in true)) for q in range(17)], "q_id long, n_true long")
    return rows, true, frame, judged


def test_rules_score_as_loops_do(small):
    rows, true, frame, judged = small
    rules = [L.Rule(a, b, e, n, t, r) for a, b, e, n, t, r in itertools.product((0.2, 0.6), (0.4,), (False, True), (0, 2), (0.0, 0.7), (0.0, 0.8))]
    got = tuning.rule_scores(tuning.placed(frame), judged, rules)
    assert got == pytest.approx([macro(plain_rule(rows, r), true, range(17)) for r in rules])
    for rule in rules[:4]:
        assert {(r["q_id"], r["p_id"]) for r in tuning.apply_rule(frame, rule).collect()} == plain_rule(rows, rule)


def test_staged_tuning_never_loses_and_reports_its_trials(small):
    rows, true, frame, judged = small
    own = tuning.placed(frame).persist()
    _, first = tuning.tune_global(own, judged)
    rule, score, history = tuning.tune_staged(own, judged)
    assert score >= first - 1e-4 and score == pytest.approx(macro(plain_rule(rows, rule), true, range(17)))
    assert score >= max(h["f05"] for h in history) - 1e-4 - 1e-6 or score == pytest.approx(max(h["f05"] for h in history), abs=2e-4)
    assert {h["stage"][0] for h in history} == set("12345")


def test_expected_tuning_against_loops(small):
    rows, true, frame, judged = small
    best, score = tuning.tune_expected(tuning.placed(frame, 0.0), judged)
    chosen = {(r["q_id"], r["p_id"]) for r in tuning.apply_rule(frame, best).collect()}
    assert score == pytest.approx(macro(chosen, true, range(17)))
    want = set()
    for q in range(17):
        own = sorted(((-s, p) for a, p, _, s in rows if a == q))
        k, _ = L.expected_f05(np.array([-s for s, _ in own]), best["extra"], best["power"]) if own else (0, 0)
        want |= {(q, p) for _, p in own[:k]}
    if not best["exclusive"]:
        assert chosen == want
    assert tuning.choose_rule(frame, judged)[0] in ("global", "staged", "expected")


def test_choose_cut_and_blend(spark, small):
    points = spark.createDataFrame([(0, 0, 0.1, 9.0, 0.95), (0, 2, 0.1, 4.0, 0.9495), (0, 1, 0.1, 2.0, 0.90)], "m_pool int, n_max int, t double, cand double, oracle double")
    assert tuning.choose_cut(points, 0.95, 0.001)["n_max"] == 2 and tuning.choose_cut(points, 0.99, 0.001)["n_max"] == 0
    _, _, frame, judged = small
    two = frame.withColumns({"good": F.col("p"), "bad": F.rand(3)})
    weights = tuning.blend(["good", "bad"], two, judged, most=3)
    assert weights["good"] >= 1 and sum(weights.values()) <= 3


def test_integrity_finds_planted_faults(spark):
    rows = spark.createDataFrame([("S2-1", "a", "", "us"), ("S2-1", "a", "", "us"), ("S2-x", " ", "n/a", "zz"), ("S3-4", "N/A", "1 null rd", "us")], "entity_id string, name string, addr string, country string")
    got = {r["check"]: r["n"] for r in profile.integrity(rows, "S2", spark.createDataFrame([("us",)], "country string")).collect()}
    assert {k: v for k, v in got.items() if v} == {"rows": 4, "name_blank": 1, "name_placeholder": 1, "addr_empty": 2, "addr_placeholder": 1, "addr_null_token": 2, "malformed_ids": 1, "wrong_prefix": 1, "dup_ids": 1, "dup_rows": 1, "dup_records": 1, "unseen_countries": 1}


def test_truth_integrity_finds_planted_faults(spark):
    truth = spark.createDataFrame([("S1-1", "S2-1,S2-1, S3-2"), ("S1-1", ""), ("S1-9", "S2-1,,S4-1"), ("S1-3", " ")], "source1_entity_id string, matched_entity_ids string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "entity_id string")
    got = {r["check"]: r["n"] for r in profile.truth_integrity(truth, ids("S1-1", "S1-2", "S1-3"), ids("S2-1", "S3-2")).collect()}
    assert got == {"rows": 4, "empty_rows": 2, "empty_tokens": 1, "ids_with_blanks": 1, "bad_format": 1, "invalid_refs": 1, "matched_ids": 4, "s1_unknown": 1, "s1_missing": 1, "dup_s1_rows": 1, "dup_within_row": 1, "ids_of_several_s1": 1}


def test_submission_check_names_each_kind_of_error(spark):
    header = ("source1_entity_id", "matched_entity_ids")
    lines = lambda *x: spark.createDataFrame(list(enumerate(x, 1)), "line_number long, value string")
    required = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "entity_id string")
    valid = spark.createDataFrame([("S2-1",), ("S3-1",)], "entity_id string")
    found = lambda *x: {(r["error"], r["offender"]) for r in profile.check_submission(lines(*x), header, required, valid).collect()}
    head = "Source1_entity_id\t matched_entity_ids"
    assert found(head, "S1-1\tS2-1,S3-1", "S1-2\t", "S1-3\t ") == set()
    assert found(head, "S1-1\tS2-1,S2-1,S1-2,X", "S1-1\tS2-7", "oops", "", "S1-8\t") == {("duplicate_row", "S1-1"), ("duplicate_id", "S1-1"), ("self_match", "S1-2"), ("wrong_prefix", "X"), ("unknown_id", "S2-7"), ("malformed_row", "4"), ("missing_s1", "S1-2"), ("missing_s1", "S1-3"), ("extra_s1", "S1-8")}
    assert {e for e, _ in found("a,b")} == {"comma_separated"} and {e for e, _ in found("a\tb")} == {"bad_header"}
    pairs = lambda *x: spark.createDataFrame(list(x), "q_id long, p_id long")
    assert profile.matches_within(pairs((1, 2), (1, 3)), pairs((1, 2))).count() == 1


def test_pruning_steps(spark, small):
    rows, _, frame, _ = small
    kept, loss = stages.prune_safe_zone(frame, ["p"], ["p"], max_loss=1.0)
    assert kept.count() == sum(s >= 0.2 for *_, s in rows) and 0 <= loss <= 1
    assert stages.prune_safe_zone(frame.withColumn("y", F.lit(1)), ["p"], ["p"], 0.0)[0].count() == len(rows)
    band = stages.uncertain_band(frame, 0.3, 0.7, 3, 5).collect()
    assert len(band) == 5 and all(0.3 <= r["p"] <= 0.7 for r in band)
    assert "n_lev" not in stages.without_groups(frame.withColumns({"n_lev": F.lit(1), "a_x": F.lit(1)}), ["name"]).columns
    capped = tables.cap_rows_by_query(frame, 40)
    whole = frame.groupBy("q_id").count()
    assert capped.count() <= 40 and capped.groupBy("q_id").count().join(whole, ["q_id", "count"]).count() == capped.select("q_id").distinct().count()
    assert stages.without_context(frame.withColumn("x_gap", F.lit(1))).columns == frame.columns


def test_matchers_score_out_of_fold(world_and_rows):
    w, rows = world_and_rows
    for kind in ("lr", "forest"):
        got = matcher.out_of_fold(w, rows, kind)
        assert got.count() == rows.count() and got.filter("probability IS NULL").isEmpty()
    kept, cut = matcher.prune(w, rows, kind="lr")
    assert 0 < kept.count() <= rows.count() and set(cut) == {"t", "n_max", "m_pool"}
    assert matcher.refit_rounds(10) == 50 and matcher.refit_rounds(100) == 115


def test_world_and_lists_are_saved(spark, tmp_path, world_and_rows):
    w, rows = world_and_rows
    tables.save_world(w, f"{tmp_path}/world")
    again = tables.load_world(spark, f"{tmp_path}/world")
    assert again.queries.count() == w.queries.count() and again.truth.count() == w.truth.count()
    lists = tables.id_lists(w.queries, L.decide(rows, queries.RULE))
    tables.write_id_lists(lists, f"{tmp_path}/lists")
    (file,) = (tmp_path / "lists").glob("part-*")
    text = file.read_text().split("\n")
    assert text[0] == "source1_entity_id\tmatched_entity_ids" and len(text) == w.queries.count() + 2
    ids = [int(line.split("\t")[0]) for line in text[1:-1]]
    assert ids == sorted(ids)
    small = tables.mini(w, 10, 50)
    assert small.queries.count() == 10 and small.truth.join(small.pool.select(F.col("id").alias("p_id")), "p_id", "left_anti").isEmpty()


def test_tsv_with_line_breaks_and_padded_headers(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('entity_id\t business_name \tbusiness_address\tcountry\nS1-1\t"A\nB"\tx\tUS\nS1-2\tC\ty\tUS\n')
    rows = tables.read_tsv(spark, str(tmp_path / "s.tsv"), tables.RECORD)
    assert [r["business_name"] for r in rows.collect()] == ["A\nB", "C"] and tables.read_tsv(spark, str(tmp_path / "s.tsv"), tables.RECORD, 1).count() == 1


def test_runner(spark, tmp_path):
    config = runner.configured(runner.Config(), ["rule.top_n=2", "matching.kind=lr"])
    assert config.rule.top_n == 2 and config.matching.kind == "lr" and runner.config_id(config) != runner.config_id(runner.Config())
    with pytest.raises(KeyError):
        runner.configured(runner.Config(), ["rule.no=1"])
    rows = runner.run_plan(spark, SF, "short", str(tmp_path))
    assert [r["exp"] for r in rows] == ["blocking", "rule"] and not any("error" in r for r in rows)
    board = runner.leaderboard(spark, str(tmp_path)).collect()
    assert board[0]["exp"] == "rule" and board[0]["f05"] > 0 and (tmp_path / "rule.md").exists()


def test_stage_is_written_once(spark):
    calls = []
    build = lambda: (calls.append(1), spark.range(3).toDF("id"))[1]
    path = f"{SF}/region.parquet"
    assert stage.saved(spark, "t", [path], build).count() == stage.saved(spark, "t", [path], build).count() == 3 and len(calls) == 1
    a, b = spark.range(5).toDF("id"), spark.range(4, -1, -1).toDF("id")
    assert stage.pool_signature(a).first() == stage.pool_signature(b).first() != stage.pool_signature(a.limit(4)).first()


def test_unknown_country_searches_the_whole_pool(spark):
    rows = lambda x: spark.createDataFrame(x, "id long, country string, space string, token string, w double")
    got = L.sparse_scores(rows([(1, "us", "ntok", "a", 1.0), (2, "zz", "ntok", "a", 1.0)]), rows([(10, "us", "ntok", "a", 1.0), (11, "fr", "ntok", "a", 0.5)]))
    assert {(r["q_id"], r["p_id"]): r["score"] for r in got.collect()} == {(1, 10): 1.0, (2, 10): 1.0, (2, 11): 0.5}


def test_sparse_top_is_the_ranked_scores(spark):
    rng = np.random.default_rng(5)
    own = lambda ids, countries: [(int(i), countries[i % len(countries)], s, f"t{t}", float(rng.uniform(0.1, 1))) for i in ids for s in ("a", "b") for t in sorted({*rng.integers(0, 12, 4).tolist()})]
    rows = lambda x: spark.createDataFrame(x, "id long, country string, space string, token string, w double")
    queries, pool = rows(own(range(60), ["us", "fr", None, "zz"])), rows(own(range(100, 190), ["us", "fr", None]))
    take = lambda df: sorted(map(tuple, df.select("q_id", "p_id", "rank", "score").collect()))
    scores = L.sparse_scores(queries, pool).withColumn("score", F.round("score", 6))
    vectors = L.sparse_vectors(queries), L.sparse_vectors(pool)
    assert take(L.sparse_top(*vectors, 3)) == take(L.sparse_top(*vectors, 3, block=7)) == take(L.ranked(scores, 3))
    assert take(L.sparse_top(vectors[0].limit(0), vectors[1], 3)) == take(L.sparse_top(vectors[0], vectors[1].limit(0), 3)) == []


def test_names_are_matched_without_dealing_pairs(spark):
    plan = queries._cosine_top(spark, SF, queries.NAMES)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "qw" not in plan


def test_combined_records_come_in_parts(spark):
    plan = queries.er_tfidf_combined(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "qw" not in plan


def test_dense_top_holds_few_scores(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(k, rng.integers(-3, 4, 4).astype(float).tolist()) for k in range(400)], "id long, vector array<double>")  # ties
    take = lambda: sorted(map(tuple, L.dense_top(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), 5).select("q_id", "p_id", "rank", "score").collect()))
    whole = take()
    monkeypatch.setattr(L, "DENSE_CELLS", 1000)
    assert take() == whole and len(whole) == 1000


def test_pass_plan_counts_key_pairs(spark, monkeypatch, world_and_rows):
    w, _ = world_and_rows
    names = queries.er_tfidf_names(spark, SF)
    keys = L.key_join(L.block_keys(w.queries), L.block_keys(w.pool), max_block=None)
    ranked = [("C", k, names.filter(F.col("rank") < k)) for k in (1, 5)]
    formed = L.pass_plan([(k, None, keys.filter(F.col("kind") == k)) for k in "ABK"] + ranked, w.truth, w.queries.count(), most=20, least_gain=0)
    counted = L.pass_plan([(k, None, None) for k in "ABK"] + ranked, w.truth, w.queries.count(), most=20, least_gain=0, keys=tuple(L.single_keys(df, ("A", "B", "K")) for df in (w.queries, w.pool)))
    assert formed == counted and counted
    monkeypatch.setattr(L, "key_join", None)
    assert not queries.er_pass_plan(spark, SF).isEmpty()


def test_partials_scan_all_starts_and_ends_at_once(monkeypatch):
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcd é"), n))
    pairs = [(word(rng.integers(0, 150)), word(rng.integers(0, 150))) for _ in range(60)]
    expected, single, measured = [S.partial(*p) for p in pairs], S.common_lengths, []
    monkeypatch.setattr(S, "common_lengths", lambda own: (measured.extend(own), single(own))[1])
    assert S.partials(pairs).tolist() == expected
    assert len(measured) < sum(abs(len(a) - len(b)) for a, b in pairs)
    monkeypatch.setattr(S, "MASKS", 500)
    assert S.partials(pairs).tolist() == expected


def test_fuzzy_features_read_the_pairs_once(spark, world_and_rows):
    plan = reports.er_fuzzy_features(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 6 and "HashAggregate" not in plan


def test_stacking_fits_on_a_written_table(spark, monkeypatch):
    seen, fitted = [], []
    monkeypatch.setattr(queries, "staged", lambda s, d, name, build, real=queries.staged: (seen.append(name), real(s, d, name, build))[1])
    monkeypatch.setattr(matcher, "out_of_fold", lambda w, rows, features=matcher.FEATURES: (fitted.append(rows), rows.withColumns({"probability": F.lit(0.5), "fold": F.lit("fit")}).select(*matcher.OUT))[1])
    assert not reports.er_stacking(spark, SF).isEmpty()
    assert seen[-1] == "stacked" and "ArrowEvalPython" not in fitted[-1]._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["er_fuzzy_features", "er_second_stage_support", "er_error_categories", "er_scripts"])
def test_rows_only_reports(spark, name):
    assert not reports.QUERIES[name](spark, SF).isEmpty()
