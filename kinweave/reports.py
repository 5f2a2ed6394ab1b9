"""Queries over pair features, contexts, rule tuning, integrity and profiles, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import constants as C
from kinweave import queries as Q
from kinweave.operators import features, profile, stages, tuning
from kinweave.operators import linkage as L
from kinweave.sources import tables

SPACES = tuple(features.BLOCKS)
CUTS = ([0, 4], [0, 1, 2, 5], [0.05, 0.2, 0.4, 0.6])
SOURCE_GRID = [round(0.3 + 0.05 * k, 2) for k in range(11)]


def featured(spark: SparkSession, sf_dir: str) -> tuple[tables.World, DataFrame, int]:
    """The world with token vectors and commonness, the scored pairs, and the pool's size."""
    w, rows = Q.scored(spark, sf_dir)
    n = w.pool.count()
    own = lambda name, df: Q.staged(spark, sf_dir, f"vectors-{name}", lambda: features.vectors(features.commonness(df, w.queries, w.pool), w.pool, n))
    return tables.World(own("queries", w.queries), own("pool", w.pool), w.truth), rows, n


def _six(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


def er_token_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, rows, n = featured(spark, sf_dir)
    got = features.token_measures(rows.select("q_id", "p_id"), w.queries, w.pool, n)
    return got.select("q_id", "p_id", "space", "shared", "rare_shared", "n1", "n2", "set_eq", *[(F.round(c, 6) + 0.0).alias(c) for c in ("uq_idf", "up_idf")], *_six("jacc", "overlap", "wjacc", "cos", "uq_max", "up_max", "u_minmax", "u_maxmax"))


def er_record_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, rows, _ = featured(spark, sf_dir)
    got = features.record_measures(rows.select("q_id", "p_id"), w.queries, w.pool)
    exact = {"q_id", "p_id"} | {c for c, t in got.dtypes if t == "int"}
    return got.select(*[F.col(c) if c in exact else F.round(c, 6).alias(c) for c in got.columns])


def er_fuzzy_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, rows = Q.scored(spark, sf_dir)
    return features.fuzzy_measures(rows.select("q_id", "p_id"), w.queries, w.pool)


def er_pool_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = Q.scored(spark, sf_dir)
    got = stages.name_copies(stages.pool_context(rows, ["p", "n_tok_jacc", "a_tok_jacc"]))
    ranks = [F.col(f"fe_p_{c}_rank").cast("long").alias(f"fe_p_{c}_rank") for c in ("p", "n_tok_jacc", "a_tok_jacc")]
    return got.select("q_id", "p_id", "fe_p_ncand", "fe_dup_name_same_src", "fe_dup_name_any_src", *ranks, *_six(*[f"fe_p_{c}_gap" for c in ("p", "n_tok_jacc", "a_tok_jacc")]))


def er_second_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, rows, _ = featured(spark, sf_dir)
    got = stages.support(stages.second_stage(rows.select("q_id", "p_id", "src", "p")), w.pool, fuzzy=False)
    return got.select("q_id", "p_id", F.col("p1_rank").cast("long").alias("p1_rank"), "p1_qmax", *_six("p1_gap"), "p1_q_n50", "p1_src_n50", "xsrc_id", "xsrc_p1", "ssrc_id", "ssrc_p1", *_six("xsrc_char", "ssrc_char"))


def er_second_stage_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, rows, _ = featured(spark, sf_dir)
    return stages.support(stages.second_stage(rows.select("q_id", "p_id", "src", "p")), w.pool)


def er_safe_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs, and true ones, the safe zone would drop."""
    _, rows = Q.scored(spark, sf_dir)
    safe = stages.in_safe_zone(["n_tok_jacc"], ["a_tok_jacc", "a_num_jacc"])
    return rows.groupBy(safe.alias("safe")).agg(F.count("*").alias("n"), F.sum("y").alias("hits"))


def er_random_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Q.world(spark, sf_dir)
    return stages.random_pairs(w.queries, w.pool, 2)


def er_similarity_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each overlap tells true pairs from random pairs of the country."""
    w = Q.world(spark, sf_dir)
    random = stages.random_pairs(w.queries, w.pool, 2).join(w.truth, ["q_id", "p_id"], "left_anti")
    pairs = w.truth.withColumn("y", F.lit(1)).unionByName(random.withColumn("y", F.lit(0)))
    rows = profile.overlap_measures(L.with_records(pairs, w.queries, w.pool, ["ntok", "nchar", "nskel", "atok", "anum", "abig"]))
    out = None
    for c in ("tokens", "grams", "skeletons", "addr_tokens", "bigrams"):
        row = L.auc(rows.select(F.coalesce(f"j_{c}", F.lit(0.0)).alias("p"), "y")).select(F.lit(c).alias("measure"), "auc")
        out = row if out is None else out.unionByName(row)
    return out


def er_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False pairs that each pass proposes, and true ones beside them: where hard examples come from."""
    w = Q.world(spark, sf_dir)
    mined = Q.key_pairs(w, ("A", "B", "K", "S")).unionByName(Q.er_tfidf_names(spark, sf_dir).select(F.lit("C").alias("kind"), "q_id", "p_id")).unionByName(stages.random_pairs(w.queries, w.pool, 2).select(F.lit("random").alias("kind"), "q_id", "p_id"))
    marked = mined.join(w.truth.withColumn("y", F.lit(1)), ["q_id", "p_id"], "left")
    return marked.groupBy("kind").agg(F.count("*").alias("n"), F.count("y").alias("n_true"), F.sum(F.when(F.col("y").isNull(), 1).otherwise(0)).alias("n_hard"))


def er_missed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, _ = Q.scored(spark, sf_dir)
    return stages.missed_pairs(w.truth, Q.er_tfidf_addresses(spark, sf_dir).filter("rank < 1"), w.queries, w.pool)


def n_true(w: tables.World, fold: str | None = None) -> DataFrame:
    """q_id, n_true of the queries of a fold, or of all."""
    rows = tables.folds(w.queries.select("id"))
    rows = rows if fold is None else rows.filter(F.col("fold") == fold)
    counts = w.truth.groupBy("q_id").agg(F.count("*").alias("n_true"))
    return rows.select(F.col("id").alias("q_id")).join(counts, "q_id", "left").fillna(0, ["n_true"])


def fold_rows(w: tables.World, rows: DataFrame, fold: str) -> tuple[DataFrame, DataFrame]:
    judged = n_true(w, fold)
    return rows.select("q_id", "p_id", "src", "p", "y").join(judged.select("q_id"), "q_id", "left_semi"), judged


def er_tune_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro F0.5 of each threshold over the tuning fold."""
    w, rows = Q.scored(spark, sf_dir)
    own, judged = fold_rows(w, rows, "tune")
    scores = tuning.rule_scores(tuning.placed(own), judged, [L.Rule(t, t) for t in tuning.T_GRID])
    return spark.createDataFrame([(t, round(f, 6)) for t, f in zip(tuning.T_GRID, scores, strict=True)], "t double, f05 double")


def er_tune_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro F0.5 over the tuning fold by the sources' thresholds, exclusive, with an anchor and a share of the best."""
    w, rows = Q.scored(spark, sf_dir)
    own, judged = fold_rows(w, rows, "tune")
    grid = [(a, b) for a in SOURCE_GRID for b in SOURCE_GRID]
    scores = tuning.rule_scores(tuning.placed(own), judged, [L.Rule(a, b, True, 0, 0.6, 0.8) for a, b in grid])
    return spark.createDataFrame([(a, b, round(f, 6)) for (a, b), f in zip(grid, scores, strict=True)], "t_s2 double, t_s3 double, f05 double")


def er_rule_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of rule tuned on the tuning fold, their F0.5 there and on the fold held back."""
    w, rows = Q.scored(spark, sf_dir)
    tune, judged = fold_rows(w, rows, "tune")
    hold, others = fold_rows(w, rows, "hold")
    own = tuning.placed(tune).persist()
    found = {"global": tuning.tune_global(own, judged), "staged": tuning.tune_staged(own, judged)[:2], "expected": tuning.tune_expected(own, judged)}
    out = []
    for kind, (rule, score) in found.items():
        chosen = tuning.apply_rule(hold, rule).join(w.truth.withColumn("y", F.lit(1)), ["q_id", "p_id"], "left").groupBy("q_id").agg(F.count("*").alias("n_pred"), F.count("y").alias("n_hit"))
        f = others.join(chosen, "q_id", "left").fillna(0, ["n_pred", "n_hit"]).agg(F.avg(tuning.f05(F.col("n_true"), F.col("n_pred"), F.col("n_hit")))).first()[0]
        out.append((kind, str(asdict(rule) if isinstance(rule, L.Rule) else rule), round(score, 6), None if f is None else round(f, 6)))
    own.unpersist()
    return spark.createDataFrame(out, "kind string, rule string, tune_f05 double, hold_f05 double")


def er_cut_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, rows = Q.scored(spark, sf_dir)
    own, judged = fold_rows(w, rows, "tune")
    ranked = stages.rank_gap(stages.rank_gap(own, "p", "q_id", "_q"), "p", "p_id", "_p").withColumnsRenamed({"_q_rank": "qr", "_p_rank": "pr"})
    got = tuning.cut_frontier(ranked, judged, *CUTS)
    return got.select(F.col("m_pool").cast("long").alias("m_pool"), F.col("n_max").cast("long").alias("n_max"), "t", *_six("cand"), "p50", F.round("p95", 6).alias("p95"), "most", *_six("pair_recall", "oracle"))


def er_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro figures of an oracle that chooses just the true candidates, by fold."""
    w, rows = Q.scored(spark, sf_dir)
    folds = tables.folds(w.queries.select("id")).select(F.col("id").alias("q_id"), "fold")
    return L.metrics(L.per_query(w.queries, rows.filter("y = 1"), w.truth).join(folds, "q_id"), ("fold",))


def er_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.calibration(Q.scored(spark, sf_dir)[1])


def er_score_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.quantiles(Q.scored(spark, sf_dir)[1])


def er_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.correlations(Q.scored(spark, sf_dir)[1], ["p", "n_lev", "n_tok_jacc", "n_tok_over", "y"])


def er_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Q.world(spark, sf_dir)
    return profile.singletons(w.queries, L.token_spaces(w.pool, ("ntok",)), w.truth)


def er_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, rows = Q.scored(spark, sf_dir)
    return profile.strength(w.queries, rows, w.truth)


def er_country_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, rows = Q.scored(spark, sf_dir)
    return profile.country_diagnostics(w.queries, rows, L.decide(rows, Q.RULE))


def er_source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Q.world(spark, sf_dir)
    rows = w.queries.withColumn("src", F.lit(1)).unionByName(w.pool)
    return profile.source_profile(rows.withColumn("country", F.coalesce("country", F.lit(""))))


def er_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Q.world(spark, sf_dir)
    return profile.scripts(w.queries.unionByName(w.pool.drop("src")))


def er_representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Q.world(spark, sf_dir)
    return profile.representations(w.queries, w.pool, w.truth, ["name", "n_basic", "n_core", "n_squash", "n_skel"])


def er_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, rows = Q.scored(spark, sf_dir)
    return profile.anchors(L.with_records(rows.select("q_id", "p_id"), w.queries, w.pool, ["a_canon"]))


def er_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pool as one source, with the queries' countries as the known ones."""
    w = Q.world(spark, sf_dir)
    rows = w.pool.select(F.concat(F.lit("S"), F.col("src"), F.lit("-"), F.col("id")).alias("entity_id"), "name", "addr", F.coalesce("country", F.lit("")).alias("country"))
    return profile.integrity(rows, "S2", w.queries.select(F.coalesce("country", F.lit("")).alias("country")))


def er_truth_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the truth as a table of id lists, the pool's second source alone standing for the known ids."""
    w = Q.world(spark, sf_dir)
    pool = w.pool.select(F.col("id").alias("p_id"), F.concat(F.lit("S"), F.col("src"), F.lit("-"), F.col("id")).alias("entity_id"), "src")
    lists = w.truth.join(pool, "p_id").groupBy("q_id").agg(F.array_join(F.array_sort(F.collect_list("entity_id")), ",").alias("matched_entity_ids"))
    truth = w.queries.select(F.col("id").alias("q_id")).join(lists, "q_id", "left").select(F.concat(F.lit("S1-"), F.col("q_id")).alias("source1_entity_id"), F.coalesce("matched_entity_ids", F.lit("")).alias("matched_entity_ids"))
    return profile.truth_integrity(truth, w.queries.select(F.concat(F.lit("S1-"), F.col("id")).alias("entity_id")), pool.filter("src = 2"))


def er_submission_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the decisions as a file, with the English queries required and the second source's ids valid."""
    w, rows = Q.scored(spark, sf_dir)
    named = L.decide(rows, Q.RULE).select("q_id", F.concat(F.lit("S"), F.col("src"), F.lit("-"), F.col("p_id")).alias("id"))
    lists = named.groupBy("q_id").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    lines = w.queries.select(F.col("id").alias("q_id")).join(lists, "q_id", "left").select((F.col("q_id") + 2).alias("line_number"), F.concat(F.lit("S1-"), F.col("q_id"), F.lit("\t"), F.coalesce("ids", F.lit(""))).alias("value"))
    head = spark.createDataFrame([(1, "source1_entity_id\tmatched_entity_ids")], "line_number long, value string")
    named_ids = lambda df, src: df.select(F.concat(F.lit(f"S{src}-"), F.col("id")).alias("entity_id"))
    return profile.check_submission(lines.unionByName(head), ("source1_entity_id", "matched_entity_ids"), named_ids(w.queries.filter("country = 'en'"), 1), named_ids(w.pool.filter("src = 2"), 2))


def er_error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Falsely chosen pairs by six rules, and missed ones by eight: the first that fits."""
    w, rows, n = featured(spark, sf_dir)
    chosen = L.decide(rows, Q.RULE).select("q_id", "p_id").withColumn("chosen", F.lit(1))
    every = rows.select("q_id", "p_id").withColumn("in_candidates", F.lit(True)).join(w.truth.withColumn("y", F.lit(1)), ["q_id", "p_id"], "full").join(chosen, ["q_id", "p_id"], "left").filter("(chosen IS NULL) = (y IS NOT NULL)")
    pairs = every.select("q_id", "p_id")
    names = features.token_measures(pairs, w.queries, w.pool, n).filter("space = 'ntok'").select("q_id", "p_id", "shared", "rare_shared")
    wide = every.withColumn("in_candidates", F.coalesce("in_candidates", F.lit(False))).join(features.record_measures(pairs, w.queries, w.pool), ["q_id", "p_id"]).join(features.fuzzy_measures(pairs, w.queries, w.pool), ["q_id", "p_id"]).join(names, ["q_id", "p_id"])
    kind = F.when(F.col("y").isNull(), profile.fuzzy_taxonomy(False)).otherwise(profile.fuzzy_taxonomy(True))
    return wide.groupBy(F.when(F.col("y").isNull(), "false").otherwise("missed").alias("error"), kind.alias("category")).agg(F.count("*").alias("n"))


def er_pruner(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinweave.plans import matcher

    w, rows = Q.scored(spark, sf_dir)
    scores = matcher.out_of_fold(w, rows, features=matcher.CHEAP)
    pruned = L.stage_one_cut(scores.select("q_id", "p_id", "fold", "y", F.col("probability").alias("p")), 0.02, 10, 10)
    return pruned


def er_stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second stage's probabilities: fitted on first-stage ones that no model gave to pairs it was fitted on."""
    from kinweave.plans import matcher

    w, rows, _ = featured(spark, sf_dir)
    features_ = [*matcher.FEATURES, "p1_rank", "p1_gap", "p1_q_n50", "p1_src_n50", "xsrc_p1", "xsrc_support", "ssrc_p1", "ssrc_support", "xsrc_known"]

    def build() -> DataFrame:
        first = matcher.out_of_fold(w, rows).select("q_id", "p_id", F.col("probability").alias("p1"))
        table = rows.select("q_id", "p_id", "src", "y", *matcher.FEATURES).join(first, ["q_id", "p_id"])
        second = stages.support(stages.second_stage(table.withColumn("p", F.col("p1"))), w.pool)
        return second.withColumn("xsrc_known", F.col("xsrc_p1").isNotNull().cast("int")).select("q_id", "p_id", "src", "y", *features_)

    # the fits read the table many times: it is written once
    return matcher.out_of_fold(w, Q.staged(spark, sf_dir, "stacked", build), features=features_)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for name, f in list(globals().items()) if name.startswith("er_")}


# ---- SQL

_FEATURED = rf"""{Q.SCORED},
tokw AS (SELECT s.id, s.space, s.token, coalesce(df, 0) AS df, coalesce(idf, ln(n + 1.0::DOUBLE) + 1.0) AS w FROM spaces s LEFT JOIN stats USING (space, token), size),
sides AS (SELECT id, space, count(*) AS n, sum(w) AS w, sum(w * w) AS w2 FROM tokw GROUP BY ALL),
bothw AS (SELECT q_id, p_id, a.space, count(*) AS k, sum(a.w) AS w, sum(a.w * a.w) AS w2, count(*) FILTER (a.df <= 50) AS rare FROM pairs JOIN tokw a ON a.id = q_id JOIN tokw b ON b.id = p_id AND b.space = a.space AND b.token = a.token GROUP BY ALL),
onlyq AS (SELECT q_id, p_id, a.space, max(a.w) AS m FROM pairs JOIN tokw a ON a.id = q_id ANTI JOIN tokw b ON b.id = p_id AND b.space = a.space AND b.token = a.token GROUP BY ALL),
onlyp AS (SELECT q_id, p_id, a.space, max(a.w) AS m FROM pairs JOIN tokw a ON a.id = p_id ANTI JOIN tokw b ON b.id = q_id AND b.space = a.space AND b.token = a.token GROUP BY ALL),
blocks_ AS (SELECT q_id, p_id, g.space, coalesce(k, 0) AS k, coalesce(b.w, 0) AS wk, coalesce(b.w2, 0) AS wk2, coalesce(rare, 0) AS rare, coalesce(x.n, 0) AS n, coalesce(y.n, 0) AS m, coalesce(x.w, 0) AS wa, coalesce(y.w, 0) AS wb, coalesce(x.w2, 0) AS wa2, coalesce(y.w2, 0) AS wb2, coalesce(uq.m, 0) AS uqm, coalesce(up.m, 0) AS upm
    FROM pairs CROSS JOIN (SELECT unnest([{", ".join(f"'{s}'" for s in SPACES)}]) AS space) g LEFT JOIN bothw b USING (q_id, p_id, space) LEFT JOIN sides x ON x.id = q_id AND x.space = g.space LEFT JOIN sides y ON y.id = p_id AND y.space = g.space
    LEFT JOIN onlyq uq USING (q_id, p_id, space) LEFT JOIN onlyp up USING (q_id, p_id, space)),
gram_tf AS (SELECT id, g, count(*)::DOUBLE AS tf FROM (SELECT id, unnest({Q._GRAM}) AS g FROM rec) GROUP BY ALL),
gram_norm AS (SELECT id, sqrt(sum(tf * tf)) AS norm FROM gram_tf GROUP BY 1)"""


def _gram_cosine(pairs: str, a: str, b: str) -> str:
    return f"SELECT {a}, {b}, sum(x.tf * y.tf) / any_value(nx.norm * ny.norm) AS cosine FROM (SELECT DISTINCT {a}, {b} FROM {pairs}) JOIN gram_tf x ON x.id = {a} JOIN gram_tf y ON y.id = {b} AND y.g = x.g JOIN gram_norm nx ON nx.id = {a} JOIN gram_norm ny ON ny.id = {b} GROUP BY ALL"


_COS = "CASE WHEN n > 0 AND m > 0 THEN wk2 / sqrt(greatest(wa2 * wb2, 1e-12)) END"
_NUMS = "list_sort(list_distinct(regexp_extract_all({}.n_basic, '\\d+')))"
_ACRONYM = "CASE WHEN len(list_filter({0}.nt, lambda t: NOT regexp_full_match(t, '\\d+'))) >= 2 THEN array_to_string(list_transform(list_filter({0}.nt, lambda t: NOT regexp_full_match(t, '\\d+')), lambda t: substr(t, 1, 1)), '') ELSE '' END"
_SHARED = "len(list_intersect(q.{0}, p.{0}))"
_ATTRIBUTES = {
    "n_len": "length({}.n_basic)", "n_ntok": "len({}.nt)", "a_len": "length({}.a_canon)", "a_ntok": "len({}.ct)", "f_domain": f"regexp_matches(lower({{}}.name), '{C.DOMAIN}')::INT",
    "f_nonascii": "regexp_matches({}.name, '[^\\x00-\\x7F]')::INT", "f_upper": "(upper({0}.name) = {0}.name AND lower({0}.name) <> {0}.name)::INT", "f_junk": "({0}.name <> '' AND NOT regexp_matches({0}.name, '^[\\p{{L}}\\p{{N}}]'))::INT", "a_missing": "({}.a_canon = '')::INT",
    "nf_s1": "{}.nf_s1", "nf_pool": "{}.nf_pool", "af_s1": "{}.af_s1", "af_pool": "{}.af_pool",
}
_LENGTHS = "least(length(q.{0}), length(p.{0}))::DOUBLE / greatest(length(q.{0}), length(p.{0}), 1)"
_COMMON = ", ".join(f"CASE WHEN {c} = '' THEN 0.0 ELSE ln(1 + count(*) FILTER (id % 2 = {k}) OVER (PARTITION BY {c})::DOUBLE) END AS {tag}_{side}" for tag, c in (("nf", "n_core"), ("af", "a_canon")) for side, k in (("s1", 0), ("pool", 1)))
_RECORD_FEATURES = rf"""{_FEATURED}, recs AS (SELECT *, {Q.LEGAL_SQL} AS legal, {_COMMON} FROM rec), cosines AS ({_gram_cosine("pairs", "q_id", "p_id")}),
combs AS (SELECT q_id, p_id, 0.6::DOUBLE * coalesce(max(cos) FILTER (space = 'ntok'), 0) + 0.4::DOUBLE * coalesce(max(cos) FILTER (space = 'atok'), 0) AS comb FROM (SELECT q_id, p_id, space, {_COS} AS cos FROM blocks_) GROUP BY ALL)
SELECT q_id, p_id, (q.name = p.name)::INT AS n_raw_eq, (q.n_basic = p.n_basic)::INT AS n_basic_eq, (q.n_core = p.n_core)::INT AS n_core_eq, (q.n_squash = p.n_squash)::INT AS n_squash_eq, (q.n_skel = p.n_skel)::INT AS n_skel_eq,
    CASE WHEN q.a_canon <> '' AND p.a_canon <> '' THEN (q.addr = p.addr)::INT END AS a_raw_eq, CASE WHEN q.a_canon <> '' AND p.a_canon <> '' THEN (q.a_basic = p.a_basic)::INT END AS a_basic_eq, CASE WHEN q.a_canon <> '' AND p.a_canon <> '' THEN (q.a_canon = p.a_canon)::INT END AS a_canon_eq,
    round(CASE WHEN greatest(length(q.n_core), length(p.n_core)) = 0 THEN 1.0::DOUBLE ELSE 1 - levenshtein(q.n_core, p.n_core)::DOUBLE / greatest(length(q.n_core), length(p.n_core)) END, 6) AS n_lev,
    ((length(p.n_squash) >= 2 AND {_ACRONYM.format("q")} = p.n_squash) OR (length(q.n_squash) >= 2 AND {_ACRONYM.format("p")} = q.n_squash))::INT AS n_acronym, round(coalesce(cosine, 0), 6) AS n_char_cos,
    (len(q.nums) > 0 AND len(p.nums) > 0 AND {_SHARED.format("nums")} = 0)::INT AS a_num_conflict, (least(len(q.nums), len(p.nums)) > 0 AND {_SHARED.format("nums")} = least(len(q.nums), len(p.nums)))::INT AS a_num_subset,
    CASE WHEN regexp_matches(q.a_canon, '\d') AND regexp_matches(p.a_canon, '\d') THEN (substr(regexp_extract(q.a_canon, '\d+'), 1, 9)::BIGINT = substr(regexp_extract(p.a_canon, '\d+'), 1, 9)::BIGINT)::INT END AS a_num0_eq,
    ({_SHARED.format("posts")} > 0)::INT AS a_post_eq, (len(q.posts) > 0 AND len(p.posts) > 0 AND {_SHARED.format("posts")} = 0)::INT AS a_post_conflict, (len(q.posts) = 0 OR len(p.posts) = 0)::INT AS a_post_missing, round(comb, 6) AS comb_cos,
    round({_LENGTHS.format("n_basic")}, 6) AS n_len_ratio, round(CASE WHEN q.a_canon <> '' AND p.a_canon <> '' THEN {_LENGTHS.format("a_canon")} END, 6) AS a_len_ratio, (q.a_canon = '' AND p.a_canon = '')::INT AS both_addr_missing, (p.src = 3)::INT AS src_s3,
    (q.legal <> 0 AND p.legal <> 0)::INT AS fe_legal_both, CASE WHEN q.legal <> 0 AND p.legal <> 0 THEN ((q.legal & p.legal) <> 0)::INT END AS fe_legal_agree, (q.legal <> 0 AND p.legal <> 0 AND (q.legal & p.legal) = 0)::INT AS fe_legal_conflict,
    CASE WHEN len({_NUMS.format("q")}) > 0 AND len({_NUMS.format("p")}) > 0 THEN ({_NUMS.format("q")} = {_NUMS.format("p")})::INT END AS fe_namenum_eq, (len({_NUMS.format("q")}) > 0 AND len({_NUMS.format("p")}) > 0 AND len(list_intersect({_NUMS.format("q")}, {_NUMS.format("p")})) = 0)::INT AS fe_namenum_conflict,
    ((len({_NUMS.format("q")}) > 0) <> (len({_NUMS.format("p")}) > 0))::INT AS fe_namenum_one_side, {", ".join(f"round(({x.format(side)})::DOUBLE, 6) AS {side}_{c}" for side in "qp" for c, x in _ATTRIBUTES.items())}
FROM pairs JOIN recs q ON q.id = q_id JOIN recs p ON p.id = p_id LEFT JOIN cosines USING (q_id, p_id) JOIN combs USING (q_id, p_id)"""

_FOLD = "(SELECT id, CASE WHEN a < 60 THEN CASE WHEN b < 34 THEN 'enc' ELSE 'fit' END WHEN a < 80 THEN 'tune' ELSE 'hold' END AS fold FROM (SELECT id, ('0x' || substr(md5('fold-' || id), 1, 8))::BIGINT % 100 AS a, ('0x' || substr(md5('enc-' || id), 1, 8))::BIGINT % 100 AS b FROM rec WHERE id % 2 = 0))"
_TUNE = f"""{Q.SCORED}, folds AS (FROM {_FOLD}), judged AS (SELECT id AS q_id, count(t.p_id) AS n_true FROM folds LEFT JOIN truth t ON t.q_id = id WHERE fold = 'tune' GROUP BY 1),
tuned AS (SELECT s.*, row_number() OVER (PARTITION BY p_id ORDER BY p DESC, q_id) = 1 AS best, row_number() OVER (PARTITION BY q_id ORDER BY p DESC, p_id) AS qr, row_number() OVER (PARTITION BY p_id ORDER BY p DESC, q_id) AS pr FROM scored s SEMI JOIN judged USING (q_id))"""
_F05 = "CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0::DOUBLE WHEN n_hit > 0 THEN 1.25 * (n_hit::DOUBLE / n_pred) * (n_hit::DOUBLE / n_true) / (0.25 * (n_hit::DOUBLE / n_pred) + n_hit::DOUBLE / n_true) ELSE 0.0 END"
_PERCENT = "round(100 * avg(({})::INT::DOUBLE), 4)"
_RANDOM = """places AS (SELECT id, country, row_number() OVER (PARTITION BY country ORDER BY md5('place-' || id), id) - 1 AS at, count(*) OVER (PARTITION BY country) AS n FROM rec WHERE id % 2 = 1),
drawn AS (SELECT DISTINCT q.id AS q_id, p.id AS p_id FROM (SELECT r.id, r.country, k FROM rec r, range(0, 2) g(k) WHERE r.id % 2 = 0) q JOIN places p ON p.country = q.country AND p.at = ('0x' || substr(md5('draw-' || q.id || '-' || k), 1, 8))::BIGINT % p.n)"""
_SETS = {"tokens": "{}.nt", "grams": Q._GRAM.replace("(nt,", "({}.nt,"), "skeletons": "list_filter({}.st, lambda t: t <> '')", "addr_tokens": "list_filter({}.ct, lambda t: NOT regexp_full_match(t, '\\d+'))", "bigrams": "list_transform(range(1, len({0}.ct)), lambda i: {0}.ct[i] || '_' || {0}.ct[i+1])"}
_POOL_ID = "'S' || src || '-' || id"


def _checks(parts: dict[str, str], table: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS \"check\", ({what})::BIGINT AS n FROM {table}" for name, what in parts.items())


_FIELDS = {f"{c}_{kind}": f"count(*) FILTER ({x})" for c in ("name", "addr", "country") for kind, x in (("empty", f"{c} = ''"), ("blank", f"trim({c}) = '' AND {c} <> ''"), ("placeholder", f"lower(trim({c})) IN ({Q._sql_list(profile.EMPTY_FIELDS)})"))}
_INTEGRITY = {"rows": "count(*)"} | _FIELDS | {
    "addr_null_token": f"count(*) FILTER (regexp_matches(lower(addr), '{profile.NULL_TOKEN}'))", "malformed_ids": "count(*) FILTER (NOT regexp_matches(entity_id, '^S[123]-\\d+$'))", "wrong_prefix": "count(*) FILTER (NOT starts_with(entity_id, 'S2-'))",
    "dup_ids": "count(*) - count(DISTINCT entity_id)", "dup_rows": "count(*) - count(DISTINCT (entity_id, name, addr, country))", "dup_records": "count(*) - count(DISTINCT (name, addr, country))",
    "unseen_countries": "count(DISTINCT country) FILTER (country NOT IN (SELECT coalesce(country, '') FROM rec WHERE id % 2 = 0))",
}
_REP = " UNION ALL ".join(
    f"""SELECT '{c}' AS representation, u.unique_values, u.s1_collision, j.pos_equal, j.precision, j.mean_sharing FROM
    (SELECT count(*) AS unique_values, round(100 * sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n)::DOUBLE, 4) AS s1_collision FROM (SELECT count(*) AS n FROM rec WHERE id % 2 = 0 GROUP BY country, {c})) u,
    (SELECT round(100 * avg((a.{c} = b.{c} AND b.{c} <> '')::INT::DOUBLE), 4) AS pos_equal, round(100 * sum((a.{c} = b.{c} AND b.{c} <> '')::INT) / greatest(sum(CASE WHEN b.{c} <> '' THEN coalesce(v.n, 0) ELSE 0 END), 1)::DOUBLE, 4) AS precision, round(avg(CASE WHEN b.{c} <> '' THEN coalesce(v.n, 0) ELSE 0 END), 4) AS mean_sharing
        FROM truth t JOIN rec a ON a.id = t.q_id JOIN rec b ON b.id = t.p_id LEFT JOIN (SELECT country, {c}, count(*) AS n FROM rec WHERE id % 2 = 0 GROUP BY ALL) v ON v.country = b.country AND v.{c} = b.{c}) j"""
    for c in ("name", "n_basic", "n_core", "n_squash", "n_skel")
)

SQL: dict[str, str] = {
    "er_token_features": f"""WITH {_FEATURED} SELECT q_id, p_id, space, k::INT AS shared, rare::INT AS rare_shared, n::INT AS n1, m::INT AS n2, (k = n AND k = m AND n > 0)::INT AS set_eq, round(CASE WHEN n > 0 AND m > 0 THEN k::DOUBLE / (n + m - k) END, 6) AS jacc, round(CASE WHEN n > 0 AND m > 0 THEN k::DOUBLE / least(n, m) END, 6) AS overlap,
        round(CASE WHEN n > 0 AND m > 0 THEN wk / greatest(wa + wb - wk, 1e-6) END, 6) AS wjacc, round({_COS}, 6) AS cos, round(wa - wk, 6) + 0.0::DOUBLE AS uq_idf, round(wb - wk, 6) + 0.0::DOUBLE AS up_idf, round(uqm, 6) AS uq_max, round(upm, 6) AS up_max, round(least(uqm, upm), 6) AS u_minmax, round(greatest(uqm, upm), 6) AS u_maxmax FROM blocks_""",
    "er_record_features": f"WITH {_RECORD_FEATURES}",
    "er_pool_context": f"WITH {Q.SCORED} SELECT q_id, p_id, count(*) OVER (PARTITION BY p_id) AS fe_p_ncand, count(*) OVER (PARTITION BY q_id, src, pc) - 1 AS fe_dup_name_same_src, count(*) OVER (PARTITION BY q_id, pc) - 1 AS fe_dup_name_any_src, "
    + ", ".join(f"row_number() OVER (PARTITION BY p_id ORDER BY coalesce({c}, -1) DESC, q_id) AS fe_p_{c}_rank, round(max(coalesce({c}, -1)) OVER (PARTITION BY p_id) - coalesce({c}, -1), 6) AS fe_p_{c}_gap" for c in ("p", "n_tok_jacc", "a_tok_jacc"))
    + " FROM scored",
    "er_second_stage": f"""WITH {_FEATURED}, r AS (SELECT q_id, p_id, src, p, row_number() OVER (PARTITION BY q_id, src ORDER BY p DESC, p_id) AS pl, rank() OVER (PARTITION BY q_id ORDER BY p DESC) AS p1_rank, max(p) OVER (PARTITION BY q_id) AS p1_qmax, count(*) FILTER (p >= 0.5) OVER (PARTITION BY q_id) AS p1_q_n50, count(*) FILTER (p >= 0.5) OVER (PARTITION BY q_id, src) AS p1_src_n50 FROM scored),
        z AS (SELECT r.*, x.p_id AS xsrc_id, x.p AS xsrc_p1, s.p_id AS ssrc_id, s.p AS ssrc_p1 FROM r LEFT JOIN r x ON x.q_id = r.q_id AND x.src = 5 - r.src AND x.pl = 1 LEFT JOIN r s ON s.q_id = r.q_id AND s.src = r.src AND s.pl = CASE WHEN r.pl = 1 THEN 2 ELSE 1 END),
        cx AS ({_gram_cosine("z", "p_id", "xsrc_id")}), cs AS ({_gram_cosine("z", "p_id", "ssrc_id")})
        SELECT q_id, z.p_id, p1_rank, p1_qmax, round(p1_qmax - p, 6) AS p1_gap, p1_q_n50, p1_src_n50, z.xsrc_id, xsrc_p1, z.ssrc_id, ssrc_p1, round(CASE WHEN z.xsrc_id IS NOT NULL THEN coalesce(cx.cosine, 0) END, 6) AS xsrc_char, round(CASE WHEN z.ssrc_id IS NOT NULL THEN coalesce(cs.cosine, 0) END, 6) AS ssrc_char
        FROM z LEFT JOIN cx ON cx.p_id = z.p_id AND cx.xsrc_id = z.xsrc_id LEFT JOIN cs ON cs.p_id = z.p_id AND cs.ssrc_id = z.ssrc_id""",
    "er_safe_zone": f"WITH {Q.SCORED}, s AS (SELECT m.*, {Q._JACC.format(a='q.nums', b='p_.nums')} AS nj FROM scored m JOIN rec q ON q.id = q_id JOIN rec p_ ON p_.id = p_id) SELECT coalesce(n_tok_jacc, 0) < 0.2 AND greatest(coalesce(a_tok_jacc, 0), coalesce(nj, 0)) < 0.2 AS safe, count(*) AS n, sum(y)::BIGINT AS hits FROM s GROUP BY 1",
    "er_random_pairs": f"WITH {Q.WORLD}, {_RANDOM} SELECT q_id, p_id FROM drawn",
    "er_similarity_auc": f"""WITH {Q.WORLD}, {_RANDOM}, pp AS (SELECT q_id, p_id, 1 AS y FROM truth UNION ALL SELECT q_id, p_id, 0 FROM drawn ANTI JOIN truth USING (q_id, p_id)),
        vals AS ({" UNION ALL ".join(f"SELECT '{name}' AS measure, coalesce({Q._JACC.format(a=x.format('q'), b=x.format('p'))}, 0) AS p, y FROM pp JOIN rec q ON q.id = q_id JOIN rec p ON p.id = p_id" for name, x in _SETS.items())}),
        ranks AS (SELECT measure, y, rank() OVER (PARTITION BY measure ORDER BY p) + (count(*) OVER (PARTITION BY measure, p) - 1) / 2.0::DOUBLE AS r FROM vals)
        SELECT measure, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y)))::DOUBLE, 6) AS auc FROM ranks GROUP BY measure""",
    "er_hard_negatives": f"WITH {Q.NAMES_TOP}, {Q.KEYS_SQL}, {_RANDOM}, mined AS (SELECT kind, q_id, p_id FROM matched WHERE kind IN ('A', 'B', 'K', 'S') UNION ALL SELECT 'C', q_id, p_id FROM top UNION ALL SELECT 'random', q_id, p_id FROM drawn) SELECT kind, count(*) AS n, count(t.q_id) AS n_true, (count(*) - count(t.q_id))::BIGINT AS n_hard FROM mined m LEFT JOIN truth t ON t.q_id = m.q_id AND t.p_id = m.p_id GROUP BY kind",
    "er_missed_pairs": f"WITH {Q.SPACES}, {Q.top_sql('d', Q.ADDRESSES)} SELECT t.q_id, t.p_id, a.name AS q_name, a.addr AS q_addr, b.name AS p_name, b.addr AS p_addr FROM truth t ANTI JOIN (FROM d_top WHERE rank < 1) d ON d.q_id = t.q_id AND d.p_id = t.p_id JOIN rec a ON a.id = t.q_id JOIN rec b ON b.id = t.p_id ORDER BY 1, 2 LIMIT 12",
    "er_tune_global": f"""WITH {_TUNE}, grid AS (SELECT round(0.02 + 0.01 * k, 2)::DOUBLE AS t FROM range(0, 96) g(k)), c AS (SELECT t, j.q_id, any_value(n_true) AS n_true, count(s.p) AS n_pred, coalesce(sum(y), 0) AS n_hit FROM grid CROSS JOIN judged j LEFT JOIN tuned s ON s.q_id = j.q_id AND s.p >= t AND s.p >= 0.005 GROUP BY t, j.q_id)
        SELECT t, round(avg({_F05}), 6) AS f05 FROM c GROUP BY t""",
    "er_tune_sources": f"""WITH {_TUNE}, one AS (SELECT round(0.3 + 0.05 * k, 2)::DOUBLE AS t FROM range(0, 11) g(k)), grid AS (SELECT a.t AS t_s2, b.t AS t_s3 FROM one a, one b),
        kept AS (SELECT t_s2, t_s3, q_id, p, y, max(p) OVER (PARTITION BY t_s2, t_s3, q_id) AS hi FROM tuned CROSS JOIN grid WHERE best AND p >= CASE WHEN src = 2 THEN t_s2 ELSE t_s3 END),
        c AS (SELECT g.t_s2, g.t_s3, j.q_id, any_value(n_true) AS n_true, count(k.p) AS n_pred, coalesce(sum(k.y), 0) AS n_hit FROM grid g CROSS JOIN judged j LEFT JOIN kept k ON k.q_id = j.q_id AND k.t_s2 = g.t_s2 AND k.t_s3 = g.t_s3 AND hi >= 0.6 AND k.p >= 0.8::DOUBLE * hi GROUP BY ALL)
        SELECT t_s2, t_s3, round(avg({_F05}), 6) AS f05 FROM c GROUP BY ALL""",
    "er_cut_frontier": f"""WITH {_TUNE}, grid AS (SELECT m_pool, n_max, t FROM (SELECT unnest({CUTS[0]}) AS m_pool), (SELECT unnest({CUTS[1]}) AS n_max), (SELECT unnest({CUTS[2]})::DOUBLE AS t)),
        c AS (SELECT m_pool, n_max, t, j.q_id, any_value(n_true) AS n_true, count(s.p) AS n_pred, coalesce(sum(y), 0) AS n_hit FROM grid CROSS JOIN judged j LEFT JOIN tuned s ON s.q_id = j.q_id AND s.p >= t AND (n_max = 0 OR qr <= n_max) AND (m_pool = 0 OR pr <= m_pool) GROUP BY ALL)
        SELECT m_pool::BIGINT AS m_pool, n_max::BIGINT AS n_max, t, round(avg(n_pred), 6) AS cand, quantile_cont(n_pred, 0.5)::DOUBLE AS p50, round(quantile_cont(n_pred, 0.95)::DOUBLE, 6) AS p95, max(n_pred) AS most, round(sum(n_hit) / greatest(sum(n_true), 1)::DOUBLE, 6) AS pair_recall,
        round(avg(CASE WHEN n_true = 0 THEN 1.0::DOUBLE WHEN n_hit > 0 THEN 1.25 * (n_hit::DOUBLE / n_true) / (0.25 + n_hit::DOUBLE / n_true) ELSE 0.0 END), 6) AS oracle FROM c GROUP BY ALL""",
    "er_oracle": f"""WITH {Q.SCORED}, folds AS (FROM {_FOLD}), counted AS (SELECT f.fold, f.id AS q_id, coalesce(t.n, 0) AS n_true, coalesce(h.n, 0) AS n_pred, coalesce(h.n, 0) AS n_hit FROM folds f LEFT JOIN (SELECT q_id, count(*) AS n FROM truth GROUP BY 1) t ON t.q_id = f.id LEFT JOIN (SELECT q_id, count(*) AS n FROM scored WHERE y = 1 GROUP BY 1) h ON h.q_id = f.id),
        shares AS (SELECT *, 1.0::DOUBLE AS prec, CASE WHEN n_true = 0 THEN 1.0::DOUBLE ELSE n_hit::DOUBLE / n_true END AS rec_ FROM counted), judged AS (SELECT *, {_F05} AS f05 FROM shares) SELECT fold, {Q._METRICS} FROM judged GROUP BY fold""",
    "er_calibration": f"""WITH {Q.SCORED}, e AS (SELECT least(greatest(p, 1e-6), 1 - 1e-6) AS c, y, p, least(floor(p * 10 + 1e-9), 9)::BIGINT AS bin FROM scored) SELECT bin, count(*) AS n, round(avg(c), 6) AS mean_p, round(avg(y), 6) AS rate, (SELECT round(avg(-(y * ln(c) + (1 - y) * ln(1 - c))), 6) FROM e) AS log_loss, (SELECT round(avg((p - y) * (p - y)), 6) FROM e) AS brier FROM e GROUP BY bin""",
    "er_score_quantiles": f"WITH {Q.SCORED} SELECT q::DOUBLE AS q, round(CASE q WHEN 0.1 THEN a WHEN 0.25 THEN b WHEN 0.5 THEN c WHEN 0.75 THEN d ELSE e END, 6)::DOUBLE AS value FROM (SELECT quantile_cont(p, 0.1) AS a, quantile_cont(p, 0.25) AS b, quantile_cont(p, 0.5) AS c, quantile_cont(p, 0.75) AS d, quantile_cont(p, 0.9) AS e FROM scored), (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS q)",
    "er_correlations": "WITH " + Q.SCORED + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}::DOUBLE, {b}::DOUBLE), 6) AS corr FROM scored" for k, a in enumerate(("p", "n_lev", "n_tok_jacc", "n_tok_over", "y")) for b in ("p", "n_lev", "n_tok_jacc", "n_tok_over", "y")[k:]),
    "er_singletons": f"""WITH {Q.WORLD}, t AS (SELECT id, country, unnest(list_distinct(nt)) AS token FROM rec), df AS (SELECT country, token, count(*) AS df FROM t WHERE id % 2 = 1 GROUP BY ALL), rare AS (SELECT id, min(coalesce(df, 0)) AS rarest FROM t LEFT JOIN df USING (country, token) WHERE id % 2 = 0 GROUP BY 1)
        SELECT r.id NOT IN (SELECT q_id FROM truth) AS singleton, count(*) AS n, round(avg(length(n_basic)), 4) AS name_len, round(avg(len(nt)), 4) AS name_tokens, round(avg(({Q.LEGAL_SQL} <> 0)::INT::DOUBLE), 6) AS legal_share, round(avg((a_canon = '')::INT::DOUBLE), 6) AS no_address, round(avg(rarest), 4) AS rarest_token FROM rec r LEFT JOIN rare USING (id) WHERE r.id % 2 = 0 GROUP BY 1""",
    "er_strength": f"WITH {Q.SCORED}, b AS (SELECT q_id, max(p) AS best FROM scored GROUP BY 1) SELECT r.id NOT IN (SELECT q_id FROM truth) AS singleton, coalesce(least(floor(best * 10 + 1e-9), 9), -1)::BIGINT AS bin, count(*) AS n FROM rec r LEFT JOIN b ON b.q_id = r.id WHERE r.id % 2 = 0 GROUP BY ALL",
    "er_country_diagnostics": f"""WITH {Q.DECIDED}, e AS (SELECT r.country, coalesce(c.n, 0) AS c, coalesce(m.n, 0) AS m FROM rec r LEFT JOIN (SELECT q_id, count(*) AS n FROM scored GROUP BY 1) c ON c.q_id = r.id LEFT JOIN (SELECT q_id, count(*) AS n FROM chosen GROUP BY 1) m ON m.q_id = r.id WHERE r.id % 2 = 0)
        SELECT country, count(*) AS n, round(avg(c), 6) AS candidates, round(avg(m), 6) AS chosen, round(avg((m > 0)::INT::DOUBLE), 6) AS with_match, round(avg((c = 0)::INT::DOUBLE), 6) AS without_candidate FROM e GROUP BY country""",
    "er_source_profile": rf"""WITH {Q.WORLD} SELECT src::INT AS src, count(*) AS records, round(100 * count(DISTINCT name) / count(*)::DOUBLE, 4) AS uniq_names, round(100 * count(DISTINCT addr) / count(*)::DOUBLE, 4) AS uniq_addr, count(DISTINCT coalesce(country, '')) AS n_countries, {_PERCENT.format("trim(addr) = ''")} AS empty_addr,
        round(100 * (count(*) - count(DISTINCT (name, addr, coalesce(country, '')))) / count(*)::DOUBLE, 4) AS dup_records, quantile_cont(length(name), 0.5)::DOUBLE AS name_len_med, quantile_cont(length(name), 0.95)::DOUBLE AS name_len_p95, round(avg(len(list_filter(string_split_regex(name, '\s+'), lambda t: t <> ''))), 4) AS name_words,
        {_PERCENT.format("regexp_matches(name, '[0-9]')")} AS name_digit, {_PERCENT.format(r"regexp_matches(name, '[^\p{L}\p{N}_\s]')")} AS name_punct, {_PERCENT.format(r"regexp_matches(name, '[^\x00-\x7F]')")} AS name_nonascii, {_PERCENT.format("regexp_matches(name, '[À-ɏ]')")} AS name_accented, {_PERCENT.format("upper(name) = name AND lower(name) <> name")} AS name_upper,
        {_PERCENT.format(r"name <> '' AND NOT regexp_matches(name, '^[\p{L}\p{N}]')")} AS name_junk, {_PERCENT.format(f"regexp_matches(lower(name), '{C.DOMAIN}')")} AS name_domain, quantile_cont(length(addr), 0.5)::DOUBLE AS addr_len_med, round(avg(len(list_filter(string_split_regex(addr, '\s+'), lambda t: t <> ''))), 4) AS addr_words, round(avg(length(regexp_replace(addr, '[^0-9]', '', 'g'))), 4) AS addr_digits,
        {_PERCENT.format(f"regexp_matches(lower(addr), '{profile.NULL_TOKEN}')")} AS addr_null_token, {_PERCENT.format(r"regexp_matches(addr, '[^\x00-\x7F]')")} AS addr_nonascii FROM rec GROUP BY src""",
    "er_representations": f"WITH {Q.WORLD}, e AS ({_REP}) SELECT *, CASE WHEN pos_equal >= 15 AND precision >= 50 THEN 'blocking key + feature' WHEN pos_equal >= 15 THEN 'feature only (ambiguous)' ELSE 'feature only (low coverage)' END AS role FROM e",
    "er_anchors": f"""WITH {Q.SCORED}, kr AS (SELECT *, {Q.ADDR_KEYS} AS ks FROM rec), e AS (SELECT q.nums AS a, p.nums AS b, q.posts AS c, p.posts AS d, q.ks AS k1, p.ks AS k2, q.ct AS x, p.ct AS y, q.a_canon AS ca, p.a_canon AS cb FROM pairs JOIN kr q ON q.id = q_id JOIN kr p ON p.id = p_id),
        s AS (SELECT count(*) AS n, count(*) FILTER (len(a) > 0 AND len(b) > 0) AS nn, count(*) FILTER (len(list_intersect(a, b)) > 0) AS ns, count(*) FILTER (len(c) > 0 AND len(d) > 0) AS pn, count(*) FILTER (len(list_intersect(c, d)) > 0) AS ps, count(*) FILTER (len(list_intersect(k1, k2)) > 0) AS ks, count(*) FILTER (list_sort(list_distinct(x)) = list_sort(list_distinct(y)) AND ca <> cb AND ca <> '') AS ro FROM e)
        SELECT n, round(100 * nn / greatest(n, 1)::DOUBLE, 4) AS both_numbers, round(100 * ns / greatest(nn, 1)::DOUBLE, 4) AS numbers_overlap, round(100 * (nn - ns) / greatest(nn, 1)::DOUBLE, 4) AS numbers_conflict, round(100 * pn / greatest(n, 1)::DOUBLE, 4) AS both_postal, round(100 * ps / greatest(pn, 1)::DOUBLE, 4) AS postal_equal, round(100 * ks / greatest(n, 1)::DOUBLE, 4) AS key_shared, round(100 * ro / greatest(n, 1)::DOUBLE, 4) AS reordered FROM s""",
    "er_integrity": f"WITH {Q.WORLD}, e AS (SELECT {_POOL_ID} AS entity_id, name, addr, coalesce(country, '') AS country FROM rec WHERE id % 2 = 1) {_checks(_INTEGRITY, 'e')}",
    "er_truth_integrity": f"""WITH {Q.WORLD}, t AS (SELECT q_id, {_POOL_ID} AS id, src FROM truth JOIN rec ON id = p_id), nq AS (SELECT count(*) AS n, (SELECT count(DISTINCT q_id) FROM truth) AS m FROM rec WHERE id % 2 = 0)
        SELECT 'rows' AS "check", n AS n FROM nq UNION ALL SELECT 'empty_rows', n - m FROM nq UNION ALL SELECT 'invalid_refs', count(*) FROM t WHERE src = 3 UNION ALL SELECT 'matched_ids', count(*) FROM t UNION ALL SELECT 'ids_of_several_s1', count(*) - count(DISTINCT id) FROM t
        UNION ALL SELECT unnest(['empty_tokens', 'ids_with_blanks', 'bad_format', 's1_unknown', 's1_missing', 'dup_s1_rows', 'dup_within_row']), 0""",
    "er_submission_check": f"WITH {Q.DECIDED} SELECT 'extra_s1' AS error, 'S1-' || id AS offender FROM rec WHERE id % 2 = 0 AND country IS DISTINCT FROM 'en' UNION ALL SELECT DISTINCT 'unknown_id', 'S3-' || p_id FROM chosen WHERE src = 3",
}
