"""Linkage queries over the documents and embeddings worlds, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave import constants as C
from kinweave.functions import text as T
from kinweave.operators import features
from kinweave.operators import linkage as L
from kinweave.sources import stage, tables

TOP_K = 10
#: Tokens in more records than the larger of these (a number, a share of the pool) aren't joined on; blocks of keys likewise.
IDF_CAP, IDF_SHARE, MAX_BLOCK = 2000, 0.0008, 300
KEYS = ("A", "B", "K")
RULE = L.Rule(t_s2=0.55, t_s3=0.6, exclusive=True, top_n=3, t_anchor=0.65, rel=0.8)


def staged(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries read: written once for the state of the documents and of the library."""
    return stage.saved(spark, name, [f"{sf_dir}/documents.parquet"], build, [sf_dir])


def world(spark: SparkSession, sf_dir: str) -> tables.World:
    w = tables.documents_world(spark, sf_dir)
    own, pool = staged(spark, sf_dir, "queries", lambda: L.prepared(w.queries)), staged(spark, sf_dir, "pool", lambda: L.prepared(w.pool))
    return tables.World(own, pool, staged(spark, sf_dir, "truth", lambda: w.truth.distinct()))


def key_pairs(w: tables.World, kinds: tuple[str, ...]) -> DataFrame:
    """kind, q_id, p_id of keys whose blocks aren't too large."""
    wanted = F.col("kind").isin(*kinds)
    return L.key_join(L.block_keys(w.queries).filter(wanted), L.block_keys(w.pool).filter(wanted), max_block=MAX_BLOCK)


def scored(spark: SparkSession, sf_dir: str) -> tuple[tables.World, DataFrame]:
    """Candidates by the name keys and the best names by TF-IDF; p from the token sets; y from truth."""
    w = world(spark, sf_dir)

    def build() -> DataFrame:
        pairs = key_pairs(w, KEYS).select("q_id", "p_id").unionByName(er_tfidf_names(spark, sf_dir).select("q_id", "p_id")).distinct()
        rows = L.pair_measures(L.with_records(pairs, w.queries, w.pool, L.MEASURED)).join(w.pool.select(F.col("id").alias("p_id"), "src"), "p_id")
        p = F.round(0.6 * F.coalesce("n_tok_jacc", F.lit(0.0)) + 0.4 * F.coalesce("a_tok_jacc", F.lit(0.0)), 6)
        rows = rows.withColumn("p", p).join(w.truth.withColumn("y", F.lit(1)), ["q_id", "p_id"], "left").fillna(0, ["y"])
        return rows.drop(*[f"{side}_{c}" for side in "qp" for c in ("ntok", "atok", "anum")])

    return w, staged(spark, sf_dir, "scored", build)


def er_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = world(spark, sf_dir)
    rows = w.queries.unionByName(w.pool.drop("src"))
    core = F.col("n_core")
    return rows.select("id", "country", "n_basic", "n_core", "n_squash", "n_skel", T.acronym(core).alias("acronym"), "n_len", "n_ntok", "f_nonascii", "f_upper", "n_alt", "f_domain", "f_junk", F.col("legal").cast("long").alias("legal"))


def er_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = world(spark, sf_dir)
    rows = w.queries.unionByName(w.pool.drop("src"))
    return rows.select("id", "a_basic", "a_canon", "a_len", "a_ntok", "a_missing", "num0", T.joined(T.token_set(F.col("a_canon"))).alias("a_set"), T.joined(F.array_sort("anum")).alias("numbers"), T.joined(F.array_sort("apost")).alias("postal"), T.joined(T.addr_keys(F.col("a_canon"))).alias("keys"))


def er_token_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = world(spark, sf_dir)
    n = w.pool.count()
    stats = L.token_statistics(L.token_spaces(w.pool, ("ntok", "atok", "abig", "anum")), n, IDF_CAP, IDF_SHARE)
    return stats.select("space", "token", "df", F.round("idf", 6).alias("idf"), "rare", F.round("w", 6).alias("w"))


def er_commonness(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = world(spark, sf_dir)
    rows = w.queries.select("id", "n_core", "a_canon").unionByName(w.pool.select("id", "n_core", "a_canon"))
    return features.commonness(rows, w.queries, w.pool).select("id", *[F.round(c, 6).alias(c) for c in ("nf_s1", "nf_pool", "af_s1", "af_pool")])


def er_key_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_pairs(world(spark, sf_dir), ("A", "B", "E", "H", "K", "S"))


def _top(spark: SparkSession, sf_dir: str, pool_weights: Callable, query_weights: Callable, spaces: tuple[str, ...]) -> DataFrame:
    w = world(spark, sf_dir)
    n = w.pool.count()
    pool, queries = L.token_spaces(w.pool, spaces), L.token_spaces(w.queries, spaces)
    stats = L.token_statistics(pool, n, IDF_CAP, IDF_SHARE)
    vectors = lambda parts: reduce(DataFrame.unionByName, [L.sparse_vectors(t) for t in (parts if isinstance(parts, list) else [parts])])
    return L.sparse_top(vectors(query_weights(queries, stats, n)), vectors(pool_weights(pool, stats, n)), TOP_K, (w.queries, w.pool))


#: Token spaces, with their weights, of the passes by names, by addresses and by character grams.
NAMES, ADDRESSES, GRAMS = {"ntok": 1.0, "nskel": 0.5}, {"atok": 1.0, "anum": 1.0, "abig": 1.0}, {"nchar": 1.0}


def _cosine_top(spark: SparkSession, sf_dir: str, spaces: dict[str, float]) -> DataFrame:
    weigh = lambda t, s, n: L.weighted_tokens(t, s, spaces, n)
    return _top(spark, sf_dir, weigh, weigh, tuple(spaces))


def er_tfidf_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "names", lambda: _cosine_top(spark, sf_dir, NAMES))


def er_tfidf_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "addresses", lambda: _cosine_top(spark, sf_dir, ADDRESSES))


def er_tfidf_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cosine_top(spark, sf_dir, GRAMS)


def er_tfidf_combined(spark: SparkSession, sf_dir: str, alpha: float = 0.6) -> DataFrame:
    """Names and addresses in one score, before the best are taken: a query's weights carry the shares."""

    def both(t: DataFrame, s: DataFrame, n: int, name: float, addr: float) -> list[DataFrame]:
        part = lambda spaces, share: L.weighted_tokens(t, s, spaces, n).withColumn("w", F.col("w") * share)
        return [part(NAMES, name), part(ADDRESSES, addr)]  # each gives records a row: its tokens aren't dealt again

    return _top(spark, sf_dir, lambda t, s, n: both(t, s, n, 1.0, 1.0), lambda t, s, n: both(t, s, n, alpha, 1 - alpha), (*NAMES, *ADDRESSES))


def er_bm25_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaces = ("atok", "abig")
    return _top(spark, sf_dir, lambda t, s, n: L.bm25_weights(t, s, spaces), lambda t, s, n: t.withColumn("w", F.lit(1.0)), spaces)


def er_dense_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = L.dense_top(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), 5)
    return found.select("q_id", "p_id", "rank", F.round("score", 5).alias("score"))


def er_dense_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors' labels stand for countries; one country isn't in the pool, whose queries search all of it."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("country"))
    found = L.dense_top(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1 AND country <> 0"), 5, by="country")
    return found.select("q_id", "p_id", "rank", F.round("score", 5).alias("score"))


def er_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = world(spark, sf_dir)
    keys = key_pairs(w, ("A", "B"))
    passes = {k: keys.filter(F.col("kind") == k).select("q_id", "p_id") for k in ("A", "B")} | {"C": er_tfidf_names(spark, sf_dir)}
    return L.candidate_union(passes).select("q_id", "p_id", F.col("bits").cast("long").alias("bits"), "s_C", "r_C")


def er_recall_by_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True pairs that the passes by names and by addresses hold among their best 1, 2, 5 and 10."""
    w = world(spark, sf_dir)
    ranks = er_tfidf_names(spark, sf_dir).select(F.lit("C").alias("pass"), "q_id", "p_id", "rank").unionByName(er_tfidf_addresses(spark, sf_dir).select(F.lit("D"), "q_id", "p_id", "rank").toDF("pass", "q_id", "p_id", "rank"))
    hits = ranks.join(w.truth, ["q_id", "p_id"], "left_semi").groupBy("pass").agg(*[F.count(F.when(F.col("rank") < k, 1)).alias(f"k{k}") for k in (1, 2, 5, 10)])
    return hits


def er_pass_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passes and depths that a budget of 20 candidates a query buys."""
    w = world(spark, sf_dir)
    names = er_tfidf_names(spark, sf_dir)
    options = [(k, None, None) for k in KEYS] + [("C", k, names.filter(F.col("rank") < k)) for k in (1, 2, 5, TOP_K)]
    plan = L.pass_plan(options, w.truth, w.queries.count(), most=20, keys=(L.single_keys(w.queries, KEYS), L.single_keys(w.pool, KEYS)))
    return spark.createDataFrame([tuple(step.values()) for step in plan], "step long, pass string, depth long, gain double, recall double, pairs long")


def er_pair_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = scored(spark, sf_dir)
    six = lambda c: F.round(c, 6).alias(c)
    return rows.select("q_id", "p_id", "src", "eq_n_basic", "eq_n_core", "eq_n_squash", "eq_n_skel", F.col("eq_a_canon").cast("double").alias("eq_a_canon"), six("n_lev"), "n_tok_shared", six("n_tok_jacc"), six("n_tok_over"), six("a_tok_jacc"), "both_addr_missing", "p", "y")


def er_string_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = scored(spark, sf_dir)
    rows = L.string_measures(rows.select("q_id", "p_id", "q_n_core", "p_n_core"))
    return rows.select("q_id", "p_id", F.round("n_jw", 5).alias("n_jw"), *[F.round(c, 6).alias(c) for c in ("n_ratio", "n_tsort", "n_tset", "n_partial")])


def er_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = scored(spark, sf_dir)
    rows = L.context(L.context(rows.select("q_id", "p_id", "p"), "p").withColumnRenamed("p_rank", "q_rank").withColumnRenamed("p_gap", "q_gap").withColumnRenamed("p_z", "q_z"), "p", "p_id")
    return rows.select("q_id", "p_id", F.round("q_gap", 6).alias("q_gap"), F.col("q_rank").cast("long").alias("q_rank"), F.round("q_z", 4).alias("q_z"), F.round("p_gap", 6).alias("p_gap"), F.col("p_rank").cast("long").alias("p_rank"))


def er_stage_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.stage_one_cut(scored(spark, sf_dir)[1], 0.15, 4, 4).select("q_id", "p_id", "p")


def er_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.decide(scored(spark, sf_dir)[1], RULE).select("q_id", "p_id", "src", "p")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, rows = scored(spark, sf_dir)
    return L.per_query(w.queries, L.decide(rows, RULE), w.truth.distinct())


def er_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.metrics(_judged(spark, sf_dir))


def er_metrics_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.metrics(_judged(spark, sf_dir), ("country",))


def er_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    cap = lambda c: F.least(F.col(c), F.lit(8)).cast("long")
    return _judged(spark, sf_dir).groupBy(cap("n_true").alias("n_true"), cap("n_pred").alias("n_pred")).agg(F.count("*").alias("n"))


def er_threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro counts at 20 thresholds from one histogram of the scores."""
    w, rows = scored(spark, sf_dir)
    bins = rows.groupBy(F.floor(F.col("p") * 20 + 1e-9).alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("hit"))
    grid = spark.range(0, 21).withColumnRenamed("id", "bin").join(bins, "bin", "left").fillna(0)
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    return grid.select((F.col("bin") / 20).alias("t"), F.sum("n").over(above).alias("n_pred"), F.sum("hit").over(above).alias("n_hit"))


def er_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.auc(scored(spark, sf_dir)[1])


def er_candidate_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, rows = scored(spark, sf_dir)
    return L.candidate_statistics(w.queries, w.pool, rows.select("q_id", "p_id"), w.truth.distinct())


def er_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, rows = scored(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("p"), "p_id"))
    hits = rows.withColumn("k", place).filter("y = 1 AND k <= 20").groupBy("k").agg(F.count("*").alias("n"))
    grid = spark.range(1, 21).withColumnRenamed("id", "k").join(hits, "k", "left").fillna(0)
    return grid.select("k", F.sum("n").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)).alias("hits"))


def er_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and reachable true pairs for each number of best candidates a query, those that pay."""
    _, rows = scored(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("p"), "p_id"))
    each = rows.withColumn("m", F.least(place, F.lit(30))).groupBy("m").agg(F.count("*").alias("n"), F.sum("y").alias("hit"))
    w = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    return L.frontier(each.select("m", F.sum("n").over(w).alias("cand"), F.sum("hit").over(w).alias("oracle"))).select(F.col("m").cast("long").alias("m"), "cand", "oracle")


def er_id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, rows = scored(spark, sf_dir)
    return tables.id_lists(w.queries, L.decide(rows, RULE))


def er_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, rows = scored(spark, sf_dir)
    return L.validation(tables.id_lists(w.queries.filter("id % 10 <> 4"), rows.filter("p > 0.4")), w.queries, w.pool.filter("id % 10 <> 3"))


def er_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.folds(tables.documents_world(spark, sf_dir).queries.select("id")).select("id", "fold", F.col("half").cast("long").alias("half"))


def er_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and hits of joins on equal raw, basic and core names within a country."""
    w = world(spark, sf_dir)
    truth, out = w.truth.distinct(), None
    for name in ("name", "n_basic", "n_core"):
        pairs = w.queries.filter(F.col(name) != "").select(F.col("id").alias("q_id"), "country", name).join(w.pool.select(F.col("id").alias("p_id"), "country", name), ["country", name]).select("q_id", "p_id")
        row = pairs.join(truth.withColumn("y", F.lit(1)), ["q_id", "p_id"], "left").agg(F.lit(name).alias("rule"), F.count("*").alias("pairs"), F.coalesce(F.sum("y"), F.lit(0)).alias("hits"))
        out = row if out is None else out.unionByName(row)
    return out


def er_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = world(spark, sf_dir)
    rows = w.queries.withColumn("src", F.lit(1)).unionByName(w.pool)
    return rows.groupBy("src", "country").agg(
        F.count("*").alias("n"), F.countDistinct("name").alias("names"), F.countDistinct("n_core").alias("cores"), F.sum(F.col("a_missing").cast("int")).alias("no_address"),
        F.round(F.avg("n_len"), 4).alias("mean_len"), F.percentile("n_len", 0.5).alias("median_len"), F.sum(F.col("f_upper").cast("int")).alias("upper"),
    )


def er_error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False and missed pairs by the first rule that fits."""
    w, rows = scored(spark, sf_dir)
    chosen = L.decide(rows, RULE).select("q_id", "p_id", F.lit(1).alias("chosen"))
    both = rows.join(chosen, ["q_id", "p_id"], "left").filter((F.coalesce("chosen", F.lit(0)) == 1) != (F.col("y") == 1))
    kind = F.when((F.col("y") == 0) & (F.col("eq_n_core") == 1), "false: equal name").when((F.col("y") == 0) & (F.col("a_tok_jacc") >= 0.5), "false: near address").when(F.col("y") == 0, "false: other").when(F.col("p") < 0.6, "missed: low score").otherwise("missed: taken by another")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def er_name_address_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = scored(spark, sf_dir)
    cell = lambda c: F.least(F.floor(F.coalesce(F.col(c), F.lit(0.0)) * 5 + 1e-9), F.lit(4))
    return rows.groupBy(cell("n_tok_jacc").alias("name_bin"), cell("a_tok_jacc").alias("addr_bin")).agg(F.count("*").alias("n"), F.sum("y").alias("hits"))


def er_expected_f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.expected_selection(L.stage_one_cut(scored(spark, sf_dir)[1], 0.1, 20), extra=0.02)


def er_matcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinweave.plans import matcher

    w, rows = scored(spark, sf_dir)
    return matcher.fit_and_score(w, rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for name, f in list(globals().items()) if name.startswith("er_")}


# ---- SQL

_WORDS = r"list_filter(string_split_regex(text, '[ \t\n\v\f\r]+'), lambda t: t <> '')"
_LATIN = "replace(replace(replace(strip_accents(lower({})), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae')"


def _tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def _merged(x: str) -> str:
    t = f"string_split({x}, ' ')"
    single = "regexp_full_match({}, '[a-z]')"
    return f"array_to_string(list_transform(range(1, len({t}) + 1), lambda i: CASE WHEN i = 1 THEN {t}[1] WHEN {single.format(f'{t}[i]')} AND {single.format(f'{t}[i-1]')} THEN {t}[i] ELSE ' ' || {t}[i] END), '')"


def _sql_list(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_LEET = f"CASE WHEN length(t) >= 2 AND regexp_matches(t, '[a-z]') AND length(regexp_replace(t, '\\D', '', 'g')) = 1 THEN translate(t, '{C.LEET_FROM}', '{C.LEET_TO}') ELSE t END"
_SWAPPED = "t"
for _a, _b in C.SKELETON_SWAPS:
    _SWAPPED = f"replace({_SWAPPED}, '{_a}', '{_b}')"
_BARE = f"(substr({_SWAPPED}, 1, 1) || regexp_replace(substr({_SWAPPED}, 2), '[aeiouy]', '', 'g'))"
_SKELETON = f"CASE WHEN regexp_full_match(t, '\\d+') THEN t ELSE array_to_string(list_transform(list_filter(range(1, length({_BARE}) + 1), lambda i: i = 1 OR substr({_BARE}, i, 1) <> substr({_BARE}, i - 1, 1)), lambda i: substr({_BARE}, i, 1)), '') END"
_ADDRESS = f"map([{_sql_list(tuple(C.ADDRESS_FORMS))}], [{_sql_list(tuple(C.ADDRESS_FORMS.values()))}])"

WORLD = rf"""
raw AS (SELECT doc_id AS id, lower(trim(lang)) AS country, text, {_WORDS} AS w FROM documents),
rec0 AS (SELECT id, country, text, array_to_string(w[1:6], ' ') AS name, array_to_string(w[7:18], ' ') AS addr FROM raw),
rec1 AS (SELECT *, trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace({_LATIN.format("name")}, '\bwww\.', ' ', 'g'), '{C.TOP_LEVEL}', ' ', 'g'), '&', ' and '), '[''’`´]', '', 'g'), '[^0-9a-z]+', ' ', 'g')) AS n1,
    trim(regexp_replace(regexp_replace(regexp_replace(replace({_LATIN.format("addr")}, '&', ' and '), '[''’`´]', '', 'g'), '[^0-9a-z]+', ' ', 'g'), '\b(\d+)(?:st|nd|rd|th)\b', '\1', 'g')) AS a1 FROM rec0),
rec2 AS (SELECT *, {_merged("n1")} AS n_basic, {_merged("a1")} AS a2 FROM rec1),
rec3 AS (SELECT *, list_transform({_tokens("n_basic")}, lambda t: {_LEET}) AS leet, list_filter({_tokens("a2")}, lambda t: t NOT IN ({_sql_list(C.PLACEHOLDERS)})) AS words FROM rec2),
rec4 AS (SELECT *, list_filter(leet, lambda t: t NOT IN ({_sql_list(C.LEGAL_FORMS)})) AS core, list_transform(words, lambda t: coalesce({_ADDRESS}[t], t)) AS ct FROM rec3),
rec5 AS (SELECT id, country, text, name, addr, n_basic, array_to_string(words, ' ') AS a_basic, array_to_string(ct, ' ') AS a_canon, ct, CASE WHEN len(core) > 0 THEN core ELSE leet END AS nt FROM rec4),
rec AS (SELECT *, array_to_string(nt, ' ') AS n_core, array_to_string(nt, '') AS n_squash, list_transform(nt, lambda t: {_SKELETON}) AS st, list_transform(ct, lambda t: {_SKELETON}) AS cst,
    list_distinct(list_transform(regexp_extract_all(a_canon, '\d+'), lambda t: regexp_replace(t, '^0+(\d)', '\1'))) AS nums,
    list_distinct(list_transform(list_filter(range(1, len(ct) + 1), lambda i: regexp_full_match(ct[i], '\d{{6}}') OR (regexp_full_match(ct[i], '\d{{5}}') AND NOT regexp_full_match(coalesce(ct[i + 1], ''), '[a-z]{{3,}}'))), lambda i: ct[i])) AS posts, array_to_string(list_transform(nt, lambda t: {_SKELETON}), ' ') AS n_skel,
    CASE WHEN id % 2 = 0 THEN 1 ELSE 2 + (id // 2) % 2 END AS src FROM rec5),
truth AS (SELECT DISTINCT a.id AS q_id, b.id AS p_id FROM rec0 a JOIN rec0 b ON a.text = b.text WHERE a.id % 2 = 0 AND b.id % 2 = 1)"""

_WORDS_ONLY = "list_filter({}, lambda t: NOT regexp_full_match(t, '\\d+'))"
SPACES = rf"""{WORLD},
spaces AS (SELECT id, country, 'ntok' AS space, unnest(list_distinct(nt)) AS token FROM rec UNION ALL SELECT id, country, 'nskel', unnest(list_distinct(list_filter(st, lambda t: t <> ''))) FROM rec
    UNION ALL SELECT id, country, 'atok', unnest(list_distinct({_WORDS_ONLY.format("ct")})) FROM rec
    UNION ALL SELECT id, country, 'anum', unnest(nums) FROM rec
    UNION ALL SELECT id, country, 'abig', unnest(list_distinct(list_transform(range(1, len(ct)), lambda i: ct[i] || '_' || ct[i+1]))) FROM rec),
size AS (SELECT count(*) AS n FROM rec WHERE id % 2 = 1),
stats AS (SELECT space, token, df, ln((n + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1.0 AS idf, CASE WHEN df <= greatest({IDF_CAP}, {IDF_SHARE} * n) THEN ln((n + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1.0 ELSE 0.0 END AS wt FROM (SELECT space, token, count(*) AS df FROM spaces WHERE id % 2 = 1 GROUP BY ALL), size)"""
def top_sql(tag: str, spaces: dict[str, float], table: str = "spaces", stats: str = "stats") -> str:
    """Normalised weights, scores and best pairs of a pass over some token spaces: {tag}_normed, {tag}_top."""
    share = " ".join(f"WHEN '{s}' THEN {w}::DOUBLE" for s, w in spaces.items())
    return f"""{tag}_tw AS (SELECT id, country, s.space, s.token, coalesce(wt, ln(n + 1.0::DOUBLE) + 1.0) * CASE s.space {share} END AS w FROM {table} s LEFT JOIN {stats} USING (space, token), size WHERE s.space IN ({_sql_list(tuple(spaces))})),
{tag}_normed AS (SELECT id, country, space, token, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {tag}_tw WHERE w > 0),
{tag}_sums AS (SELECT a.id AS q_id, b.id AS p_id, round(sum(a.w * b.w), 6) AS score FROM {tag}_normed a JOIN {tag}_normed b USING (country, space, token) WHERE a.id % 2 = 0 AND b.id % 2 = 1 GROUP BY ALL),
{tag}_top AS (SELECT q_id, p_id, score, (row_number() OVER (PARTITION BY q_id ORDER BY score DESC, p_id) - 1)::INT AS rank FROM {tag}_sums QUALIFY rank < {TOP_K})"""


NAMES_TOP = f"{SPACES}, {top_sql('c', NAMES)}, top AS (FROM c_top)"
_GRAM = "flatten(list_transform(nt, lambda t: list_transform(range(1, length(t) + 1), lambda i: substr(' ' || t || ' ', i, 3))))"
GRAMS_SQL = f"""gram_spaces AS (SELECT id, country, 'nchar' AS space, unnest(list_distinct({_GRAM})) AS token FROM rec),
gram_stats AS (SELECT space, token, CASE WHEN df <= greatest({IDF_CAP}, 0.003 * n) THEN ln((n + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1.0 ELSE 0.0 END AS wt FROM (SELECT space, token, count(*) AS df FROM gram_spaces WHERE id % 2 = 1 GROUP BY ALL), size)"""
_PLACES = r"list_filter(range(1, len(ct)), lambda i: regexp_full_match(ct[i], '\d+') AND NOT regexp_full_match(ct[i + 1], '\d+') AND length(ct[i + 1]) >= 3)[1:3]"
ADDR_KEYS = rf"list_transform({_PLACES}, lambda i: regexp_replace(ct[i], '^0+(\d)', '\1') || '|' || substr(cst[i + 1], 1, 4))"
LEGAL_SQL = "(" + " + ".join(f"CASE WHEN regexp_matches(n_basic, '{p}') THEN {1 << k} ELSE 0 END" for k, p in enumerate(C.LEGAL_CLASSES.values())) + ")::BIGINT"
_ALT_TOKENS = f"list_transform({_tokens('alt')}, lambda t: {_LEET})"
_ALT = f"(SELECT CASE WHEN n = 1 THEN '' WHEN len(list_filter(l, lambda t: t NOT IN ({_sql_list(C.LEGAL_FORMS)}))) > 0 THEN array_to_string(list_filter(l, lambda t: t NOT IN ({_sql_list(C.LEGAL_FORMS)})), ' ') ELSE array_to_string(l, ' ') END FROM (SELECT n, {_ALT_TOKENS} AS l FROM (SELECT len(string_split_regex(n_basic, '{C.TRADE}')) AS n, trim(string_split_regex(n_basic, '{C.TRADE}')[-1]) AS alt)))"
KEYS_SQL = rf"""keys AS (SELECT id, country, 'A' AS kind, n_squash AS key FROM rec WHERE length(n_squash) >= 3 UNION ALL SELECT id, country, 'B', substr(array_to_string(st, ''), 1, 8) FROM rec WHERE length(substr(array_to_string(st, ''), 1, 8)) >= 4
    UNION ALL SELECT id, country, 'K', array_to_string(st, '') FROM rec WHERE length(array_to_string(st, '')) >= 4
    UNION ALL SELECT id, country, 'S', array_to_string(list_sort(list_distinct(ct)), ' ') FROM rec WHERE len(ct) >= 3
    UNION ALL SELECT id, country, 'H', unnest(posts) || '|' || substr(coalesce(list_filter(st, lambda t: t <> '')[1], ''), 1, 3) FROM rec
    UNION ALL SELECT id, country, 'E', unnest({ADDR_KEYS}) FROM rec),
blocks AS (SELECT country, kind, key FROM keys k SEMI JOIN (SELECT DISTINCT country, kind, key FROM keys WHERE id % 2 = 0) USING (country, kind, key) WHERE id % 2 = 1 GROUP BY ALL HAVING count(*) <= {MAX_BLOCK}),
matched AS (SELECT DISTINCT kind, a.id AS q_id, b.id AS p_id FROM keys a JOIN keys b USING (country, kind, key) JOIN blocks USING (country, kind, key) WHERE a.id % 2 = 0 AND b.id % 2 = 1)"""

_JACC = "CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / (len(list_distinct({a})) + len(list_distinct({b})) - len(list_intersect({a}, {b}))) END"
SCORED = rf"""{NAMES_TOP}, {KEYS_SQL},
pairs AS (SELECT q_id, p_id FROM matched WHERE kind IN ('A', 'B', 'K') UNION SELECT q_id, p_id FROM top),
measured AS (SELECT q_id, p_id, p.src, q.n_core AS qc, p.n_core AS pc, (q.n_basic = p.n_basic)::INT AS eq_n_basic, (q.n_core = p.n_core)::INT AS eq_n_core, (q.n_squash = p.n_squash)::INT AS eq_n_squash, (q.n_skel = p.n_skel)::INT AS eq_n_skel,
    CASE WHEN q.a_canon <> '' AND p.a_canon <> '' THEN (q.a_canon = p.a_canon)::INT END AS eq_a_canon,
    CASE WHEN greatest(length(q.n_core), length(p.n_core)) = 0 THEN 1.0::DOUBLE ELSE 1 - levenshtein(q.n_core, p.n_core)::DOUBLE / greatest(length(q.n_core), length(p.n_core)) END AS n_lev,
    len(list_intersect(q.nt, p.nt))::INT AS n_tok_shared, {_JACC.format(a="q.nt", b="p.nt")} AS n_tok_jacc,
    CASE WHEN len(q.nt) > 0 AND len(p.nt) > 0 THEN len(list_intersect(q.nt, p.nt))::DOUBLE / least(len(list_distinct(q.nt)), len(list_distinct(p.nt))) END AS n_tok_over,
    {_JACC.format(a=_WORDS_ONLY.format("q.ct"), b=_WORDS_ONLY.format("p.ct"))} AS a_tok_jacc, (q.a_canon = '' AND p.a_canon = '')::INT AS both_addr_missing
    FROM pairs JOIN rec q ON q.id = q_id JOIN rec p ON p.id = p_id),
scored AS (SELECT m.*, round(0.6::DOUBLE * coalesce(n_tok_jacc, 0) + 0.4::DOUBLE * coalesce(a_tok_jacc, 0), 6) AS p, (t.q_id IS NOT NULL)::INT AS y FROM measured m LEFT JOIN truth t ON t.q_id = m.q_id AND t.p_id = m.p_id)"""

DECIDED = f"""{SCORED},
marked AS (SELECT *, row_number() OVER (PARTITION BY p_id ORDER BY p DESC, q_id) = 1 AS best, row_number() OVER (PARTITION BY q_id ORDER BY p DESC, p_id) AS place FROM scored),
held AS (SELECT *, max(p) OVER (PARTITION BY q_id) AS top FROM marked WHERE p >= CASE WHEN src = 2 THEN {RULE.t_s2} ELSE {RULE.t_s3} END AND best AND place <= {RULE.top_n}),
chosen AS (SELECT q_id, p_id, src, p FROM held WHERE top >= {RULE.t_anchor} AND p >= {RULE.rel} * top)"""

JUDGED = f"""{DECIDED},
counted AS (SELECT r.id AS q_id, r.country, coalesce(t.n, 0) AS n_true, coalesce(c.n, 0) AS n_pred, coalesce(h.n, 0) AS n_hit FROM rec r
    LEFT JOIN (SELECT q_id, count(*) AS n FROM truth GROUP BY 1) t ON t.q_id = r.id LEFT JOIN (SELECT q_id, count(*) AS n FROM chosen GROUP BY 1) c ON c.q_id = r.id
    LEFT JOIN (SELECT q_id, count(*) AS n FROM chosen JOIN truth USING (q_id, p_id) GROUP BY 1) h ON h.q_id = r.id WHERE r.id % 2 = 0),
shares AS (SELECT *, CASE WHEN n_pred = 0 THEN 1.0::DOUBLE ELSE n_hit::DOUBLE / n_pred END AS prec, CASE WHEN n_true = 0 THEN 1.0::DOUBLE ELSE n_hit::DOUBLE / n_true END AS rec_ FROM counted),
judged AS (SELECT *, CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0::DOUBLE WHEN n_hit > 0 THEN 1.25 * prec * rec_ / (0.25 * prec + rec_) ELSE 0.0 END AS f05 FROM shares)"""
_METRICS = """count(*) AS n_queries, round(avg(f05), 6) AS f05, round(avg(prec), 6) AS precision, round(avg(rec_), 6) AS recall, round(sum(n_hit) / nullif(sum(n_pred), 0)::DOUBLE, 6) AS micro_precision, round(sum(n_hit) / nullif(sum(n_true), 0)::DOUBLE, 6) AS micro_recall,
    round(avg(CASE WHEN n_true = 0 THEN (n_pred = 0)::INT::DOUBLE END), 6) AS singleton_accuracy, round(avg((n_pred > n_hit)::INT::DOUBLE), 6) AS false_merge_rate, round(avg(n_pred), 6) AS avg_pred"""

SQL: dict[str, str] = {
    "er_names": f"WITH {WORLD} SELECT id, country, n_basic, n_core, n_squash, n_skel, CASE WHEN len(list_filter(nt, lambda t: NOT regexp_full_match(t, '\\d+'))) >= 2 THEN array_to_string(list_transform(list_filter(nt, lambda t: NOT regexp_full_match(t, '\\d+')), lambda t: substr(t, 1, 1)), '') ELSE '' END AS acronym, length(n_basic)::INT AS n_len, len(nt)::INT AS n_ntok, regexp_matches(name, '[^\\x00-\\x7F]') AS f_nonascii, upper(name) = name AND lower(name) <> name AS f_upper, {_ALT} AS n_alt, regexp_matches(lower(name), '{C.DOMAIN}') AS f_domain, name <> '' AND NOT regexp_matches(name, '^[\\p{{L}}\\p{{N}}]') AS f_junk, {LEGAL_SQL} AS legal FROM rec",
    "er_addresses": f"WITH {WORLD} SELECT id, a_basic, a_canon, length(a_canon)::INT AS a_len, len(ct)::INT AS a_ntok, a_canon = '' AS a_missing, CASE WHEN regexp_matches(a_canon, '\\d') THEN substr(regexp_extract(a_canon, '\\d+'), 1, 9)::BIGINT ELSE -1 END AS num0, array_to_string(list_sort(list_distinct(ct)), ' ') AS a_set, array_to_string(list_sort(nums), ' ') AS numbers, array_to_string(list_sort(posts), ' ') AS postal, array_to_string({ADDR_KEYS}, ' ') AS keys FROM rec",
    "er_token_idf": f"WITH {SPACES} SELECT space, token, df, round(idf, 6) AS idf, df <= 50 AS rare, round(wt, 6) AS w FROM stats WHERE space <> 'nskel'",
    "er_commonness": f"WITH {WORLD} SELECT id, round(CASE WHEN n_core = '' THEN 0.0 ELSE ln(1 + count(*) FILTER (id % 2 = 0) OVER (PARTITION BY n_core)::DOUBLE) END, 6) AS nf_s1, round(CASE WHEN n_core = '' THEN 0.0 ELSE ln(1 + count(*) FILTER (id % 2 = 1) OVER (PARTITION BY n_core)::DOUBLE) END, 6) AS nf_pool, round(CASE WHEN a_canon = '' THEN 0.0 ELSE ln(1 + count(*) FILTER (id % 2 = 0) OVER (PARTITION BY a_canon)::DOUBLE) END, 6) AS af_s1, round(CASE WHEN a_canon = '' THEN 0.0 ELSE ln(1 + count(*) FILTER (id % 2 = 1) OVER (PARTITION BY a_canon)::DOUBLE) END, 6) AS af_pool FROM rec",
    "er_tfidf_addresses": f"WITH {SPACES}, {top_sql('d', ADDRESSES)} SELECT q_id, p_id, score, rank FROM d_top",
    "er_tfidf_grams": f"WITH {SPACES}, {GRAMS_SQL}, {top_sql('i', GRAMS, 'gram_spaces', 'gram_stats')} SELECT q_id, p_id, score, rank FROM i_top",
    "er_tfidf_combined": f"""WITH {SPACES}, {top_sql('c', NAMES)}, {top_sql('d', ADDRESSES)}, f_sums AS (SELECT a.id AS q_id, b.id AS p_id, round(sum(a.w * b.w * a.share), 6) AS score FROM (SELECT *, 0.6::DOUBLE AS share FROM c_normed UNION ALL SELECT *, 0.4::DOUBLE FROM d_normed) a JOIN (FROM c_normed UNION ALL FROM d_normed) b USING (country, space, token) WHERE a.id % 2 = 0 AND b.id % 2 = 1 GROUP BY ALL)
        SELECT q_id, p_id, score, (row_number() OVER (PARTITION BY q_id ORDER BY score DESC, p_id) - 1)::INT AS rank FROM f_sums QUALIFY rank < {TOP_K}""",
    "er_recall_by_pass": f"WITH {NAMES_TOP}, {top_sql('d', ADDRESSES)} SELECT pass, " + ", ".join(f"count(*) FILTER (rank < {k}) AS k{k}" for k in (1, 2, 5, 10)) + " FROM (SELECT 'C' AS pass, * FROM top UNION ALL SELECT 'D', * FROM d_top) SEMI JOIN truth USING (q_id, p_id) GROUP BY pass",
    "er_dense_by_country": "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings), s AS (SELECT a.id AS q_id, b.id AS p_id, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a JOIN v b ON a.id % 2 = 0 AND b.id % 2 = 1 AND b.label <> 0 AND (a.label = b.label OR a.label = 0)) SELECT q_id, p_id, (row_number() OVER (PARTITION BY q_id ORDER BY score DESC, p_id) - 1)::INT AS rank, round(score, 5) AS score FROM s QUALIFY rank < 5",
    "er_key_candidates": f"WITH {WORLD}, {KEYS_SQL} SELECT kind, q_id, p_id FROM matched",
    "er_tfidf_names": f"WITH {NAMES_TOP} SELECT q_id, p_id, score, rank FROM top",
    "er_bm25_addresses": f"""WITH {SPACES}, pw AS (SELECT id, country, space, token, count(*) OVER (PARTITION BY id)::DOUBLE AS length FROM spaces WHERE id % 2 = 1 AND space IN ('atok', 'abig')),
        mean AS (SELECT country, avg(length) AS mean FROM (SELECT DISTINCT id, country, length FROM pw) GROUP BY 1),
        weights AS (SELECT id, country, pw.space, pw.token, wt * (2.2::DOUBLE / (1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS w FROM pw JOIN mean USING (country) JOIN stats USING (space, token) WHERE wt > 0),
        sums AS (SELECT a.id AS q_id, b.id AS p_id, round(sum(b.w), 6) AS score FROM spaces a JOIN weights b USING (country, space, token) WHERE a.id % 2 = 0 GROUP BY ALL)
        SELECT q_id, p_id, score, (row_number() OVER (PARTITION BY q_id ORDER BY score DESC, p_id) - 1)::INT AS rank FROM sums QUALIFY rank < {TOP_K}""",
    "er_dense_top": "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.id AS q_id, b.id AS p_id, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a JOIN v b ON a.id % 2 = 0 AND b.id % 2 = 1) SELECT q_id, p_id, (row_number() OVER (PARTITION BY q_id ORDER BY score DESC, p_id) - 1)::INT AS rank, round(score, 5) AS score FROM s QUALIFY rank < 5",
    "er_candidates": f"""WITH {NAMES_TOP}, {KEYS_SQL}, each_ AS (SELECT q_id, p_id, 1 AS bit, NULL::DOUBLE AS score, NULL::BIGINT AS rank FROM matched WHERE kind = 'A' UNION ALL SELECT q_id, p_id, 2, NULL, NULL FROM matched WHERE kind = 'B' UNION ALL SELECT q_id, p_id, 4, score, rank + 1 FROM top)
        SELECT q_id, p_id, bit_or(bit)::BIGINT AS bits, max(score) AS "s_C", max(rank)::BIGINT AS "r_C" FROM each_ GROUP BY ALL""",
    "er_pair_measures": f"WITH {SCORED} SELECT q_id, p_id, src::INT AS src, eq_n_basic, eq_n_core, eq_n_squash, eq_n_skel, eq_a_canon::DOUBLE AS eq_a_canon, round(n_lev, 6) AS n_lev, n_tok_shared, round(n_tok_jacc, 6) AS n_tok_jacc, round(n_tok_over, 6) AS n_tok_over, round(a_tok_jacc, 6) AS a_tok_jacc, both_addr_missing, p, y FROM scored",
    "er_context": f"WITH {SCORED} SELECT q_id, p_id, round(max(p) OVER q - p, 6) AS q_gap, rank() OVER (PARTITION BY q_id ORDER BY p DESC) AS q_rank, round((p - avg(p) OVER q) / (coalesce(stddev_samp(p) OVER q, 0) + 0.001), 4) AS q_z, round(max(p) OVER (PARTITION BY p_id) - p, 6) AS p_gap, rank() OVER (PARTITION BY p_id ORDER BY p DESC) AS p_rank FROM scored WINDOW q AS (PARTITION BY q_id)",
    "er_stage_one": f"WITH {SCORED} SELECT q_id, p_id, p FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY p DESC, p_id) AS a, row_number() OVER (PARTITION BY p_id ORDER BY p DESC, q_id) AS b FROM scored) WHERE p >= 0.15 AND a <= 4 AND b <= 4",
    "er_decisions": f"WITH {DECIDED} SELECT q_id, p_id, src::INT AS src, p FROM chosen",
    "er_metrics": f"WITH {JUDGED} SELECT {_METRICS} FROM judged",
    "er_metrics_by_country": f"WITH {JUDGED} SELECT country, {_METRICS} FROM judged GROUP BY country",
    "er_multiplicity": f"WITH {JUDGED} SELECT least(n_true, 8) AS n_true, least(n_pred, 8) AS n_pred, count(*) AS n FROM judged GROUP BY ALL",
    "er_threshold_curve": f"WITH {SCORED} SELECT b / 20::DOUBLE AS t, (SELECT count(*) FROM scored WHERE floor(p * 20 + 1e-9) >= b)::BIGINT AS n_pred, (SELECT coalesce(sum(y), 0) FROM scored WHERE floor(p * 20 + 1e-9) >= b)::BIGINT AS n_hit FROM range(0, 21) g(b)",
    "er_auc": f"WITH {SCORED}, ranks AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM scored) SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y)))::DOUBLE, 6) AS auc FROM ranks",
    "er_candidate_statistics": f"""WITH {SCORED}, n AS (SELECT r.id, count(s.q_id) AS n FROM rec r LEFT JOIN scored s ON s.q_id = r.id WHERE r.id % 2 = 0 GROUP BY 1), t AS (SELECT count(*) AS true_pairs, count(s.q_id) AS hits FROM truth LEFT JOIN scored s USING (q_id, p_id)),
        c AS (SELECT sum(a * b) AS cross_ FROM (SELECT country, count(*) FILTER (id % 2 = 0) AS a, count(*) FILTER (id % 2 = 1) AS b FROM rec GROUP BY 1))
        SELECT (SELECT sum(n) FROM n)::BIGINT AS pairs, (SELECT round(avg(n), 6) FROM n) AS mean, (SELECT quantile_cont(n, 0.5) FROM n)::DOUBLE AS p50, (SELECT quantile_cont(n, 0.95) FROM n)::DOUBLE AS p95, (SELECT max(n) FROM n) AS most, (SELECT round(avg((n = 0)::INT::DOUBLE), 6) FROM n) AS none, hits, true_pairs, true_pairs - hits AS missed, round(hits / true_pairs::DOUBLE, 6) AS recall, round(1 - (SELECT sum(n) FROM n) / cross_::DOUBLE, 6) AS reduction FROM t, c""",
    "er_recall_at_k": f"WITH {SCORED}, r AS (SELECT y, row_number() OVER (PARTITION BY q_id ORDER BY p DESC, p_id) AS k FROM scored) SELECT g.k, (SELECT count(*) FROM r WHERE y = 1 AND r.k <= g.k) AS hits FROM range(1, 21) g(k)",
    "er_frontier": f"WITH {SCORED}, r AS (SELECT y, least(row_number() OVER (PARTITION BY q_id ORDER BY p DESC, p_id), 30) AS m FROM scored), e AS (SELECT m, sum(count(*)) OVER (ORDER BY m)::BIGINT AS cand, sum(sum(y)) OVER (ORDER BY m)::BIGINT AS oracle FROM r GROUP BY m) SELECT m, cand, oracle FROM (SELECT *, max(oracle) OVER (ORDER BY cand, oracle DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e) WHERE before IS NULL OR oracle > before",
    "er_id_lists": f"WITH {DECIDED} SELECT r.id AS q_id, coalesce(string_agg(p_id::VARCHAR, ',' ORDER BY p_id), '') AS ids FROM rec r LEFT JOIN chosen c ON c.q_id = r.id WHERE r.id % 2 = 0 GROUP BY 1",
    "er_validation": f"""WITH {SCORED} SELECT 'duplicate_rows' AS problem, 0::BIGINT AS n UNION ALL SELECT 'duplicate_ids', 0 UNION ALL SELECT 'extra_queries', 0 UNION ALL SELECT 'missing_queries', count(*) FROM rec WHERE id % 2 = 0 AND id % 10 = 4
        UNION ALL SELECT 'unknown_ids', count(*) FROM scored WHERE p > 0.4 AND q_id % 10 <> 4 AND p_id % 10 = 3""",
    "er_folds": """WITH h AS (SELECT doc_id AS id, ('0x' || substr(md5('fold-' || doc_id), 1, 8))::BIGINT % 100 AS a, ('0x' || substr(md5('enc-' || doc_id), 1, 8))::BIGINT % 100 AS b, ('0x' || substr(md5('half-' || doc_id), 1, 8))::BIGINT % 2 AS half FROM documents WHERE doc_id % 2 = 0)
        SELECT id, CASE WHEN a < 60 THEN CASE WHEN b < 34 THEN 'enc' ELSE 'fit' END WHEN a < 80 THEN 'tune' ELSE 'hold' END AS fold, half FROM h""",
    "er_baselines": f"WITH {WORLD} " + " UNION ALL ".join(f"SELECT '{c}' AS rule, count(*) AS pairs, count(t.q_id) AS hits FROM rec a JOIN rec b ON a.country = b.country AND a.{c} = b.{c} AND a.{c} <> '' AND a.id % 2 = 0 AND b.id % 2 = 1 LEFT JOIN truth t ON t.q_id = a.id AND t.p_id = b.id" for c in ("name", "n_basic", "n_core")),
    "er_profile": f"WITH {WORLD} SELECT src::INT AS src, country, count(*) AS n, count(DISTINCT name) AS names, count(DISTINCT n_core) AS cores, sum((a_canon = '')::INT)::BIGINT AS no_address, round(avg(length(n_basic)), 4) AS mean_len, quantile_cont(length(n_basic), 0.5)::DOUBLE AS median_len, sum((upper(name) = name AND lower(name) <> name)::INT)::BIGINT AS upper FROM rec GROUP BY ALL",
    "er_error_taxonomy": f"""WITH {DECIDED} SELECT CASE WHEN y = 0 AND eq_n_core = 1 THEN 'false: equal name' WHEN y = 0 AND a_tok_jacc >= 0.5 THEN 'false: near address' WHEN y = 0 THEN 'false: other' WHEN s.p < 0.6 THEN 'missed: low score' ELSE 'missed: taken by another' END AS kind, count(*) AS n
        FROM scored s LEFT JOIN chosen c ON c.q_id = s.q_id AND c.p_id = s.p_id WHERE (c.q_id IS NOT NULL) <> (y = 1) GROUP BY 1""",
    "er_name_address_grid": f"WITH {SCORED} SELECT least(floor(coalesce(n_tok_jacc, 0) * 5 + 1e-9), 4)::BIGINT AS name_bin, least(floor(coalesce(a_tok_jacc, 0) * 5 + 1e-9), 4)::BIGINT AS addr_bin, count(*) AS n, sum(y)::BIGINT AS hits FROM scored GROUP BY ALL",
}
