"""Reports on tables: integrity, submissions, sources, representations, anchors, calibration. Each is an aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import similarity as S
from kinweave.functions import text as T

#: Fields that stand for nothing in an integrity report.
EMPTY_FIELDS = ("null", "none", "nan", "n/a", "na", "nil", "unknown", "-", "--", "0", ".", "not available", "tbd")
NULL_TOKEN = r"\b(?:null|none|nan|n/a)\b"


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("int")), F.lit(0)).cast("long")


def _long(row: DataFrame, name: str = "check") -> DataFrame:
    """The columns of a one-row table as rows (check, n)."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("long").alias("n")) for c in row.columns])).alias("r")).select("r.*")


def integrity(rows: DataFrame, prefix: str, known_countries: DataFrame | None = None) -> DataFrame:
    """check, n of a source's records (entity_id, name, addr, country): copies, empty and placeholder fields, ids, countries."""
    names = ["name", "addr", "country"]
    extra = lambda *by: rows.groupBy(*by).agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n"))
    checks = {"rows": F.count("*")}
    for c in names:
        bare = F.trim(F.col(c))
        checks |= {f"{c}_empty": _count(F.col(c) == ""), f"{c}_blank": _count((bare == "") & (F.col(c) != "")), f"{c}_placeholder": _count(F.lower(bare).isin(*EMPTY_FIELDS))}
    checks |= {"addr_null_token": _count(F.lower("addr").rlike(NULL_TOKEN)), "malformed_ids": _count(~F.col("entity_id").rlike(r"^S[123]-\d+$")), "wrong_prefix": _count(~F.col("entity_id").startswith(prefix + "-"))}
    parts = [_long(rows.agg(*[v.alias(k) for k, v in checks.items()]))]
    for check, by in (("dup_ids", ["entity_id"]), ("dup_rows", ["entity_id", *names]), ("dup_records", names)):
        parts.append(extra(*by).select(F.lit(check).alias("check"), F.col("n").cast("long").alias("n")))
    if known_countries is not None:
        unseen = rows.select(F.trim("country").alias("country")).distinct().join(known_countries.select(F.trim("country").alias("country")).distinct(), "country", "left_anti")
        parts.append(unseen.agg(F.lit("unseen_countries").alias("check"), F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, parts)


def truth_integrity(truth: DataFrame, first: DataFrame, others: DataFrame) -> DataFrame:
    """check, n of a truth table (source1_entity_id, matched_entity_ids) against the ids of the first and the other sources."""
    rows = truth.select(F.col("source1_entity_id").alias("s1"), F.col("matched_entity_ids").alias("ids"), F.monotonically_increasing_id().alias("row"))
    own, pool = first.select(F.col("entity_id").alias("s1")).distinct(), others.select(F.col("entity_id").alias("id")).distinct()
    some = F.trim("ids") != ""
    given = rows.filter(some).select("row", F.explode(F.split("ids", ",", -1)).alias("raw")).withColumn("id", F.trim("raw"))
    real = given.filter("id <> ''")
    distinct = real.select("row", "id").distinct()
    one = lambda df, check: df.agg(F.lit(check).alias("check"), F.count("*").cast("long").alias("n"))
    parts = [
        one(rows, "rows"), one(rows.filter(~some), "empty_rows"), one(given.filter("id = ''"), "empty_tokens"), one(real.filter("raw <> id"), "ids_with_blanks"),
        one(real.filter(~F.col("id").rlike(r"^S[23]-\d+$")), "bad_format"), one(real.join(pool, "id", "left_anti"), "invalid_refs"), one(distinct, "matched_ids"),
        one(rows.join(own, "s1", "left_anti"), "s1_unknown"), one(own.join(rows, "s1", "left_anti"), "s1_missing"),
    ]
    more = lambda df, by, check: df.groupBy(*by).agg((F.count("*") - 1).alias("k")).agg(F.lit(check).alias("check"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("n"))
    parts += [more(rows, ["s1"], "dup_s1_rows"), more(real, ["row", "id"], "dup_within_row"), more(distinct, ["id"], "ids_of_several_s1")]
    return reduce(DataFrame.unionByName, parts)


#: What is wrong with a submitted list, by kind; the first two end the reading of a file.
SUBMISSION_ERRORS = ("comma_separated", "bad_header", "malformed_row", "duplicate_row", "duplicate_id", "self_match", "wrong_prefix", "unknown_id", "missing_s1", "extra_s1")


def check_submission(lines: DataFrame, header: tuple[str, str], required: DataFrame, valid_ids: DataFrame | None = None) -> DataFrame:
    """error, offender of a submitted file's lines (line_number from 1, value); an empty table is a valid file.

    ``required``: the ids (entity_id) that need a row each; ``valid_ids``: those that lists may name, unchecked if None.
    Each kind is an aggregation or an anti join, so a file of any size is checked without gathering it.
    """
    spark = lines.sparkSession
    schema = "error string, offender string"
    first = lines.filter("line_number = 1").select("value").first()
    head = first["value"] if first else ""
    if "\t" not in head and "," in head:
        return spark.createDataFrame([("comma_separated", head)], schema)
    if [c.strip().lower() for c in head.rstrip("\n").split("\t")] != list(header):
        return spark.createDataFrame([("bad_header", head)], schema)
    rows = lines.filter("line_number > 1").withColumn("tab", F.instr("value", "\t"))
    bad = rows.filter((F.col("tab") == 0) & (F.trim("value") != "")).select(F.lit("malformed_row").alias("error"), F.col("line_number").cast("string").alias("offender"))
    good = rows.filter("tab > 0").select("line_number", F.expr("substring(value, 1, tab - 1)").alias("s1"), F.expr("substring(value, tab + 1)").alias("rest"))
    listed = good.withColumn("ids", F.when(F.trim("rest") != "", F.split("rest", ",", -1)).otherwise(F.array().cast("array<string>")))
    each = listed.select("s1", F.explode(F.array_distinct("ids")).alias("id"))
    kind = F.when(F.col("id").startswith("S1-"), "self_match").when(~F.col("id").startswith("S2-") & ~F.col("id").startswith("S3-"), "wrong_prefix")
    parts = [
        bad, good.groupBy("s1").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate_row"), "s1"), listed.filter(F.size("ids") != F.size(F.array_distinct("ids"))).select(F.lit("duplicate_id"), "s1").distinct(),
        each.withColumn("kind", kind).filter("kind IS NOT NULL").select("kind", "id").distinct(),
        required.select(F.col("entity_id").alias("s1")).join(good, "s1", "left_anti").select(F.lit("missing_s1"), "s1"),
        good.select("s1").distinct().join(required.select(F.col("entity_id").alias("s1")), "s1", "left_anti").select(F.lit("extra_s1"), "s1"),
    ]
    if valid_ids is not None:
        unknown = each.filter(kind.isNull()).select("id").distinct().join(valid_ids.select(F.col("entity_id").alias("id")), "id", "left_anti")
        parts.append(unknown.select(F.lit("unknown_id"), "id"))
    return reduce(DataFrame.union, [p.toDF("error", "offender") for p in parts])


def matches_within(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches (q_id, p_id) that aren't among the candidates: a warning of the official check, an error of the own one."""
    return matches.select("q_id", "p_id").distinct().join(candidates.select("q_id", "p_id"), ["q_id", "p_id"], "left_anti")


def source_profile(rows: DataFrame, by: tuple[str, ...] = ("src",)) -> DataFrame:
    """Shares (percent), lengths and counts that describe a source's names and addresses."""
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda t: t != ""))
    share = lambda c: F.round(100 * F.avg(c.cast("double")), 4)
    unique = lambda *cs: F.round(100 * F.countDistinct(*cs) / F.count("*"), 4)
    return rows.groupBy(*by).agg(
        F.count("*").alias("records"), unique("name").alias("uniq_names"), unique("addr").alias("uniq_addr"), F.countDistinct("country").alias("n_countries"), share(F.trim("addr") == "").alias("empty_addr"),
        F.round(100 * (F.count("*") - F.countDistinct("name", "addr", "country")) / F.count("*"), 4).alias("dup_records"), F.percentile(F.length("name"), 0.5).alias("name_len_med"), F.percentile(F.length("name"), 0.95).alias("name_len_p95"),
        F.round(F.avg(words("name")), 4).alias("name_words"), share(F.col("name").rlike(r"[0-9]")).alias("name_digit"), share(F.col("name").rlike(r"[^\p{L}\p{N}_\s]")).alias("name_punct"), share(F.col("name").rlike(r"[^\x00-\x7F]")).alias("name_nonascii"),
        share(F.col("name").rlike("[À-ɏ]")).alias("name_accented"), share(F.col("f_upper")).alias("name_upper"), share(F.col("f_junk")).alias("name_junk"), share(F.col("f_domain")).alias("name_domain"),
        F.percentile(F.length("addr"), 0.5).alias("addr_len_med"), F.round(F.avg(words("addr")), 4).alias("addr_words"), F.round(F.avg(F.length(F.regexp_replace("addr", r"[^0-9]", ""))), 4).alias("addr_digits"),
        share(F.lower("addr").rlike(NULL_TOKEN)).alias("addr_null_token"), share(F.col("addr").rlike(r"[^\x00-\x7F]")).alias("addr_nonascii"),
    )


def scripts(rows: DataFrame) -> DataFrame:
    """script, n, share of names by the script of their first letter beyond Latin."""
    counts = rows.groupBy(T.script(F.col("name")).alias("script")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # a row per script


def representations(queries: DataFrame, pool: DataFrame, truth: DataFrame, columns: list[str]) -> DataFrame:
    """How well equality of each column stands for a match: distinct values, collisions among queries, true pairs it joins, precision."""
    out = None
    for c in columns:
        values = queries.groupBy("country", c).agg(F.count("*").alias("n"))
        pairs = truth.join(queries.select(F.col("id").alias("q_id"), F.col(c).alias("a")), "q_id").join(pool.select(F.col("id").alias("p_id"), F.col("country"), F.col(c).alias("b")), "p_id")
        pairs = pairs.join(values.select("country", F.col(c).alias("b"), "n"), ["country", "b"], "left").withColumns({"eq": ((F.col("a") == F.col("b")) & (F.col("b") != "")).cast("int"), "same": F.when(F.col("b") != "", F.coalesce("n", F.lit(0))).otherwise(0)})
        own = values.agg(F.count("*").alias("unique_values"), F.round(100 * F.coalesce(F.try_divide(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)), F.sum("n")), F.lit(0.0)), 4).alias("s1_collision"))
        joined = pairs.agg(F.round(100 * F.avg("eq"), 4).alias("pos_equal"), F.round(100 * F.sum("eq") / F.greatest(F.sum("same"), F.lit(1)), 4).alias("precision"), F.round(F.avg("same"), 4).alias("mean_sharing"))
        role = F.when((F.col("pos_equal") >= 15) & (F.col("precision") >= 50), "blocking key + feature").when(F.col("pos_equal") >= 15, "feature only (ambiguous)").otherwise("feature only (low coverage)")
        row = own.join(joined).select(F.lit(c).alias("representation"), "*", role.alias("role"))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def anchors(pairs: DataFrame) -> DataFrame:
    """What addresses of pairs (q_a_canon, p_a_canon) have in common, in percent."""
    q, p = F.col("q_a_canon"), F.col("p_a_canon")
    numbers, postal = (T.numbers(q), T.numbers(p)), (T.postal_codes(q), T.postal_codes(p))
    both = lambda x: (F.size(x[0]) > 0) & (F.size(x[1]) > 0)
    hit = lambda x: F.size(F.array_intersect(*x)) > 0
    sums = pairs.agg(
        F.count("*").alias("n"), _count(both(numbers)).alias("numbers"), _count(both(numbers) & hit(numbers)).alias("shared"), _count(both(postal)).alias("postal"), _count(both(postal) & hit(postal)).alias("equal"),
        _count(hit((T.addr_keys(q), T.addr_keys(p)))).alias("keys"), _count((T.token_set(q) == T.token_set(p)) & (q != p) & (q != "")).alias("reordered"),
    )
    of = lambda a, b: F.round(100 * F.col(a) / F.greatest(F.col(b), F.lit(1)), 4)
    return sums.select("n", of("numbers", "n").alias("both_numbers"), of("shared", "numbers").alias("numbers_overlap"), F.round(100 * (F.col("numbers") - F.col("shared")) / F.greatest("numbers", F.lit(1)), 4).alias("numbers_conflict"), of("postal", "n").alias("both_postal"), of("equal", "postal").alias("postal_equal"), of("keys", "n").alias("key_shared"), of("reordered", "n").alias("reordered"))


def calibration(rows: DataFrame, score: str = "p", label: str = "y", bins: int = 10, clip: float = 1e-6) -> DataFrame:
    """Log loss and Brier score of all rows, and per bin of the score its rows, mean score and share of positives."""
    p = F.least(F.greatest(F.col(score), F.lit(clip)), F.lit(1 - clip))
    y = F.col(label).cast("double")
    each = rows.select(p.alias("p"), y.alias("y"), F.least(F.floor(F.col(score) * bins + 1e-9), F.lit(bins - 1)).cast("long").alias("bin"), (-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("loss"), ((F.col(score) - y) * (F.col(score) - y)).alias("brier"))
    by = each.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"), F.sum("loss").alias("_l"), F.sum("brier").alias("_b"))
    every = Window.partitionBy()  # a row per bin
    return by.select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("rate", 6).alias("rate"), F.round(F.sum("_l").over(every) / F.sum("n").over(every), 6).alias("log_loss"), F.round(F.sum("_b").over(every) / F.sum("n").over(every), 6).alias("brier"))


def quantiles(rows: DataFrame, column: str = "p", at: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    got = rows.agg(F.percentile(column, F.array(*map(F.lit, at))).alias("v"))
    return got.select(F.posexplode("v").alias("k", "value")).select(F.element_at(F.array(*map(F.lit, at)), F.col("k") + 1).alias("q"), F.round("value", 6).alias("value"))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson's correlation of each two columns, in one pass."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    row = rows.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"c{k}", 6).alias("corr")) for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(each).alias("r")).select("r.*")


def singletons(queries: DataFrame, pool_tokens: DataFrame, truth: DataFrame) -> DataFrame:
    """Queries without and with a match: how long and how common their names are, and how rare their rarest token is."""
    counts = pool_tokens.filter("space = 'ntok'").groupBy("country", "token").agg(F.count("*").alias("df"))
    rarest = queries.select("id", "country", F.explode("ntok").alias("token")).join(counts, ["country", "token"], "left").groupBy("id").agg(F.min(F.coalesce("df", F.lit(0))).alias("rarest"))
    matched = truth.select(F.col("q_id").alias("id")).distinct().withColumn("_m", F.lit(1))
    rows = queries.select("id", "n_len", "n_ntok", "legal", "a_missing").join(rarest, "id", "left").join(matched, "id", "left")
    return rows.groupBy(F.col("_m").isNull().alias("singleton")).agg(F.count("*").alias("n"), F.round(F.avg("n_len"), 4).alias("name_len"), F.round(F.avg("n_ntok"), 4).alias("name_tokens"), F.round(F.avg((F.col("legal") != 0).cast("double")), 6).alias("legal_share"), F.round(F.avg(F.col("a_missing").cast("double")), 6).alias("no_address"), F.round(F.avg("rarest"), 4).alias("rarest_token"))


def strength(queries: DataFrame, rows: DataFrame, truth: DataFrame, bins: int = 10) -> DataFrame:
    """How strong the best candidate of queries without and with a match is: bin of the score, -1 without candidates."""
    top = rows.groupBy("q_id").agg(F.max("p").alias("top"))
    matched = truth.select("q_id").distinct().withColumn("_m", F.lit(1))
    each = queries.select(F.col("id").alias("q_id")).join(top, "q_id", "left").join(matched, "q_id", "left")
    bin_ = F.coalesce(F.least(F.floor(F.col("top") * bins + 1e-9), F.lit(bins - 1)), F.lit(-1)).cast("long")
    return each.groupBy(F.col("_m").isNull().alias("singleton"), bin_.alias("bin")).agg(F.count("*").alias("n"))


def country_diagnostics(queries: DataFrame, candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per country: queries, candidates and chosen pairs a query, shares with a match and without any candidate."""
    count = lambda df, name: df.groupBy("q_id").agg(F.count("*").alias(name))
    rows = queries.select(F.col("id").alias("q_id"), "country").join(count(candidates, "c"), "q_id", "left").join(count(chosen, "m"), "q_id", "left").fillna(0, ["c", "m"])
    six = lambda c, name: F.round(c, 6).alias(name)
    return rows.groupBy("country").agg(F.count("*").alias("n"), six(F.avg("c"), "candidates"), six(F.avg("m"), "chosen"), six(F.avg((F.col("m") > 0).cast("double")), "with_match"), six(F.avg((F.col("c") == 0).cast("double")), "without_candidate"))


def overlap_measures(pairs: DataFrame) -> DataFrame:
    """Jaccard of tokens, grams, skeletons, numbers and bigrams of pairs that have both records' token spaces."""
    spaces = {"tokens": "ntok", "grams": "nchar", "skeletons": "nskel", "addr_tokens": "atok", "numbers": "anum", "bigrams": "abig"}
    return pairs.withColumns({f"j_{name}": S.jaccard(F.col(f"q_{s}"), F.col(f"p_{s}")) for name, s in spaces.items()})


def first_match(rules: list[tuple[str, Column]], default: str) -> Column:
    """The name of the first rule that holds."""
    out = F
    for name, rule in rules:
        out = out.when(F.coalesce(rule, F.lit(False)), name)
    return out.otherwise(default)


def fuzzy_taxonomy(missed: bool) -> Column:
    """The category of a falsely chosen or a missed pair, by its measures and both records' attributes."""
    c = lambda name, null=0.0: F.coalesce(F.col(name).cast("double"), F.lit(null))
    if not missed:
        return first_match([
            ("normalisation collision", (c("n_skel_eq") == 1) & (c("n_basic_eq") == 0) & (c("n_tset") < 0.8)), ("same name, other branch", (c("n_core_eq") == 1) & (c("a_tset", 1.0) < 0.6)),
            ("common business name", c("p_nf_s1") >= F.log1p(F.lit(5.0))), ("same address, other business", (c("a_tset") >= 0.9) & (c("n_tset") < 0.6)),
            ("missing address", c("q_a_missing") + c("p_a_missing") > 0), ("only common tokens shared", (c("rare_shared") == 0) & (c("shared") > 0)),
        ], "other")
    return first_match([
        ("blocking miss", ~F.col("in_candidates")), ("missing address", c("p_a_missing") > 0), ("transliteration", c("p_f_nonascii") > 0), ("domain or handle", c("p_f_domain") > 0),
        ("word order", (c("n_tsort") >= 0.95) & (c("n_ratio") < 0.95)), ("typo", c("n_ratio") >= 0.8), ("abbreviation or acronym", (c("n_acronym") == 1) | (c("n_tset") >= 0.8)), ("trade name", (c("n_tset") < 0.5) & (c("a_tset") >= 0.8)),
    ], "severe corruption or other")
