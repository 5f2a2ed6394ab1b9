"""Measures of candidate pairs over token vectors that each record has once: weighted sets, one-sided tokens, anchors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import similarity as S
from kinweave.functions import text as T
from kinweave.operators import linkage as L

#: Prefixes of the measures of a token space.
BLOCKS = {"ntok": "n_tok", "nskel": "n_skl", "atok": "a_tok", "abig": "a_big", "anum": "a_num"}
ATTRIBUTES = ("n_len", "n_ntok", "a_len", "a_ntok", "f_domain", "f_nonascii", "f_upper", "f_junk", "a_missing", "nf_s1", "nf_pool", "af_s1", "af_pool")


def idf_of(df: Column, size: int) -> Column:
    return F.log((F.lit(size) + 1.0) / (df + 1.0)) + 1.0


def vectors(rows: DataFrame, pool: DataFrame, size: int) -> DataFrame:
    """Records with ``v_<space>``, a map from token to idf over the pool, its sums ``w_`` of weights and ``w2_`` of their
    squares, and ``v_nchar``, a map from gram to its share of the norm.
    """
    spaces = tuple(BLOCKS)
    df = L.token_spaces(pool, spaces).groupBy("space", "token").agg(F.count("*").alias("df"))
    weighed = L.token_spaces(rows, spaces).join(df, ["space", "token"], "left").withColumn("w", idf_of(F.coalesce("df", F.lit(0)), size))
    entry = F.struct("token", "w")
    of = lambda s, c: F.when(F.col("space") == s, c)
    w = F.col("w")
    maps = weighed.groupBy("id").agg(
        *[F.map_from_entries(F.collect_list(of(s, entry))).alias(f"v_{s}") for s in spaces], *[F.coalesce(F.sum(of(s, w)), F.lit(0.0)).alias(f"w_{s}") for s in spaces], *[F.coalesce(F.sum(of(s, w * w)), F.lit(0.0)).alias(f"w2_{s}") for s in spaces]
    )
    grams = rows.select("id", F.explode(T.char_grams(F.col("n_core"))).alias("g")).groupBy("id", "g").agg(F.count("*").cast("double").alias("tf"))
    grams = grams.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("g", "tf"))).alias("v_nchar"), F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("_norm"))
    grams = grams.select("id", F.transform_values("v_nchar", lambda _, x: x / F.col("_norm")).alias("v_nchar"))
    empty = F.create_map().cast("map<string,double>")
    out = rows.join(maps, "id", "left").join(grams, "id", "left").fillna(0.0, [f"{k}_{s}" for k in ("w", "w2") for s in spaces])
    return out.withColumns({f"v_{s}": F.coalesce(f"v_{s}", empty) for s in (*spaces, "nchar")})


def commonness(rows: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """How common the core name (nf) and the canonical address (af) are among queries (s1) and pool: log1p of the count."""
    for tag, column in (("nf", "n_core"), ("af", "a_canon")):
        for side, table in (("s1", queries), ("pool", pool)):
            counts = table.filter(F.col(column) != "").groupBy(column).agg(F.log1p(F.count("*").cast("double")).alias(f"{tag}_{side}"))
            rows = rows.join(counts, column, "left").fillna(0.0, [f"{tag}_{side}"])
    return rows


def token_measures(pairs: DataFrame, queries: DataFrame, pool: DataFrame, size: int) -> DataFrame:
    """A row for each pair and space: q_id, p_id, space and the measures; those of two sets are null if either is empty.

    Records have ``vectors``. Shared tokens are found once for each pair and space.
    """
    columns = [f"{k}_{s}" for s in BLOCKS for k in ("v", "w", "w2")]
    rows = L.with_records(pairs, queries, pool, columns)
    each = F.array(*[F.struct(F.lit(s).alias("space"), *[F.col(f"{side}_{k}_{s}").alias(f"{side}_{k}") for side in "qp" for k in ("v", "w", "w2")]) for s in BLOCKS])
    rows = rows.select("q_id", "p_id", F.explode(each).alias("m")).select("q_id", "p_id", "m.*")
    q, p, a, b, both = F.col("q_v"), F.col("p_v"), F.map_keys("q_v"), F.map_keys("p_v"), F.col("_both")
    rows = rows.withColumn("_both", F.array_intersect(a, b))
    worth = lambda own, weight: F.coalesce(F.array_max(F.transform(F.array_except(own, both), lambda t: F.element_at(weight, t))), F.lit(0.0))
    rows = rows.withColumns({"n1": F.size(q), "n2": F.size(p), "shared": F.size(both), "_weights": F.transform(both, lambda t: F.element_at(q, t)), "uq_max": worth(a, q), "up_max": worth(b, p)})
    rows = rows.withColumns({"_w": F.aggregate("_weights", F.lit(0.0), lambda s, x: s + x), "_w2": F.aggregate("_weights", F.lit(0.0), lambda s, x: s + x * x)})
    rare = math.log((size + 1) / 51) + 1 - 1e-9  # the idf of a token in 50 records
    n, m, k, w = F.col("n1"), F.col("n2"), F.col("shared"), F.col("_w")
    some = (n > 0) & (m > 0)
    out = {
        "shared": k, "jacc": F.when(some, k / (n + m - k)), "overlap": F.when(some, k / F.least(n, m)), "wjacc": F.when(some, w / F.greatest(F.col("q_w") + F.col("p_w") - w, F.lit(1e-6))),
        "cos": F.when(some, F.col("_w2") / F.sqrt(F.greatest(F.col("q_w2") * F.col("p_w2"), F.lit(1e-12)))), "rare_shared": F.size(F.filter("_weights", lambda x: x >= rare)), "n1": n, "n2": m,
        "set_eq": ((k == n) & (k == m) & (n > 0)).cast("int"), "uq_idf": F.col("q_w") - w, "up_idf": F.col("p_w") - w, "uq_max": F.col("uq_max"), "up_max": F.col("up_max"),
        "u_minmax": F.least("uq_max", "up_max"), "u_maxmax": F.greatest("uq_max", "up_max"),
    }
    return rows.select("q_id", "p_id", "space", *[c.alias(name) for name, c in out.items()])


def _numbers_in_name(side: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(f"{side}_n_basic"), F.lit(r"(\d+)"), 1)))


NEEDED = ["name", "addr", "n_basic", "n_core", "n_squash", "n_skel", "n_alt", "a_basic", "a_canon", "num0", "legal", "anum", "apost", "v_nchar", "v_ntok", "v_atok", "w2_ntok", "w2_atok", *ATTRIBUTES]


def record_measures(pairs: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Equalities, gram cosine, acronyms, numbers, postal codes, lengths, legal forms and both records' attributes of pairs.

    Records have ``vectors`` and ``commonness``; the pool also ``src``.
    """
    rows = L.with_records(pairs, queries, pool, NEEDED).join(pool.select(F.col("id").alias("p_id"), "src"), "p_id")
    q, p = (lambda c: F.col(f"q_{c}")), (lambda c: F.col(f"p_{c}"))
    no_addr = (q("a_canon") == "") | (p("a_canon") == "")
    equal = lambda c: (q(c) == p(c)).cast("int")
    shared = lambda c: F.size(F.array_intersect(q(c), p(c)))
    numbers, fewest = shared("anum"), F.least(F.size(q("anum")), F.size(p("anum")))
    legal = (q("legal") != 0) & (p("legal") != 0)
    agree = q("legal").bitwiseAND(p("legal")) != 0
    mine, theirs = _numbers_in_name("q"), _numbers_in_name("p")
    named = (F.size(mine) > 0) & (F.size(theirs) > 0)
    acronym = lambda a, b: (F.length(b("n_squash")) >= 2) & (T.acronym(a("n_core")) == b("n_squash"))
    rows = rows.withColumns({f"_{s}": F.array_intersect(F.map_keys(q(f"v_{s}")), F.map_keys(p(f"v_{s}"))) for s in ("nchar", "ntok", "atok")})
    product = lambda s: F.transform(f"_{s}", lambda t: F.element_at(q(f"v_{s}"), t) * F.element_at(p(f"v_{s}"), t))
    rows = rows.withColumns({f"_{s}_w": product(s) for s in ("nchar", "ntok", "atok")})
    total = lambda s: F.aggregate(f"_{s}_w", F.lit(0.0), lambda x, y: x + y)
    cosine = {s: total(s) / F.sqrt(F.greatest(q(f"w2_{s}") * p(f"w2_{s}"), F.lit(1e-12))) for s in ("ntok", "atok")}
    ratio = lambda c: F.least(q(c), p(c)) / F.greatest(q(c), p(c), F.lit(1))
    out = {f"{name}_eq": equal(c) for name, c in (("n_raw", "name"), ("n_basic", "n_basic"), ("n_core", "n_core"), ("n_squash", "n_squash"), ("n_skel", "n_skel"))}
    out |= {f"{name}_eq": F.when(~no_addr, equal(c)) for name, c in (("a_raw", "addr"), ("a_basic", "a_basic"), ("a_canon", "a_canon"))}
    out |= {"n_lev": S.levenshtein_similarity(q("n_core"), p("n_core")), "n_acronym": (acronym(q, p) | acronym(p, q)).cast("int")}
    out |= {"n_char_cos": total("nchar")}
    out |= {"a_num_conflict": ((fewest > 0) & (numbers == 0)).cast("int"), "a_num_subset": ((fewest > 0) & (numbers == fewest)).cast("int")}
    out |= {"a_num0_eq": F.when((q("num0") >= 0) & (p("num0") >= 0), equal("num0"))}
    out |= {"a_post_eq": (shared("apost") > 0).cast("int"), "a_post_conflict": ((F.size(q("apost")) > 0) & (F.size(p("apost")) > 0) & (shared("apost") == 0)).cast("int")}
    out |= {"a_post_missing": ((F.size(q("apost")) == 0) | (F.size(p("apost")) == 0)).cast("int"), "comb_cos": 0.6 * cosine["ntok"] + 0.4 * cosine["atok"]}
    out |= {"n_len_ratio": ratio("n_len"), "a_len_ratio": F.when(~no_addr, ratio("a_len")), "both_addr_missing": (q("a_missing") & p("a_missing")).cast("int"), "src_s3": (F.col("src") == 3).cast("int")}
    out |= {"fe_legal_both": legal.cast("int"), "fe_legal_agree": F.when(legal, agree.cast("int")), "fe_legal_conflict": (legal & ~agree).cast("int")}
    out |= {"fe_namenum_eq": F.when(named, (mine == theirs).cast("int")), "fe_namenum_conflict": (named & ~F.arrays_overlap(mine, theirs)).cast("int"), "fe_namenum_one_side": ((F.size(mine) > 0) != (F.size(theirs) > 0)).cast("int")}
    out |= {f"{side}_{c}": F.col(f"{side}_{c}").cast("double") for side in "qp" for c in ATTRIBUTES}
    return rows.select("q_id", "p_id", *[c.alias(name) for name, c in out.items()])


def fuzzy_measures(pairs: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Edit-distance measures of names and addresses, all in one pass over the pairs; equal pairs of texts of a batch are measured once."""
    rows = L.with_records(pairs, queries, pool, ["n_basic", "n_core", "n_squash", "n_skel", "n_alt", "a_canon"])
    jobs = [("n_ratio", S.ratio, "n_basic", "n_basic"), ("n_jw", S.jaro_winkler_similarity, "n_core", "n_core"), ("n_tsort", S.token_sort_ratio, "n_core", "n_core"), ("n_tset", S.token_set_ratio, "n_core", "n_core"), ("n_partial", S.partial_ratio, "n_squash", "n_squash")]
    jobs += [("n_sq_ratio", S.ratio, "n_squash", "n_squash"), ("n_skel_ratio", S.ratio, "n_skel", "n_skel"), ("_alt1", S.ratio, "n_core", "n_alt"), ("_alt2", S.ratio, "n_alt", "n_core")]
    jobs += [("a_ratio", S.ratio, "a_canon", "a_canon"), ("a_tset", S.token_set_ratio, "a_canon", "a_canon"), ("a_tsort", S.token_sort_ratio, "a_canon", "a_canon"), ("a_partial", S.partial_ratio, "a_canon", "a_canon")]
    some = lambda a, b: (F.col(a) != "") & (F.col(b) != "")
    rows = rows.withColumns({name: f(F.col(f"q_{a}"), F.col(f"p_{b}")) for name, f, a, b in jobs})
    # undefined where a side is empty
    rows = rows.withColumns({name: F.when(some(f"q_{a}", f"p_{b}"), F.col(name)) for name, _, a, b in jobs if "alt" in name or name.startswith("a_")})
    return rows.select("q_id", "p_id", *[name for name, *_ in jobs if not name.startswith("_")], F.greatest("_alt1", "_alt2").alias("n_alt_ratio"), (F.coalesce("n_tset", F.lit(0.0)) * F.coalesce("a_tset", F.lit(0.5))).alias("name_x_addr"))
