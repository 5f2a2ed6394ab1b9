"""Steps between candidates and decisions: contexts of pool records and groups, second-stage references, pruning, row caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import similarity as S
from kinweave.operators import linkage as L

#: Column prefixes of the groups that an ablation leaves out.
FEATURE_GROUPS = {"name": ("n_",), "address": ("a_",), "numbers": ("a_num", "fe_namenum"), "legal": ("fe_legal",), "records": ("q_", "p_"), "blocking": ("blk_", "s_", "r_"), "context": ("fe_p_", "fe_dup")}
CONTEXT_ENDS = ("_gap", "_rank", "_z")


def rank_gap(rows: DataFrame, column: str, by: str, prefix: str) -> DataFrame:
    """Unique ranks (ties by query, then pool record) and the gap to the best, within a group; null counts as -1."""
    v = F.coalesce(F.col(column).cast("double"), F.lit(-1.0))
    group = Window.partitionBy(by)
    return rows.withColumns({f"{prefix}_rank": F.row_number().over(group.orderBy(v.desc(), "q_id", "p_id")), f"{prefix}_gap": F.max(v).over(group) - v})


def pool_context(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How many queries a pool record is a candidate of, and where each of them stands by ``columns``."""
    rows = rows.withColumn("fe_p_ncand", F.count("*").over(Window.partitionBy("p_id")))
    for c in columns:
        rows = rank_gap(rows, c, "p_id", f"fe_p_{c}")
    return rows


def name_copies(rows: DataFrame, core: str = "p_n_core") -> DataFrame:
    """Other candidates of the query with the same core name: of the same source, and of any."""
    others = lambda *by: F.count("*").over(Window.partitionBy("q_id", *by)) - 1
    return rows.withColumns({"fe_dup_name_same_src": others("src", core), "fe_dup_name_any_src": others(core)})


def second_stage(rows: DataFrame) -> DataFrame:
    """Of pairs (q_id, p_id, src, p): ranks and counts by ``p``, the best pair of the other source and the best other one of its own."""
    query, source = Window.partitionBy("q_id"), Window.partitionBy("q_id", "src")
    high = (F.col("p") >= 0.5).cast("int")
    place = F.row_number().over(source.orderBy(F.desc("p"), "p_id"))
    rows = rows.withColumns({"p1_rank": F.rank().over(query.orderBy(F.desc("p"))), "p1_qmax": F.max("p").over(query), "p1_q_n50": F.sum(high).over(query), "p1_src_n50": F.sum(high).over(source), "_place": place})
    rows = rows.withColumn("p1_gap", F.col("p1_qmax") - F.col("p"))
    best = lambda source_, k: F.struct(F.max(F.when((F.col("src") == source_) & (F.col("_place") == k), F.col("p_id"))).over(query).alias("id"), F.max(F.when((F.col("src") == source_) & (F.col("_place") == k), F.col("p"))).over(query).alias("p"))
    tops = {f"_{s}_{k}": best(s, k) for s in (2, 3) for k in (1, 2)}
    rows = rows.withColumns(tops)
    other = F.when(F.col("src") == 2, F.col("_3_1")).otherwise(F.col("_2_1"))
    own = F.when(F.col("src") == 2, F.when(F.col("_place") == 1, F.col("_2_2")).otherwise(F.col("_2_1"))).otherwise(F.when(F.col("_place") == 1, F.col("_3_2")).otherwise(F.col("_3_1")))
    out = rows.withColumns({"xsrc_id": other["id"], "xsrc_p1": other["p"], "ssrc_id": own["id"], "ssrc_p1": own["p"]})
    return out.drop("_place", *tops)


def gram_cosine(a: Column, b: Column) -> Column:
    """Of two maps from gram to its share of the norm."""
    return F.aggregate(F.array_intersect(F.map_keys(a), F.map_keys(b)), F.lit(0.0), lambda s, g: s + F.element_at(a, g) * F.element_at(b, g))


def support(rows: DataFrame, pool: DataFrame, fuzzy: bool = True) -> DataFrame:
    """How each pair's record resembles its references of ``second_stage``: gram cosine, token-set ratios and support."""
    for tag in ("xsrc", "ssrc"):
        side = lambda name: pool.select(F.col("id").alias(f"_{name}"), F.col("v_nchar").alias(f"_{name}_g"), F.col("n_core").alias(f"_{name}_n"), F.col("a_canon").alias(f"_{name}_a"))  # noqa: B023, E731
        rows = rows.join(side("own"), rows["p_id"] == F.col("_own")).join(side("ref"), rows[f"{tag}_id"] == F.col("_ref"), "left")
        rows = rows.withColumn(f"{tag}_char", F.when(F.col("_ref").isNotNull(), gram_cosine(F.col("_own_g"), F.col("_ref_g"))))
        if fuzzy:
            names = F.when(F.col("_ref").isNotNull(), S.token_set_ratio(F.col("_own_n"), F.col("_ref_n")))
            some = F.col("_ref").isNotNull() & (F.col("_own_a") != "") & (F.col("_ref_a") != "")
            rows = rows.withColumns({f"{tag}_n_tset": names, f"{tag}_a_tset": F.when(some, S.token_set_ratio(F.col("_own_a"), F.col("_ref_a")))})
            best = F.greatest(F.coalesce(f"{tag}_n_tset", F.lit(0.0)), F.coalesce(f"{tag}_a_tset", F.lit(0.0)))
            rows = rows.withColumn(f"{tag}_support", F.coalesce(f"{tag}_p1", F.lit(0.0)) * best)
        rows = rows.drop(*[c for c in rows.columns if c.startswith(("_own", "_ref"))])
    return rows


def in_safe_zone(name: list[str], addr: list[str], least: float = 0.2) -> Column:
    """Neither the name nor the address measures reach ``least``; undefined ones are 0."""
    low = lambda cs: F.greatest(F.lit(0.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cs]) < least
    return low(name) & low(addr)


def prune_safe_zone(rows: DataFrame, name: list[str], addr: list[str], max_loss: float = 0.001) -> tuple[DataFrame, float]:
    """The rows outside the safe zone, if that loses no more than ``max_loss`` of the true pairs; and what it would lose.

    Columns of context must be computed anew afterwards.
    """
    safe = in_safe_zone(name, addr)
    true, lost = rows.agg(F.sum("y"), F.sum(F.when(safe, F.col("y")).otherwise(0))).first()
    loss = (lost or 0) / max(1, true or 0)
    return (rows.filter(~safe) if loss <= max_loss else rows), loss


def uncertain_band(rows: DataFrame, low: float, high: float, top_n: int, most: int) -> DataFrame:
    """Pairs with p within the band among a query's best; beyond ``most`` rows those closest to 0.5 stay, which is the feature."""
    place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("p"), "p_id"))
    rows = rows.withColumn("_place", place).filter(F.col("p").between(low, high) & (F.col("_place") <= top_n)).drop("_place")
    return rows.orderBy(F.abs(F.col("p") - 0.5), "q_id", "p_id").limit(most)


def without_groups(rows: DataFrame, groups: list[str], protect: tuple[str, ...] = ("q_id", "p_id")) -> DataFrame:
    """Columns less those of ``FEATURE_GROUPS``; leaving out the context also drops gaps, ranks and z-scores."""
    prefixes = tuple(p for g in groups for p in FEATURE_GROUPS[g])
    ends = CONTEXT_ENDS if "context" in groups else ()
    return rows.select([c for c in rows.columns if c in protect or not (c.startswith(prefixes) or c.endswith(ends))])


def without_context(rows: DataFrame) -> DataFrame:
    return rows.drop(*[c for c in rows.columns if c.startswith("blk_") or c.endswith(CONTEXT_ENDS) or c in ("q_ncand", "fe_p_ncand")])


def random_pairs(queries: DataFrame, pool: DataFrame, rounds: int = 1) -> DataFrame:
    """For each query ``rounds`` pool records of its country, drawn by hash: q_id, p_id."""
    numbered = pool.select(F.col("id").alias("p_id"), "country", (F.row_number().over(Window.partitionBy("country").orderBy(F.md5(F.concat(F.lit("place-"), F.col("id").cast("string"))), "id")) - 1).cast("long").alias("at"))
    sizes = pool.groupBy("country").agg(F.count("*").alias("n"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("draw-"), F.col("id").cast("string"), F.lit("-"), F.col("k").cast("string"))), 1, 8), 16, 10).cast("long")
    drawn = queries.select("id", "country", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("k")).join(sizes, "country").select(F.col("id").alias("q_id"), "country", (draw % F.col("n")).alias("at"))
    return drawn.join(numbered, ["country", "at"]).select("q_id", "p_id").distinct()


def missed_pairs(truth: DataFrame, candidates: DataFrame, queries: DataFrame, pool: DataFrame, most: int = 12) -> DataFrame:
    """True pairs that no pass found, with both names and addresses; a report of the first ``most``."""
    lost = truth.join(candidates.select("q_id", "p_id"), ["q_id", "p_id"], "left_anti")
    return L.with_records(lost, queries, pool, ["name", "addr"]).orderBy("q_id", "p_id").limit(most)
