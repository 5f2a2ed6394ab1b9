"""Sources and sinks: record and truth tables from TSV, the pool, linkage worlds, id lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"


def discover(spark: SparkSession, root: str, names: list[str]) -> dict[str, str]:
    """The path of each name's file below ``root`` on any file system Spark reads; case doesn't matter, the least path wins.

    Spark's listing leaves hidden files and folders out.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.lower(F.element_at(F.split("path", "/"), -1)).alias("file"))
    chosen = listed.filter(F.col("file").isin([n.lower() for n in names])).groupBy("file").agg(F.min("path").alias("path"))
    paths = {r["file"]: r["path"] for r in chosen.collect()}  # at most one row a name
    lacking = sorted({n for n in names if n.lower() not in paths})
    if lacking:
        raise FileNotFoundError(f"below {root} there is no {', '.join(lacking)}")
    return {n: paths[n.lower()] for n in names}


def read_tsv(spark: SparkSession, path: str, schema: str, nrows: int | None = None) -> DataFrame:
    """All text: nothing is taken for null, and an empty field is an empty string. Header names may have blanks around.

    Quoted fields may hold line breaks, so one file is one task.
    """
    rows = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', nullValue="\x00", emptyValue="", encoding="UTF-8", multiLine=True, inferSchema=False)
    wanted = [part.split()[0] for part in schema.split(",")]
    rows = rows.toDF(*(c.strip() for c in rows.columns))
    if missing := [c for c in wanted if c not in rows.columns]:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    rows = rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in wanted))
    return rows if nrows is None else rows.limit(nrows)


def pool(second: DataFrame, third: DataFrame) -> DataFrame:
    both = second.withColumn("src", F.lit(2).cast("tinyint")).unionByName(third.withColumn("src", F.lit(3).cast("tinyint")))
    return both.withColumn("country_key", F.lower(F.trim("country")))


def truth_pairs(truth: DataFrame) -> DataFrame:
    """Distinct (s1_id, o_id)."""
    exploded = truth.select(F.trim("source1_entity_id").alias("s1_id"), F.explode(F.split("matched_entity_ids", ",")).alias("o_id"))
    return exploded.select("s1_id", F.trim("o_id").alias("o_id")).filter("o_id <> ''").distinct()


@dataclass(frozen=True)
class World:
    """Records to resolve (id, country, name, addr), the pool (also src) and the true pairs (q_id, p_id)."""

    queries: DataFrame
    pool: DataFrame
    truth: DataFrame


def documents_world(spark: SparkSession, sf_dir: str) -> World:
    """Even documents look for odd ones with an equal text; the first words are the name, the next ones the address."""
    words = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda t: t != "")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text", words.alias("w"))
    rows = docs.select(F.col("doc_id").alias("id"), F.lower(F.trim("lang")).alias("country"), F.array_join(F.slice("w", 1, 6), " ").alias("name"), F.array_join(F.slice("w", 7, 12), " ").alias("addr"))
    own = rows.filter("id % 2 = 0")
    other = rows.filter("id % 2 = 1").withColumn("src", (2 + F.floor(F.col("id") / 2) % 2).cast("int"))
    # equal texts meet by a digest of 32 bytes
    same = docs.filter("text IS NOT NULL").select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    left = same.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("q_id"), "digest")
    right = same.filter("doc_id % 2 = 1").select(F.col("doc_id").alias("p_id"), "digest")
    return World(own, other, left.join(right, "digest").select("q_id", "p_id"))


def id_lists(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per query, in its matches' order of ids; empty without any."""
    lists = pairs.groupBy("q_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("p_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return queries.select(F.col("id").alias("q_id")).join(lists, "q_id", "left").select("q_id", F.coalesce("ids", F.lit("")).alias("ids"))


def write_id_lists(lists: DataFrame, path: str, header: tuple[str, str] = ("source1_entity_id", "matched_entity_ids")) -> None:
    """One file of lines id, tab, list, in the order of the ids; a reader of the folder gets one header."""
    rows = lists.select(F.col("q_id").cast("string").alias("q"), F.coalesce("ids", F.lit("")).alias("ids"), F.lit(1).alias("k"))
    head = lists.sparkSession.createDataFrame([(*header, 0)], "q string, ids string, k int")
    rows.unionByName(head).coalesce(1).sortWithinPartitions("k", F.length("q"), "q").select(F.concat_ws("\t", "q", "ids").alias("value")).write.mode("overwrite").text(path)


def save_world(world: World, path: str) -> None:
    """The world's tables below ``path``; each folder has its marker when it is complete."""
    for name in ("queries", "pool", "truth"):
        getattr(world, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_world(spark: SparkSession, path: str) -> World:
    return World(*(spark.read.parquet(f"{path}/{name}") for name in ("queries", "pool", "truth")))


def latest_runs(summary: DataFrame, key: str = "exp", at: str = "ts", score: str = "f05") -> DataFrame:
    """The last row of each experiment, the best first."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))
    return summary.withColumn("_last", last).filter("_last = 1").drop("_last").orderBy(F.desc(score), key)


def cap_rows_by_query(rows: DataFrame, most: int) -> DataFrame:
    """Whole groups of queries, in the order of a hash, as long as their rows stay within ``most``."""
    sizes = rows.groupBy("q_id").agg(F.count("*").alias("_n"))
    order = F.md5(F.concat(F.lit("cap-"), F.col("q_id").cast("string")))
    upto = sizes.withColumn("_sum", F.sum("_n").over(Window.orderBy(order, "q_id")))
    return rows.join(upto.filter(F.col("_sum") <= most).select("q_id"), "q_id", "left_semi")


def hash_share(key: Column, salt: str, modulus: int = 100) -> Column:
    """A number below ``modulus`` from the md5 of salt and key: the same in every engine."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(modulus))


def folds(rows: DataFrame, key: str = "id", fit: int = 60, tune: int = 20, encoder: int = 34) -> DataFrame:
    """fit, tune or hold for each entity; a share of fit goes to enc; and the half for out-of-fold predictions."""
    share = hash_share(F.col(key), "fold-")
    fold = F.when(share < fit, F.when(hash_share(F.col(key), "enc-") < encoder, "enc").otherwise("fit")).when(share < fit + tune, "tune").otherwise("hold")
    return rows.withColumns({"fold": fold, "half": hash_share(F.col(key), "half-", 2)})


def mini(world: World, n: int, share: int) -> World:
    """``n`` queries by hash, all their matches, and ``share`` percent of the rest of the pool."""
    some = world.queries.orderBy(F.md5(F.concat(F.lit("mini-"), F.col("id").cast("string"))), "id").limit(n)
    truth = world.truth.join(some.select(F.col("id").alias("q_id")), "q_id", "left_semi")
    matched = truth.select(F.col("p_id").alias("id")).distinct()
    rest = world.pool.join(matched, "id", "left_anti").filter(hash_share(F.col("id"), "pool-") < share)
    return World(some, world.pool.join(matched, "id", "left_semi").unionByName(rest), truth)
