import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave import queries, reports
from kinweave.functions import similarity as S
from kinweave.functions import text as T
from kinweave.operators import linkage as L
from kinweave.sources import tables

SF = "/root/testdata/sf0.001"


ALL_QUERIES, ALL_SQL = queries.QUERIES | reports.QUERIES, queries.SQL | reports.SQL


@pytest.mark.parametrize("name", sorted(ALL_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = con.execute(ALL_SQL[name])
    columns = [c[0] for c in found.description]
    got = ALL_QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    text = lambda rows: sorted("|".join("" if v is None else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)
    assert text(got.select(*columns).collect()) == text(found.fetchall())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "basic", "core"),
    [
        ("Jordan & Hartley Business L.L.C.", "jordan and hartley business llc", "jordan hartley business"),
        ("Community League 0f New Philadelphia Corp", "community league 0f new philadelphia corp", "community league new philadelphia"),
        ("victorylaboratories.com", "victorylaboratories", "victorylaboratories"),
        ("Smt SMB (INDIA) ÉDUCATION PRIVATE LIMITED", "smt smb india education private limited", "smt smb india education"),
        ("The Co", "the co", "the co"),
        (None, "", ""),
    ],
)
def test_names(spark, name, basic, core):
    assert one(spark, T.name_basic(F.lit(name).cast("string"))) == basic
    assert one(spark, T.name_core(F.lit(basic))) == core


def test_text_cases(spark):
    assert one(spark, T.addr_canon(T.addr_basic(F.lit("520 3TH STREET, NULL, NEW PHILADELPHIA, OH")))) == "520 3 st new philadelphia oh"
    assert one(spark, T.name_alt(F.lit("iridova ta ettis audio installation"))) == "ettis audio installation"
    assert one(spark, T.addr_keys(F.lit("0520 3 river rd 12 ab 7 whizz"))) == ["3|rvr", "7|vhs"]
    assert one(spark, T.postal_codes(F.lit("44663 main 44663 oh 110001"))) == ["44663", "110001"]
    assert one(spark, T.numbers(F.lit("007 a12b 0 12"))) == ["7", "12", "0"]
    assert one(spark, T.char_grams(F.lit("ab c"))) == [" ab", "ab ", " c "]
    assert one(spark, T.first_number(F.lit("no digits"))) == -1
    assert one(spark, T.name_basic(F.lit("राम"), scripts=True)) == "ram"
    assert one(spark, T.script(F.lit("abc राम"))) == "DEVANAGARI"


def test_similarities_against_brute_force():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *itertools.accumulate(range(1, len(b) + 1), lambda v, j, row=row, x=x: max(v, row[j], row[j - 1] + (x == b[j - 1])), initial=0)][1:]
        return row[-1]

    for a, b in itertools.product(["", "a", "kitten", "sitting", "abcabba", "cbabac"], repeat=2):
        assert S._common(a, b) == lcs(a, b)
    con = duckdb.connect()
    for a, b in (("martha", "marhta"), ("dixon", "dicksonx"), ("jellyfish", "smellyfish"), ("same", "same"), ("ab", "cd")):
        assert S.jaro_winkler(a, b) == pytest.approx(con.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0])
    assert S.partial("abc", "xxabcxx") == 1.0 and S.partial("", "a") == 0.0


def test_expected_f05_against_enumeration():
    rng = np.random.default_rng(0)
    for extra in (0.0, 0.1):
        for _ in range(25):
            p = np.sort(rng.random(rng.integers(1, 6)))[::-1]

            def value(k, p=p, extra=extra):
                total = 0.0
                for y in itertools.product([0, 1], repeat=len(p)):
                    w = np.prod([q if b else 1 - q for q, b in zip(p, y, strict=True)])
                    for more, share in ((0, 1 - extra), (1, extra)):
                        true, hit = sum(y) + more, sum(y[:k])
                        total += w * share * ((1.0 if not true else 0.0) if not k else 1.25 * hit / (0.25 * true + k))
                return total

            k, best = L.expected_f05(p, extra)
            values = [value(j) for j in range(len(p) + 1)]
            assert best == pytest.approx(max(values)) and values[k] == pytest.approx(max(values))


def test_metric_example(spark):
    queries_ = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "id long, country string")
    chosen = spark.createDataFrame([(1, 47), (1, 193), (1, 812), (3, 5)], "q_id long, p_id long")
    truth = spark.createDataFrame([(1, 47), (1, 812)], "q_id long, p_id long")
    got = {r["q_id"]: r["f05"] for r in L.per_query(queries_, chosen, truth).collect()}
    assert got[1] == pytest.approx(0.714, abs=5e-4) and got[2] == 1.0 and got[3] == 0.0


def test_learned_map(spark):
    rows = [(["main", "road"], ["main", "rd"])] * 6 + [(["x", "road"], ["x", "rode"])] * 2
    assert L.learned_map(spark.createDataFrame(rows, "l array<string>, r array<string>"), least=3) == {"rd": "road"}


def test_dense_blocks_equal_broadcast(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q, p = rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")
    take = lambda df: sorted((r["q_id"], r["rank"], r["p_id"]) for r in df.collect())
    assert take(L.dense_top(q, p, 3)) == take(L.dense_top(q, p, 3, block=60, broadcast_bytes=0))


def test_tsv_round_trip(spark, tmp_path):
    (tmp_path / "Sub").mkdir()
    (tmp_path / "Sub" / "Train_Source1.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"A ""B"""\t\tUS\nS1-2\tNA\tnull\tIN\n')
    path = tables.discover(spark, str(tmp_path), ["train_source1.tsv"])["train_source1.tsv"]
    rows = tables.read_tsv(spark, path, tables.RECORD).collect()
    assert [tuple(r) for r in rows] == [("S1-1", 'A "B"', "", "US"), ("S1-2", "NA", "null", "IN")]
    with pytest.raises(FileNotFoundError):
        tables.discover(spark, str(tmp_path), ["none.tsv"])


def test_stream_resolves_arriving_records(spark, tmp_path):
    from kinweave.streaming.resolve import resolve_stream

    w = queries.world(spark, SF)
    raw = tables.documents_world(spark, SF).pool
    raw.repartition(3).write.parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    score = lambda df: df.withColumn("p", F.coalesce("n_tok_jacc", F.lit(0.0)))
    resolve_stream(arriving, w.queries, score, L.Rule(), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    pairs = L.key_join(L.block_keys(w.queries), L.block_keys(w.pool)).select("q_id", "p_id").distinct()
    assert 0 < got.select("q_id", "p_id").distinct().count() <= pairs.count()


def test_matcher_scores_every_pair(spark):
    rows = queries.er_matcher(spark, SF)
    assert rows.filter("probability IS NULL").isEmpty() and rows.count() == queries.er_pair_measures(spark, SF).count()


def test_pass_plan_equals_a_plan_over_sets(spark):
    rng = np.random.default_rng(5)
    some = lambda n: {(int(q), int(p)) for q, p in zip(rng.integers(0, 20, n), rng.integers(0, 30, n), strict=True)}
    frame = lambda pairs: spark.createDataFrame(sorted(pairs), "q_id long, p_id long")
    true, a, deep, wide = some(40), some(60), some(150), some(300)
    shallow = set(sorted(deep)[::3])
    options = [("A", None, a | set(sorted(true)[:20])), ("C", 1, shallow), ("C", 5, deep), ("D", 9, wide | true)]
    got = L.pass_plan([(n, k, frame(p)) for n, k, p in options], frame(true), 20, most=11)
    union, chosen, wanted = set(), {}, []
    while True:
        best = None
        for name, depth, pairs in options:
            if name in chosen and (depth is None or depth <= (chosen[name] or 0)):
                continue
            fresh = pairs - union
            gain = len(fresh & true) / len(true)
            worth = gain / max(len(fresh) / 20, 0.25)
            if gain >= 1e-4 and len(union | pairs) <= 220 and (best is None or worth > best[0]):
                best = worth, name, depth, pairs
        if best is None:
            break
        chosen[best[1]] = best[2]
        union |= best[3]
        wanted.append((best[1], best[2], len(union), round(len(union & true) / len(true), 5)))
    assert wanted and [(s["pass"], s["depth"], s["pairs"], s["recall"]) for s in got] == wanted


def test_string_measures_of_every_scored_pair(spark):
    names = {(r["q_id"], r["p_id"]): (r["q_n_core"], r["p_n_core"]) for r in queries.scored(spark, SF)[1].select("q_id", "p_id", "q_n_core", "p_n_core").collect()}
    rows = queries.er_string_measures(spark, SF).collect()
    assert len(rows) == len(names) and {(r["q_id"], r["p_id"]) for r in rows} == set(names)
    for r in rows:
        a, b = names[r["q_id"], r["p_id"]]
        assert r["n_jw"] == pytest.approx(S.jaro_winkler(a, b), abs=1e-5)
        assert r["n_ratio"] == pytest.approx(S.indel(a, b), abs=1e-6)
        assert r["n_partial"] == pytest.approx(S.partial(a, b), abs=1e-6)
        assert r["n_tsort"] == pytest.approx(S.indel(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), abs=1e-6)
        assert r["n_tset"] >= r["n_tsort"] - 1e-6 or set(a.split()) != set(b.split())


def test_pass_plan_counts_pairs_of_large_blocks(spark, tmp_path):
    docs = [(k, "one long enough name of six words and then an address 12 main road", "en") for k in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    first = queries.er_pass_plan(spark, str(tmp_path)).first()
    assert first["pass"] in ("A", "B", "K") and (first["pairs"], first["recall"]) == (400, 1.0)
