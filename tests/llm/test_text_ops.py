"""Operators on single documents against brute force, exact round trips and held-out accuracy."""

import base64
import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from kinweave.llm import bpe, langid, ogg, packing, repetition

SCHEMA = "doc_id long, text string, lang string, ids string, bucket int"
ODD = [
    (1, None, "en", "x", 0), (2, "", None, "x", 0), (None, "no id here", "en", "x", 1), (3, " \n\t ", "en", None, 1), (4, "a", "en", "x", 2), (4, "a", "en", "x", 2),
    (5, "same line\nsame line\n\nother", "en", "x", 2), (6, "über\x85 \xa0 the  end \n", "de", "x", 2), (7, "word " * 30_000, "en", "x", 2), (8, "日本語 テスト 123 't's  <|endoftext|>", "ja", "x", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_repetition_against_brute_force(spark, odd, docs):
    rules = repetition.Rules()

    def brute(text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        counts = {}
        for g in grams:
            counts[g] = counts.get(g, 0) + 1
        marked = set()
        for i, g in enumerate(grams):
            if counts[g] > 1:
                marked |= set(range(i, i + 5))
        failed = len(words) < 10 or 100 * len(marked) > 20 * len(words)
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), failed

    for df in (odd, docs):
        texts = [r["text"] for r in df.select("text").collect()]
        rows = repetition.judge(df, rules).collect()
        got = sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
        assert got == sorted(brute(t) for t in texts)
        assert all(not r["kept"] for r in rows if r["base_failed"])
    assert repetition.judge(odd.limit(0)).count() == 0
    clash = repetition.judge(odd.withColumnRenamed("ids", "kept"), carry=("kept", "lang"))
    assert dict(clash.dtypes)["kept"] == "boolean" and clash.columns.count("kept") == 1 and "lang" in clash.columns


def test_repetition_verdict_against_brute_force(spark, docs):
    rules = repetition.Rules()
    rows = {r["doc_id"]: r for r in repetition.judge(docs, rules).collect()}
    verdicts = set()
    for r in docs.collect():
        got, text = rows[r["doc_id"]], r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        chars = sum(map(len, words))
        seen, line_chars = set(), 0
        for line in text.split("\n"):
            if line in seen:
                line_chars += len(re.sub(r"[\x20\x09-\x0D]", "", line))
            seen.add(line)
        good = line_chars <= rules.line_share * chars
        for n, most in rules.ngram_share:
            seen, inside = set(), set()
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in seen:
                    inside |= set(range(k, k + n))
                seen.add(tuple(words[k : k + n]))
            share = sum(len(words[k]) for k in inside)
            assert got[f"dup_chars_{n}"] == share
            good = good and share <= most * chars
        assert got["dup_line_chars"] == line_chars and got["kept"] == (good and not got["base_failed"])
        verdicts.add((got["kept"], got["base_failed"]))
    assert len(verdicts) >= 2


def test_repetition_coverage_counts_each_character_once():
    words = [f"w{i}" for i in range(40)]
    text = " ".join(words + words[:10])
    found = repetition.measure(text, repetition.Rules())
    assert found[8] == [sum(map(len, words[:10]))] * 4


def test_bpe_equals_tiktoken_and_decodes(spark, odd, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (odd, docs):
        want = sorted((len(ids := own.encode_ordinary(r["text"] or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in df.collect())
        got = sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(df, path, public_tokenizers.PATTERN).collect())
        assert got == want
    stored = bpe.decode(bpe.encode(odd, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert sorted(bytes(r["decoded"]).decode() for r in stored.collect()) == sorted(r[1] or "" for r in ODD)


def test_bpe_over_many_packs_buckets_and_lists(spark, odd, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).repartition(5)
    want = sorted((str(r["doc_id"]), np.array(own.encode_ordinary(r["text"] or ""), "<u4").tobytes()) for r in rows.collect())
    settings = bpe.Settings(pack_bytes=20_000, bucket_bytes=30_000, list_bytes=150_000)
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in bpe.encode(rows, path, public_tokenizers.PATTERN, settings=settings).collect()) == want
    assert bpe.round_trip(docs.filter("false"), path, public_tokenizers.PATTERN).count() == 0
    assert [r["n_tokens"] for r in bpe.round_trip(docs.selectExpr("doc_id", "CAST(NULL AS string) AS text"), path, public_tokenizers.PATTERN).distinct().limit(1).collect()] == [0]


def test_merge_replay_on_random_strings():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    replay = bpe.replay_of(path, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=replay.ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["".join(rng.choice("aaabcdefghin th é日 \n\t12!'s") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    for text, ids in zip(texts, replay.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text)


def test_merge_replay_lets_a_lower_rank_made_on_the_way_go_first():
    # merging "ab" (rank 6) makes the pair "ab"+"c" of rank 5, which must come before the word's second "ab"
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"d": 3, b"abca": 4, b"abc": 5, b"ab": 6}
    own = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks | {b" ": 7}, special_tokens={})
    replay = bpe.MergeReplay(ranks, r"\S+|\s+")
    for text in ("abcab", "abcabc", "ababcabab", "aabcabca"):
        assert replay.replay([text.encode()])[0] == own.encode_ordinary(text)


def test_ogg_round_trip(spark, odd):
    rows = ogg.probe(ogg.encode(odd)).collect()
    want = []
    for _, text, *_ in ODD:
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        want.append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    assert all(r["bad_pages"] == r["gaps"] == 0 and r["n_streams"] == 2 for r in rows)
    assert ogg.probe(ogg.encode(odd).limit(0)).count() == 0


def test_ogg_counts_packets_without_an_end():
    media = ogg.write_samples(bytes(200_000), packet_samples=70_000)
    pages = [media[m.start() :] for m in re.finditer(b"OggS", media)]
    pages = [p[: 27 + p[26] + sum(p[27 : 27 + p[26]])] for p in pages]
    assert b"".join(pages) == media
    serial = lambda p: p[14:18]
    pcm = [k for k, p in enumerate(pages) if serial(p) == serial(pages[0])]
    assert sum(s.gaps for s in ogg.demultiplex(b"".join(pages[: pcm[1] + 1])).streams.values()) == 1
    fresh = bytearray(pages[pcm[2]])
    fresh[5] &= ~ogg.CONTINUED
    fresh[22:26] = bytes(4)
    fresh[22:26] = ogg.checksum(bytes(fresh)).to_bytes(4, "little")
    found = ogg.demultiplex(b"".join([*pages[: pcm[2]], bytes(fresh), *pages[pcm[2] + 1 :]]))
    assert found.bad_pages == 0 and sum(s.gaps for s in found.streams.values()) == 1


def test_ogg_features_against_brute_force(spark, docs):
    rows = {r["doc_id"]: r for r in ogg.probe(ogg.encode(docs)).collect()}
    media = {r["doc_id"]: bytes(r["media"]) for r in ogg.encode(docs).collect()}
    for r in docs.collect():
        payload, got = ogg.padded(r["text"]), rows[r["doc_id"]]
        packets = 1 + -(-len(payload) // 4000) + 2  # head and samples, head and notes
        want = f"streams=2;packets={packets};seconds={len(payload) / 8000:.6f};mean={sum(payload) / len(payload):.4f};peak={max(payload)}"
        assert got["feature"] == want and got["seconds"] == pytest.approx(len(payload) / 8000)
        assert (got["media_bytes"], got["media_sha256"]) == (len(media[r["doc_id"]]), hashlib.sha256(media[r["doc_id"]]).hexdigest())


def test_ogg_checksum_is_the_published_one():
    def slow(data):
        register = 0
        for byte in data:
            register ^= byte << 24
            for _ in range(8):
                register = (register << 1 ^ 0x04C11DB7 if register & 0x80000000 else register << 1) & 0xFFFFFFFF
        return register

    for data in (b"", b"OggS", bytes(range(256)) * 3):
        assert ogg.checksum(data) == slow(data)


def test_ogg_packets_over_pages_times_and_damage():
    payload = bytes(i * 7 % 256 for i in range(200_000))
    media = ogg.write_samples(payload, rate=1000, packet_samples=70_000)
    found = ogg.demultiplex(media)
    samples = ogg.read_samples(found)
    assert samples.payload == payload and samples.times == pytest.approx([70, 140, 200])
    assert found.pages > 4 and all(s.ended for s in found.streams.values())
    hurt = bytearray(media)
    hurt[len(media) // 2] ^= 1
    found = ogg.demultiplex(bytes(hurt))
    assert found.bad_pages >= 1 and sum(s.gaps for s in found.streams.values()) == 1
    assert ogg.demultiplex(None).pages == 0 and ogg.demultiplex(media[:-1]).bad_pages == 1
    exact = ogg.write_samples(bytes(255 * 255 * 2), packet_samples=255 * 255)
    assert ogg.read_samples(ogg.demultiplex(exact)).payload == bytes(255 * 255 * 2)


def test_langid_on_held_out_rows(spark, docs):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from pyspark.sql import functions as F

    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    learned = langid.learn(big, part != 2)
    assert sorted(learned) == ["de", "en", "es", "fr"]
    assert max(map(len, learned.values())) <= langid.Settings().dictionary_bytes
    rows = langid.predict(big.filter(part == 2), learned, carry=("lang",)).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_langid_against_a_plain_loop_over_all_languages(spark, docs):
    import zstandard
    from pyspark.sql import functions as F

    s = langid.Settings()
    learned = langid.learn(docs, F.lit(True))
    rows = {r["doc_id"]: r for r in langid.predict(docs, learned).collect()}
    for r in docs.collect():
        got = rows[r["doc_id"]]
        if not any(unicodedata.category(c).startswith("L") for c in r["text"] or ""):
            assert (got["lang_pred"], got["score"]) == ("und", 0)
            continue
        data, sizes = langid.letters(r["text"]).encode(), []
        for lang in sorted(learned):
            held = zstandard.ZstdCompressionDict(learned[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            size = 0
            for at in range(0, len(data), s.block_bytes):
                size += len(zstandard.ZstdCompressor(level=s.level, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False).compress(data[at : at + s.block_bytes]))
            sizes.append((size, lang))
        first, second = sorted(sizes)[:2]
        assert got["lang_pred"] == first[1] and got["margin"] == pytest.approx((second[0] - first[0]) / first[0])
        assert got["rejected"] == (got["margin"] < s.margin) and 0 < got["score"] <= 1


def test_langid_letters_ties_and_clashes(spark):
    texts = ["²³ ½", "Ⅷ", "①", "१२३", "_-", "\u0301", "ʰ", "ª", "日", "x1"]
    rows = spark.createDataFrame([(k, t, "q") for k, t in enumerate(texts)], "doc_id long, text string, score string")
    same = {"fr": b"the same text for both", "de": b"the same text for both"}
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(rows, same, carry=("score",)).orderBy("doc_id").collect()]
    assert got == [(k, "und" if k < 6 else "de") for k in range(10)]
    assert dict(langid.predict(rows, same, carry=("score",)).dtypes)["score"] == "double"
    assert langid.predict(rows.limit(0), same).count() == 0


def test_langid_defined_results(spark, odd):
    english = {"en": b"the end of the word and the other " * 50, "de": b"das ende von dem wort und das andere " * 50}
    rows = {r["doc_id"]: r for r in langid.predict(odd, english).collect()}
    assert rows[1]["lang_pred"] == rows[2]["lang_pred"] == rows[3]["lang_pred"] == "und" and rows[1]["rejected"]
    assert rows[None]["lang_pred"] in english and not any(r["lang_pred"] == "und" for k, r in rows.items() if k in (4, 5, 6, 7, 8))
    assert {r["lang_pred"] for r in langid.predict(odd, {}).collect()} == {"und"}
    from pyspark.sql import functions as F

    assert langid.learn(odd.limit(0), F.lit(True)) == {}


def test_packing_covers_every_id_once(spark, odd, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    for df in (odd.dropDuplicates(["doc_id"]), docs):
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        ids = {k: np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for k, t in texts.items()}
        rows = packing.pack_documents(df, path, public_tokenizers.PATTERN).collect()
        by_doc, by_sequence = {}, {}
        for r in rows:
            assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
            assert r["doc_tokens"] == len(ids[r["doc_id"]])
            by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
            by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["n_segments"]))
        for parts, whole in ((by_doc, {k: len(v) for k, v in ids.items()}), (by_sequence, None)):
            for k, got in parts.items():
                at = 0
                for start, length, *_ in sorted(got):
                    assert start == at and length > 0
                    at += length
                assert at == whole[k] if whole else at <= 1024 and (at == 1024 or at & (at - 1) == 0)
        assert set(by_doc) == set(ids)
        assert all(len(v) == v[0][2] <= packing.Limits().segments for v in by_sequence.values())
    assert packing.pack_documents(odd.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_packing_ids_are_the_librarys_with_added_tokens():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, mine = Tokenizer.from_file(path), packing.VocabularyIds(path, public_tokenizers.PATTERN)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y <|endof text|>", "plain words 12", "naïve  café\n", "日本 <|endoftext|>"):
        assert mine.ids(text).tolist() == own.encode(text, add_special_tokens=False).ids


def test_packing_places_as_a_plain_dot_product_packer():
    """The same choice written plainly: of what fits whole the greatest dot product, the first on ties."""
    rng = np.random.default_rng(4)
    tokens = rng.integers(1, 40, 60)
    loss = rng.integers(0, tokens + 1)
    limits = packing.Limits(tokens=50, segments=4, loss=30)
    got = list(packing.pack(tokens, np.minimum(loss, 30), limits, cut=False))
    rest = {k: (int(t), 1, int(min(b, 30))) for k, (t, b) in enumerate(zip(tokens, loss, strict=True))}
    caps = (50, 4, 30)
    weight = [sum(d[j] for d in rest.values()) / len(rest) / caps[j] ** 2 for j in range(3)]
    want = []
    while rest:
        free, held = list(caps), []
        while able := [k for k in rest if all(rest[k][j] <= free[j] for j in range(3))]:
            best = max(able, key=lambda k: (round(sum(rest[k][j] * weight[j] * free[j] for j in range(3)), 9), -k))
            held.append((best, 0, rest[best][0]))
            free = [f - d for f, d in zip(free, rest.pop(best), strict=True)]
        want.append(held)
    assert got == want


@pytest.mark.parametrize("cut", [True, False])
def test_packing_keeps_all_limits(cut):
    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 900, 500)
    loss = rng.integers(0, tokens + 1) * (rng.random(500) < 0.8).astype(int)
    loss = np.minimum(loss, 300) if not cut else loss
    limits = packing.Limits(tokens=1024, segments=5, loss=300)
    seen = np.zeros(len(tokens), int)
    sequences = 0
    for held in packing.pack(tokens, loss, limits, cut=cut):
        assert sum(n for _, _, n in held) <= 1024 and len(held) <= 5
        assert sum(max(0, min(a + n, loss[i]) - a) for i, a, n in held) <= 300
        for i, _, n in held:
            seen[i] += n
        sequences += 1
    assert (seen == tokens).all()
    if not cut:
        assert sequences <= 1.25 * max(tokens.sum() / 1024, loss.sum() / 300, len(tokens) / 5)
        with pytest.raises(ValueError):
            list(packing.pack(np.array([2000]), np.array([0]), limits, cut=False))
