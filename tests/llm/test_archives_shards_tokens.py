import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arrayq.llm import packing, pieces, sharding, warc
from tests.llm.corpus import documents, frame, prose

# --- WARC


def pages():
    rng = random.Random(1)
    big, small = "<p>" + "ö" * 600 + "</p>", "<p>tiny</p>"
    rows = [(i, f"http://h/{i}", big if i % 3 == 0 else small if i % 3 == 1 else prose(rng, "de", 300), "clash", 1) for i in range(30)]
    rows += [(40, None, None, "clash", 1), (41, "http://h/\r\nX: y", "", "clash", 1), (42, "u", "x" * 3_000_000, "clash", 1), (43, "u", "WARC/1.1\r\n\r\n\r\n\r\n", "clash", 1)]
    rows += [(-7, "http://h/50%25%0A?\n%", "below zero", "clash", 1), (-8, "http://h/50%25%0A?", big, "clash", 1)]
    return rows


def test_warc_round_trip_against_brute_force(spark):
    rows = pages()
    got = {r.page_id: r for r in warc.archive_and_read(spark.createDataFrame(rows, "page_id long, url string, html string, record_type string, offset int")).collect()}
    heads = defaultdict(int)
    for i, _, html, *_ in rows:
        heads[(html or "").encode()] = max(heads[(html or "").encode()], i)
    assert len(got) == len(rows)
    for i, url, html, *_ in rows:
        body = (html or "").encode()
        head = heads[body] if len(body) >= 1000 else i
        assert got[i].url == (url if url is not None else "about:blank")
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if head == i else ("revisit", head))


def test_warc_index_selects_ranges_and_payloads_are_exact(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "id long, url string, payload string, a string, b int")
    index = warc.write_warc(df)
    assert index.count() == len(rows)
    body = {i: (html or "").encode() for i, _, html, *_ in rows}
    back = warc.read_warc(index.where("abs(record_id) % 2 = 1")).collect()
    assert len(back) == sum(i % 2 for i in body)
    assert all(bytes(r.payload) == (body[r.record_id] if r.record_type == "response" else b"") for r in back)


def test_warc_null_ids_and_repeated_rows(spark):
    body = "same " * 300
    rows = [(None, "a", body), (None, "a", body), (5, "b", body), (5, "b", body), (3, None, body), (None, None, None)]
    got = warc.archive_and_read(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    kinds = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert kinds == {(5, "response", None, 1500): 2, (3, "revisit", 5, 1500): 1, (None, "response", None, 0): 1, (None, "response", None, 1500): 2}


def test_warc_empty_table_and_damage(spark):
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    member = warc.build_record(1, "u", b"body", "0" * 40, None)
    assert warc.parse_record(member).payload == b"body" and warc.parse_record(member).record_id == 1
    for bad in (member[:-9], b"xx" + member, zlib.compress(b"no record")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_ranges_are_coalesced():
    reads = warc.coalesced([(0, 10), (10, 5), (20, 5), (10_000, 1)], max_gap=8, max_read=1000)
    assert reads == [(0, 25, 0, 3), (10_000, 10_001, 3, 4)]
    assert len(warc.coalesced([(0, 600), (600, 600)], max_gap=8, max_read=1000)) == 2


# --- sharding


def test_shards_are_even_gapless_and_repeatable(spark):
    rows = documents()
    got = sharding.shard_documents(frame(spark)).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    again = sharding.shard_documents(frame(spark).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_order_is_uniform_and_seeded(spark):
    rows = spark.range(4000).withColumnRenamed("id", "k")
    place = lambda seed, buckets: [r[0] for r in sharding.external_shuffle(rows, ["k"], 8, seed, buckets).selectExpr("slot * 8 + shard as p", "row.k as k").orderBy("k").select("p").collect()]
    p = place(1, 5)
    assert sorted(p) == list(range(4000)) and p == place(1, 5) and p != place(2, 5)
    assert abs(np.corrcoef(range(4000), p)[0, 1]) < 0.06
    halves = sum((a < 2000) == (k < 2000) for k, a in enumerate(p))
    assert 1800 < halves < 2200


def test_written_shards_hold_all_rows_in_slot_order(spark, tmp_path):
    docs = frame(spark).withColumn("slot", F.lit("own"))
    sharding.write_shards(docs, ["doc_id"], str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(map(repr, back.select("row.*").collect())) == Counter(map(repr, docs.collect())) and back.select("shard").distinct().count() == 4
    assert sharding.shard_documents(frame(spark, []).limit(0)).count() == 0


def test_documents_are_sharded_whole(spark):
    docs = frame(spark)
    got = sharding.shard_documents(docs, 4)
    held = spark.read.parquet(got.written_at).select("row.*", F.col("shard").alias("own_shard"), "slot")
    assert Counter(map(repr, held.drop("own_shard", "slot").collect())) == Counter(map(repr, docs.collect()))
    places = Counter((r.doc_id, len((r.text or "").encode()) + 1, r.own_shard, r.slot) for r in held.collect())
    assert places == Counter((r.doc_id, r["size"], r.shard, r.slot) for r in got.collect())
    long = docs.withColumn("text", F.repeat(F.lit("x"), 1 << 20))
    assert docs.count() << 20 <= sharding.measured_bytes(long) < docs.count() << 21


# --- packing


def check_plan(counts, capacity):
    runs = packing.plan(counts, capacity)
    got, cells = np.zeros(capacity + 1, int), defaultdict(list)
    for length, a, b, first, offset in runs:
        got[length] += b - a
        for k in range(b - a):
            cells[first + k].append((offset, length))
    assert np.array_equal(got, counts)
    for own in cells.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *(n for _, n in own)])[:-1]) and sum(n for _, n in own) <= capacity
    return len(cells)


def test_plans_are_whole_and_near_the_bound():
    rng = np.random.default_rng(3)
    for capacity, n in ((16, 0), (16, 1), (16, 200), (64, 3000), (256, 20000)):
        lengths = np.clip(rng.lognormal(np.log(capacity / 6), 0.9, n).astype(int), 1, capacity)
        counts = np.bincount(lengths, minlength=capacity + 1)
        used = check_plan(counts, capacity)
        assert used <= -(-int((counts * np.arange(capacity + 1)).sum()) // capacity) * 1.02 + 1


def test_exact_complements_fill_sequences():
    counts = np.zeros(101, int)
    counts[[60, 40, 50, 30, 20, 25]] = [5, 5, 4, 4, 4, 8]
    assert check_plan(counts, 100) == 5 + 4 + 2  # 60+40, 50+30+20, 25*4
    counts = np.zeros(101, int)
    counts[[70, 10, 15, 5]] = [3, 3, 3, 3]
    assert check_plan(counts, 100) == 3  # a triple fills the gap


def test_packing_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    rows = documents()
    got = packing.pack(frame(spark)).collect()
    want = Counter()
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[r[0], k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    cells = defaultdict(list)
    for r in got:
        cells[r.sequence_id].append((r.offset, r.length))
    for own in cells.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *(n for _, n in own)])[:-1]) and sum(n for _, n in own) <= 4096
    assert len(cells) <= -(-sum(r.length for r in got) // 4096) + 1
    assert packing.pack(frame(spark, []).limit(0)).count() == 0


def test_word_ids_against_the_tokenizer():
    encoder = packing.WordEncoder(packing.tokenizer_path(), most=300)
    parts = ["a", "The", "don't", "x's,", "1", "23.5%", "é", "é", "É.", "größe!", "日本", "😀", "≠", "<", "|", "'", "’", "--", " ", "\u0085", "\x00", " ", "\t\x0b", "\n", "K", "Σς", "½", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|endoftext", "|>"]
    rng = random.Random(5)
    texts = ["", " ", "\u00a0", "<|ENDOFTEXT|>", "a<|endoftext|>", "b", "<|endof", "text|>"] + ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(1500)]
    for some in (texts[1:3], texts):
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in some]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in some])] == want
    assert encoder.plain and encoder.encode([]) == []


def test_signs_make_no_new_words():
    encoder = packing.WordEncoder(packing.tokenizer_path())
    encoder.encode([b"alpha-beta, (gamma) it's delta"])
    before = set(encoder.cache)
    encoder.encode([b"beta-alpha (delta) gamma/beta, alpha/gamma-delta Delta,alpha"])
    assert set(encoder.cache) - before == {b"/"}


# --- SentencePiece

ODD = ["", " ", "  a  b\n\tc ", "aaaa" * 50, "日本語 text", "\n\n\n", "é́ ñ 😀😀", "x" * 5000, "<s> </s> <unk> <0x0A>", "a\x00b", "tab\t\ttab   end   ", " lead", "\r\n\r\n  x", "Don't stop; it's 3.14%!"]


def test_encoding_equals_the_library():
    from sentencepiece import SentencePieceProcessor

    codec, library = pieces.load(pieces.model_path()), SentencePieceProcessor(model_file=pieces.model_path())
    texts = ODD + [r[1] or "" for r in documents()]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == library.encode(text)
        if pieces.SPACE not in text:
            assert codec.decode(ids) == text
    rng = random.Random(9)
    noise = ["".join(rng.choice("abcde  ▁\nthe.é日") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    assert [np.frombuffer(i, "<i4").tolist() for i in codec.encode(noise)] == library.encode(noise)


def test_small_vocabularies():
    base = [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]
    codec = pieces.Codec([*base, *((p, -float(k), "piece") for k, p in enumerate(["ab", "bc", "abc", "a", "b", "c", "▁"]))])
    # 'ab' merges before 'bc', so 'bc' is never seen after 'a'; 'abcbc' shows both
    assert [codec.names[i] for i in np.frombuffer(codec.encode(["abcbc"])[0], "<i4")] == codec.merged("▁abcbc")
    with pytest.raises(ValueError):
        pieces.Codec([*base, ("a▁b", 0.0, "piece")])
    with pytest.raises(ValueError):
        pieces.Codec([*base, ("ab", 0.0, "piece")])


def test_encoded_documents(spark):
    rows = documents()
    encoded = pieces.encode_documents(frame(spark))
    got = encoded.collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(r.n_ids == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<i4").tobytes()) for r in got)
    texts = defaultdict(set)
    for r in rows:
        texts[r[0]].add((r[1] or "").replace(pieces.SPACE, " "))
    assert all(r.text in texts[r.doc_id] for r in pieces.decode_documents(encoded).collect())
    assert {r.doc_id for r in got if not r.round_trip} == {122}
    assert pieces.encode_documents(frame(spark, []).limit(0)).count() == 0


# --- the pipeline


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    rng = random.Random(3)
    good = [(i, prose(rng, lang, rng.randint(80, 160)), lang, f"s{i % 4}", 1) for i in range(160) for lang in [rng.choice(["en", "de"])]]
    near = [(300 + k, good[k][1].replace("\n", "\n", 1) + f"\nlast{k}", good[k][2], "s1", 1) for k in range(10)]
    rows = good + near + [(200 + k, good[k][1], good[k][2], "s9", 1) for k in range(20)] + [(400, None, None, None, None), (401, "too short", "en", "s", 1), (402, "12 " * 100, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns, docs = docs.columns, stage(spark, docs, "")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        counts.append(docs.count())
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "exact_dedup", "near_dedup", "best_fit_packing"]
    assert counts == [190, 190, 170, 160, counts[-1]] and {r.doc_id for r in docs.collect()} == set(range(160))
