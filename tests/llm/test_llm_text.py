"""The tokenizer against two other readers of the vocabulary, and spam pages against a labelled made-up crawl."""

import base64

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from brocade.llm import queries_text
from brocade.llm.spam import FEATURES, SIGNALS, describe, smooth_by_host, spam_pages
from brocade.llm.tokenizer import PATTERN, VOCABULARY, Encoder, decoded, encode_corpus, read_file, read_ranks, token_count, token_ids

TEXTS = [
    "Nhà mặt tiền 5 tầng, giá 7,2 tỷ!", "  hai  khoảng trống \n\n\t x", "it's we'll I'd", "🔥👨‍👩‍👧 mixed ñ 中文 한국어", "<|endoftext|> is text", "a" * 3000, " ​﻿",
    "é ơ", "1234567890 12,5", "\r\n\r\n", "�", "x" + " " * 500 + "y", "Đ" * 700, "\x00\x01",
]


@pytest.fixture(scope="module")
def other():
    import tiktoken

    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_agree_and_round_trip(other):
    e = Encoder(read_file(VOCABULARY))
    for text in TEXTS:
        ids = e.encode(text)
        assert ids == other.encode_ordinary(text), text[:20]
        assert e.decode(ids) == text
    assert e.encode("") == e.encode(None) == []


def test_ids_agree_with_the_json_vocabulary():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    e = Encoder(read_file(VOCABULARY))
    assert [e.encode(x) for x in TEXTS] == [r.ids for r in t.encode_batch(TEXTS, add_special_tokens=False)]


def test_every_token_is_itself():
    e = Encoder(read_file(VOCABULARY))
    whole = [i for i, t in enumerate(e.tokens) if e.model.encode(["".join(e.spell[b] for b in t)])[0] == [i]]
    assert len(whole) > 0.95 * len(e.tokens)  # some tokens can't be reached by merges, in any reader
    assert len(e.tokens) == 50_256


def test_columns(spark, other):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None, "", " "])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").where("instr(text, '\\0') = 0 or text is null")
    got = encode_corpus(df, "doc_id", "text")
    assert got.columns == ["doc_id", "ids"]
    for r in got.collect():
        assert list(r.ids) == (other.encode_ordinary(rows[r.doc_id][1]) if rows[r.doc_id][1] else [])
    both = df.select("text", token_ids(F.col("text")).alias("i"), token_count(F.col("text")).alias("n")).withColumn("back", decoded(F.col("i")))
    assert both.where(F.size("i") != F.col("n")).count() == 0
    assert both.where(F.coalesce("text", F.lit("")) != F.col("back")).count() == 0
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_gaps_are_refused():
    assert read_ranks(b"Yg== 1\n\nYQ== 0\n") == [b"a", b"b"]
    with pytest.raises(ValueError, match="gaps"):
        read_ranks(b"YQ== 0\nYg== 2\n")


def test_query_covers_every_document(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = queries_text.p7_ids(spark, DATA)
    assert got.count() == docs.count() and got.where("ids is null").count() == 0


PROSE = [
    "Hẻm trước nhà rộng khoảng {0} mét nên xe tải nhỏ vào được.", "Bạn nên hỏi kỹ về quy hoạch trước khi đặt cọc, vì đoạn gần chợ sắp mở đường.", "Thợ đã chống thấm lại ban công hồi tháng {0}.",
    "Usable space is {0} square metres, slightly wider at the rear.", "The owner says the papers were settled in {0} and a notary can close within a week.",
    "Tôi đã xem căn này {0} lần và thấy sân trước thoáng mát hơn trong ảnh.",
]
PLACES = "Lam Sa Quế Mận Ổi Ngà Tràm Vĩ Sen Dừa Cúc Trúc".split()


def crawl():
    import random

    rng, rows = random.Random(3), []
    two = lambda: f"{rng.choice(PLACES)} {rng.choice(PLACES)}"
    for i in range(600):
        prose = " ".join(rng.choice(PROSE).format(rng.randrange(2, 60)) for _ in range(rng.randrange(3, 9)))
        spam = [
            ", ".join(f"bán nhà giá rẻ {two()}" for _ in range(40)), "\n".join(f"http://x{rng.randrange(9)}.example/{rng.randrange(10**5)}" for _ in range(30)),
            " ".join(f"#nha{rng.choice(PLACES)}{rng.randrange(9)}" for _ in range(40)), " | ".join(f"Nhà mới xây {two()} ({rng.randrange(900)})" for _ in range(40)),
            "\n".join(f"[căn hộ {two()}](http://a.example/{rng.randrange(999)})" for _ in range(25)),
        ][i % 5]
        kind = i % 4
        text = [prose, f"{prose}\nTags: nhà phố, đất nền, biệt thự", spam, f"{rng.choice(PROSE).format(3)}\n{spam}"][kind]
        rows.append((i, text, f"h{i % 7}.example", kind >= 2))
    return rows


def test_spam(spark):
    rows = crawl()
    odd = [(10_000, None, "h", False), (10_001, "", "h", False), (10_002, "  \n", None, False), (10_003, " ".join(PROSE[:3]), None, False), (10_004, rows[2][1] * 200, None, True)]
    df = spark.createDataFrame([*rows, *odd, rows[0]], "doc_id long, text string, site string, spam boolean")
    got = spam_pages(df.withColumnRenamed("spam", "score"), "doc_id", "text", "site")
    found = {r.doc_id for r in got.where("spam").collect()}
    wanted = {r[0] for r in [*rows, *odd] if r[3]}
    assert len(found & wanted) >= 0.97 * len(wanted) and len(found - wanted) <= 0.03 * len(wanted)
    assert not found & {10_000, 10_001, 10_002, 10_003}
    assert got.select("doc_id").distinct().count() == len(rows) + len(odd)  # every document is scored
    open_ = got.where("weak is null").count()
    assert 0 < open_ < got.count()


def test_spam_of_one_side_or_nothing(spark):
    prose = spark.createDataFrame([(i, PROSE[i % 6].format(i), "h") for i in range(30)], "doc_id long, text string, site string")
    assert spam_pages(prose, "doc_id", "text", "site").where("spam").count() == 0
    assert spam_pages(prose.limit(0), "doc_id", "text", "site").count() == 0


def test_features_have_names():
    for text in (None, "", "x", "a b c " * 50_000, PROSE[0]):
        assert len(describe(text)) == len(FEATURES) + len(SIGNALS)


def test_accents_and_forms_change_nothing():
    import unicodedata

    text = "Chuyên nhà mới xây, giá tốt: xem a.example/12 | #nhapho.\nỞ đây tám năm, tôi chưa thấy mất cắp lần nào."
    assert describe(text) == describe(unicodedata.normalize("NFD", text)) == describe(text.upper())


def test_smoothing_changes_verdicts(spark):
    rows = [(i, "bad.example" if i % 2 else "good.example", 0.95 if i % 2 else 0.05, True) for i in range(400)]
    rows += [(1000, "bad.example", 0.4, True), (1001, "good.example", 0.6, True), (1002, None, 0.6, True), (1003, "bad.example", 0.9, False), (1004, "new.example", 0.4, True)]
    got = {r.key: r.score for r in smooth_by_host(spark.createDataFrame(rows, "key long, host string, page_score double, says boolean")).collect()}
    assert got[1000] > 0.5 > got[1001] and abs(got[1002] - 0.6) < 1e-9 and got[1003] == 0.0 and abs(got[1004] - 0.4) < 0.05
