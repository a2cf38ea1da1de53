import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabula.llm import packing
from tabula.llm.queries import QUERIES, tokenizer_file
from tabula.llm.scratch import small_batches
from tests.conftest import SF_SMALL


def check_layout(got, capacity=2048):
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        ends = (own.offset + own.length).tolist()
        assert own.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= capacity
    used = got.groupby("sequence_id").length.sum()
    return int(sum(0 if n & (n - 1) == 0 else capacity - n for n in used)), int(used.sum())


def test_cuts_cover_and_fit():
    for n in range(1, 5000):
        cuts = packing.cut_lengths(n)
        assert sum(cuts) == n and min(cuts) > 0 and max(cuts) <= 2048
        assert all(packing.class_of(c) * c > 2048 - 64 or c <= 64 for c in cuts)


def test_word_ids_are_the_tokenizers(documents):
    whole = Tokenizer.from_file(tokenizer_file())
    texts = [r.text for r in documents.limit(80).collect() if r.text]
    rnd = random.Random(3)
    odd = "aZ é ÉÜß'sReΣς <|endoftext|> <|startoftext|>x İ ﬁ ½ 12a á ́     日本語 🙂 _-,. don't I'LL \x00 \x1c \x1d \x1f \x0b \x0c \x85 ​".split(" ")
    texts += ["".join(rnd.choice([*odd, " ", "\n", ", "]) for _ in range(12)) for _ in range(3000)] + ["", " ", "a\x1cb", "x\x85y"]
    ids, counts = packing.WordEncoder(tokenizer_file()).encode(pa.array(texts, pa.large_string()))
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_words_of_a_large_vocabulary_are_encoded_once():
    """The parts' cache once began anew beyond 65,536 of them: each slice encoded most of its words again."""
    encoder = packing.WordEncoder(tokenizer_file())
    letters = np.array(list("abcdefghijklmnopqrst"))
    words = ["".join(letters[[k // 8000, k // 400 % 20, k // 20 % 20, k % 20]]) for k in range(100_000)]
    texts = pa.array([" ".join(words[k : k + 5000]) for k in range(0, len(words), 5000)], pa.large_string())
    first, _ = encoder.encode(texts)
    known = len(encoder.known)
    for k in range(len(texts)):
        encoder.encode(texts.slice(k, 1))
    again, _ = encoder.encode(texts)
    assert known > len(words) and len(encoder.known) == known and (again == first).all()


def test_query_places_every_id_once(spark, documents):
    got = QUERIES["op8_harmonic_packing"](spark, SF_SMALL).toPandas()
    whole = Tokenizer.from_file(tokenizer_file())
    by_doc = {k: v.sort_values("start") for k, v in got.groupby("doc_id")}
    rows = documents.select("doc_id", "text").collect()
    assert len(by_doc) == len(rows)
    for r in rows:
        ids = np.array(whole.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        own = by_doc[r.doc_id]
        ends = (own.start + own.length).tolist()
        assert own.start.tolist() == [0, *ends[:-1]] and ends[-1] == len(ids) == own.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(own.start, ends, strict=True)] == own.ids_crc32.tolist()
    padding, tokens = check_layout(got)
    assert padding < 0.04 * tokens


def test_odd_rows_and_small_capacity(spark):
    rows = [(1, None), (2, ""), (None, "some words"), (3, "a b c d e f g h i j k l m n o p q r s t u v w"), (3, "a b c d e f g h i j k l m n o p q r s t u v w"), (4, "w " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("x")).withColumn("class", F.lit(0))
    got = packing.pack_documents(docs, tokenizer_file, capacity=16, shortest=3, with_ids=True).toPandas()
    assert got.length.sum() == 1 + 1 + 3 + 24 + 24 + 5001
    check_layout(got, 16)
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got.itertuples())
    assert packing.pack_documents(docs.limit(0), tokenizer_file).collect() == []


def test_bound_of_left_over_pieces():
    assert packing.leftover_bound() < 12_000


def test_known_words_take_no_table_of_their_own(monkeypatch):
    """Each slice once built a hash table of all the words seen before: it took more than the words themselves."""
    encoder = packing.WordEncoder(tokenizer_file())
    letters = np.array(list("abcdefghijklmnopqrst"))
    words = ["".join(letters[[k // 8000, k // 400 % 20, k // 20 % 20, k % 20]]) for k in range(100_000)]
    encoder.encode(pa.array([" ".join(words)], pa.large_string()))
    sizes, real = [], packing.pc.index_in
    monkeypatch.setattr(packing.pc, "index_in", lambda values, value_set: sizes.append(len(value_set)) or real(values, value_set=value_set))
    ids, _ = encoder.encode(pa.array(["abcd, tttt dcba x1"], pa.large_string()))
    assert ids.tolist() == Tokenizer.from_file(tokenizer_file()).encode("abcd, tttt dcba x1", add_special_tokens=False).ids
    assert sizes and max(sizes) < 10


def test_workers_get_small_batches(spark):
    text = "some words of a text " * 500
    docs = spark.range(2000, numPartitions=1).selectExpr("id doc_id", f"'{text}' text")
    sizes = "n long, b long"
    run = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "b"]) for b in batches)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with small_batches(spark):
        got = docs.mapInArrow(run, sizes).collect()
    assert sum(r.n for r in got) == 2000 and max(r.b for r in got) < 2 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
