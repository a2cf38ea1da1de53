import ipaddress
import re

import pytest
from pyspark.sql import functions as F

from tabula.llm import pii
from tabula.llm.queries import QUERIES
from tests.conftest import SF_MID

# the shapes planted in the test documents, stated apart from the operator's patterns
KINDS = {
    "email": r"\w+\.\d\d@mail\d\.example\.com",
    "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}",
    "card": r"(?<!\d)\d{16}(?!\d)",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d.])",
    "secret": r"(?<=\")[0-9a-f]{40}(?=\")",
}
NEW = KINDS | {"email": r"\w+\.\d\d@\w+\.\w+\.example"}


def one(spark, *texts):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return [r.text for r in pii.replace_entities(docs, "key").orderBy("doc_id").collect()]


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op3_surrogates"](spark, SF_MID).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    pairs = {k: {} for k in KINDS}
    for r in rows:
        own = got[r.doc_id]
        for kind, pattern in KINDS.items():
            old, new = re.findall(pattern, r.text or ""), re.findall(NEW[kind], own.text or "")
            assert len(old) == len(new), (r.doc_id, kind)
            for a, b in zip(old, new):
                assert a not in own.text and (kind == "ip" or [c.isdigit() for c in a[:2]] == [c.isdigit() for c in b[:2]])
                assert pairs[kind].setdefault(a, b) == b  # coreference
        if not own.n_entities:
            assert own.text == r.text
    for kind, known in pairs.items():
        assert len(known) > 5 and len(set(known.values())) == len(known), kind  # distinctness
        assert not set(known) & set(known.values())


def test_kinds_formats_and_coreference(spark):
    a, b, c = one(
        spark,
        "Write Ann.Lee7@Mail.example.com, +1 (337) 555-7349 or 337-555-7349; card 4952-9359-0025-3052.",
        "ann.lee7@mail.example.com and 4952935900253052 from 10.20.30.40",
        "Mrs Anna Smith met Mr. Smith; г-жа Иванова; Mr. SMITH; License 2.0, 1.2.3 and 17 of 2024-01-15",
    )
    mail = re.findall(r"\S+@\S+\.example", a)[0]
    assert mail.lower() in b and re.fullmatch(r"[a-z]{3}\.[a-z]{3}\d@[a-z]{4}\.[a-z]{7}\.example", mail.lower())
    first, second = re.search(r"\+1 \((\d{3})\) (\d{3}-\d{4}) or (\d{3}-\d{3}-\d{4});", a).group(1, 2), re.search(r"or (\d{3})-(\d{3}-\d{4});", a).groups()
    assert first == second
    card = re.search(r"card (\d{4}-\d{4}-\d{4}-\d{4})", a).group(1).replace("-", "")
    assert card in b and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(card))) % 10 == 0
    assert "10.20.30.40" not in b and all(0 < int(x) < 256 for x in re.search(r"from ([\d.]+)", b).group(1).split("."))
    m = re.fullmatch(r"Mrs (\w+)na (\w+) met Mr\. (\w+); г-жа ([А-я]+); Mr\. ([A-Z]+); License 2\.0, 1\.2\.3 and 17 of 2024-01-15", c)
    assert m and m[2] == m[3] == m[5].title() and m[2] != "Smith"


PHONES = {
    "fr": ["01 23 45 67 89", "01.23.45.67.89", "+33 6 12 34 56 78", "0033 6 12 34 56 78", "+33 (0)1 23 45 67 89", "0612345678"],
    "de": ["+49 (0)30 1234567", "+49 30 1234567", "(030) 12 34 56 78", "030/1234567", "030 / 123 45 67", "0151 23456789"],
    "es": ["+34 612 34 56 78", "612 34 56 78", "612 345 678", "+34612345678"],
    "en": ["+14155552671", "4155552671", "+1 (415) 555-2671", "415-555-2671", "+44 20 7946 0958"],
}
IP6 = ["2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80::1ff:fe23:4567:890a", "::1", "2001:DB8::42"]


def test_numbers_of_all_languages(spark):
    every = [(e, "phone") for group in PHONES.values() for e in group] + [(e, "ip6") for e in IP6]
    got = one(spark, *[f"x {e}, y" for e, _ in every])
    for (old, kind), text in zip(every, got):
        new = text[2:-3]
        assert text.startswith("x ") and text.endswith(", y") and new != old
        if kind == "ip6":
            assert ipaddress.IPv6Address(new) != ipaddress.IPv6Address(old)
        else:  # the format stays, and the last digits are not those of the original
            assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", old) and re.sub(r"\D", "", new)[-7:] != re.sub(r"\D", "", old)[-7:], old
    assert len(set(got)) == len(got)


def test_a_number_ends_where_the_next_one_starts(spark):
    (text,) = one(spark, "+1 (337) 555-7349 4952935900253052 on 01.02.2024 10:30, std::x, a :: b, 12:30:45")
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} \d{16} on 01\.02\.2024 10:30, std::x, a :: b, 12:30:45", text)
    assert "555-7349" not in text and "4952935900253052" not in text


def test_collisions_are_drawn_again(spark, monkeypatch):
    monkeypatch.setattr(pii, "_run", lambda seed, n, first="": F.concat(F.lit("555555555"), pii._draw(seed, F.lit(1), 10).cast("string")))
    texts = [f"call 200-300-400{k}" for k in range(8)] + ["call 555-555-5550"]
    got = one(spark, *texts)
    assert len(set(got)) == len(got) and "call 555-555-5550" not in got


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a@b.example.org", 5), (2, "x" * 100_000 + " 10.0.0.1", 5), (2, "x" * 100_000 + " 10.0.0.1", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").withColumn("h", F.lit("h")).withColumn("news", F.lit(1)).withColumn("found", F.lit(2))
    got = pii.replace_entities(docs, "key")
    assert got.columns == [*docs.columns, "n_entities"]
    assert sorted(r.n_entities for r in got.collect()) == [0, 0, 1, 1, 1]
    assert pii.replace_entities(docs.limit(0), "key").collect() == []
    assert len({r.text for r in got.collect() if r.doc_id == 2 and r.text}) == 1


@pytest.mark.parametrize("text", ["version 3.", "Apache License, Version 2.0.", "in 1999 and 2001", "DR. no", "Mr", "abcdef0123"])
def test_left_alone(spark, text):
    assert one(spark, text) == [text]
