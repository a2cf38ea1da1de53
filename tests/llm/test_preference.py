import hashlib
import re

from pyspark.sql import functions as F

from tabula.llm import preference as pf
from tabula.llm.queries import QUERIES
from tests.conftest import SF_SMALL


def show(turns):
    return "".join(f"<|im_start|>{(r or 'unknown').replace('<|', '< |')}\n{(t or '').replace('<|', '< |')}<|im_end|>\n" for r, t in turns)


def spans(turns):
    at, out = 0, []
    for r, t in turns:
        whole, head = len(show([(r, t)])), len(f"<|im_start|>{(r or 'unknown').replace('<|', '< |')}\n")
        if r == "assistant":
            out.append((at + head, at + whole))
        at += whole
    return out


def test_pairs_against_brute_force(spark):
    u, a, n = ("user", "hi é"), ("assistant", "yes <|im_end|>"), (None, None)
    pairs = [([u, a], [u, ("assistant", "no")]), ([u, a], [u, a]), ([], [u]), ([u, a, u, a], [u]), ([n, u], [n, a, a]), ([u], [a]), (None, None), ([u] * 300 + [a], [u] * 300)]
    schema = "id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], schema).withColumn("k", F.lit(9)).withColumn("prompt", F.lit("old"))
    for r in pf.format_preferences(df).collect():
        x, y = (p or [] for p in pairs[r.id])
        k = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert (r.prompt, r.prompt_turns, r.chosen, r.rejected) == (show(x[:k]), k, show(x[k:]), show(y[k:]))
        assert [tuple(s) for s in r.chosen_mask] == spans(x[k:]) and [tuple(s) for s in r.rejected_mask] == spans(y[k:])
        assert r.k == 9


def test_conversations_of_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, None, "system", None), (None, 0, "user", "lost"), (2, 0, None, ""), (2, 0, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit(1))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in pf.conversations(turns).collect()}
    assert got == {1: [("system", None), ("user", "a"), ("assistant", "b")], 2: [(None, ""), ("user", "x")]}
    assert pf.format_preferences(pf.with_stale_reply(pf.conversations(turns.limit(0)))).collect() == []


def stale_pair(conv_id, turns):
    """The two conversations by the rule, in plain Python."""
    at = [i for i, (role, _) in enumerate(turns) if role == "assistant"]
    if not at:
        return turns, turns
    k = int(hashlib.md5(str(conv_id).encode()).hexdigest()[:8], 16) % len(at)
    text = turns[at[k]][1]
    stale = turns[at[k - 1]][1] if k else text if text is None else re.match(r"[^.!?]*[.!?]?", text)[0]
    return turns, [(r, stale if i == at[k] else t) for i, (r, t) in enumerate(turns)]


def test_stale_replies_keep_every_turn(spark):
    u, a, b, c = ("user", "hi"), ("assistant", "One. Two."), ("assistant", "Three"), ("assistant", "Four! Five?")
    talks = {k: v for k, v in enumerate([[u, a, u, b, u, c, u], [u, a, u, b, u, c, u], [u, a, u, b, u, c, u], [u, a, u, b, u, c, u], [u], [a], [b], [("assistant", None), a], [(None, "x"), a, ("user", None), a, a], [("system", "s"), u, c, u], []])}
    df = spark.createDataFrame(list(talks.items()), "conv_id long, turns array<struct<role:string,text:string>>").withColumn("at", F.lit(3))
    places = set()
    for r in pf.with_stale_reply(df).collect():
        x, y = stale_pair(r.conv_id, talks[r.conv_id])
        assert [tuple(t) for t in r.chosen] == x and [tuple(t) for t in r.rejected] == y and r.at == 3
        places.update(i for i, (p, q) in enumerate(zip(x, y)) if p != q)
    assert len(places) > 2


def test_query_keeps_all_turns(spark):
    turns = {}
    for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").distinct().collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    got = QUERIES["op10_preference_format"](spark, SF_SMALL).collect()
    trained = set()
    for r in got:
        x, y = stale_pair(r.conv_id, [t[1:] for t in sorted(turns[r.conv_id])])
        k = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), len(x))
        assert (r.prompt, r.prompt_turns, r.chosen, r.rejected) == (show(x[:k]), k, show(x[k:]), show(y[k:]))
        assert [tuple(map(int, m.split(":"))) for m in r.chosen_mask.split(",") if m] == spans(x[k:])
        assert [tuple(map(int, m.split(":"))) for m in r.rejected_mask.split(",") if m] == spans(y[k:])
        trained.add(r.chosen_mask.count(":"))
    assert len(got) == len(turns) and max(trained) > 1


def test_query_masks_cover_replies(spark):
    for r in QUERIES["op10_preference_format"](spark, SF_SMALL).collect():
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            for a, b in (map(int, m.split(":")) for m in mask.split(",") if m):
                assert text[:a].endswith("<|im_start|>assistant\n") and text[a:b].endswith("<|im_end|>\n")
