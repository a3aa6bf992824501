"""Mixing, fill-in-middle and the prefix trie against SQL and plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from alnspark.llm import fim, mixing, prefix_trie
from alnspark.llm.common import stored
from tests.llm import fixtures as fx

CASES = {"documents": fx.documents, "null ids": fx.with_null_ids, "empty": list, "no words": lambda: [(1, None, *[None] * 6), (2, " \n", None, "s", *[None] * 4)]}
TURNS = "conv_id long, turn long, role string, text string, c long, digest string"


@pytest.mark.parametrize("case", CASES)
def test_mix_equals_sql(spark, case):
    rows = CASES[case]()
    fx.same(mixing.query(spark, fx.frame(spark, rows)), fx.sql(mixing.SQL, documents=(rows, fx.DOCS)))


def test_mix_of_many_shards_and_copies(spark, monkeypatch):
    """Shards of five units, and equal rows made in lots of four, give what SQL gives; every source comes near its target."""
    monkeypatch.setattr(mixing, "SHARD_ROWS", 5)
    monkeypatch.setattr(mixing, "LEAST_BLOCKS", 20)
    monkeypatch.setattr(mixing, "COPIES", 4)
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), "en", rng.choice(["é", "a", "a", "a", "", "Z", "tiny" if i < 3 else "a", None]), 0, 0, 0.0, "") for i in range(200)]
    rows += [rows[9]] * 30 + [(None, "one two", *[None] * 6)] * 9
    got = mixing.query(spark, fx.frame(spark, rows))
    fx.same(got, fx.sql(mixing.SQL.replace("ceil(units / 1000)", "ceil(units / 5)").replace("/ shards) / 1000)", "/ shards) / 20)"), documents=(rows, fx.DOCS)))
    out = fx.pdf(got)
    assert (out["taken"] <= 3 * out["size"]).all() and len(out) == len(rows)
    near = out.groupby(["target", "source_size"])["taken"].sum().reset_index()
    assert (abs(near["taken"] - near["target"]) <= 0.05 * near["target"] + 1).all()
    assert abs(out["taken"].sum() - out["size"].sum()) <= 0.02 * out["size"].sum()


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1000])
def test_highest_quotients(spark, seats):
    """Against giving seats one by one."""
    rng = random.Random(seats)
    parties = [(g, k, float(rng.choice([0, 1, 5, 5, rng.randint(1, 10**6), rng.randint(1, 10**6)])), rng.choice([0, 3, 10**4]), seats) for g in range(3) for k in range(25)]
    given = {p[:2]: 0 for p in parties}
    for g in range(3):
        for _ in range(seats):
            free = [p for p in parties if p[0] == g and p[2] > 0 and given[p[:2]] < p[3]]
            if not free:
                break
            given[max(free, key=lambda p: (p[2] / (2 * given[p[:2]] + 1), -p[1]))[:2]] += 1
    out = mixing.apportion(stored(spark.createDataFrame(parties, "party long, key long, votes double, most long, seats long"), "parties"))
    assert {(r["party"], r["key"]): r["quota"] for r in out.collect()} == given


def test_mixed_texts_are_what_was_taken(spark):
    rows = fx.documents()
    docs = fx.frame(spark, rows)
    mixed = stored(mixing.mix(docs), "mixed")
    words = mixing.texts(docs, mixed).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()
    assert {r["source"]: r["n"] for r in words} == {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum("taken").alias("n")).where("n > 0").collect()}


def _hard_texts():
    texts = ["a\nb\nc", "\n\n\n", "a <P> b\n c", "<S\n>x\ny", "<\nP>\nq", "x\r\ny\r\n", "line\n" * 40_000 + "é\n中", "no line end", "\n", "𝄞\n" * 50]
    return fx.with_null_ids() + [(900 + i, t, *[None] * 6) for i, t in enumerate(texts)]


@pytest.mark.parametrize("case", ["hard", "empty"])
def test_fill_in_middle_equals_sql(spark, case):
    rows = _hard_texts() if case == "hard" else []
    fx.same(fim.query(spark, fx.frame(spark, rows)), fx.sql(fim.SQL, documents=(rows, fx.DOCS)))


def test_chunks_change_nothing_and_outputs_are_restored(spark):
    docs = fx.frame(spark, _hard_texts())
    whole = fim.transform(docs)
    assert fx.key([r.asDict() for r in whole.collect()]) == fx.key([r.asDict() for r in fim.transform(docs, chunk=3).collect()])
    back = whole.select(F.col("doc_id"), fim.restored().alias("text"))
    assert fx.key([r.asDict() for r in back.collect()]) == fx.key([{"doc_id": r[0], "text": r[1] or ""} for r in _hard_texts()])
    forms = {r["form"]: r["count"] for r in fim.transform(docs, rate=50).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm", "spm"} and forms["plain"] > 20


def test_cut_ranks(spark):
    import numpy as np

    texts = [b"", b"\n", b"a\nbb\n\nc", b"x" * 20, b"\n" * 9]
    size = np.array([len(t) for t in texts])
    end = np.cumsum(size)
    for chunk in (1, 2, 5, 100):
        units = fim.Units(np.frombuffer(b"".join(texts) + b"\0", np.uint8), end - size, end, chunk)
        lines = [re.findall(rb"[^\n]*\n|[^\n]+", t) for t in texts]
        assert units.n.tolist() == [len(x) for x in lines]
        for rank in range(12):
            got = units.cut(np.full(len(texts), rank)) - units.start
            assert got.tolist() == [sum(map(len, x[:rank])) for x in lines]


def _conversations():
    rng, rows = random.Random(3), []
    for c in [*range(130), 205, 206, 207, 300, 301, -7, -100, 1_000_007]:
        for t in range(9 if c % 7 == 0 else rng.choice([0, 1, 2, 3, 7, 40])):
            rows.append((c, t if rng.random() > 0.02 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None]) if c % 3 else f"x{t}", 5, "d"))
    rows += [(None, 1, "user", "t", 5, "d"), (5, 1, "user", "dup", 5, "d"), (5, 1, "user", "dup", 5, "d")]
    return rows + [(c, t, "u", f"long{t}", 5, "d") for c in (400, 410, 420) for t in range(50)]


SMALL = {
    "hard": _conversations, "empty": list, "one": lambda: [(3, t, "u", str(t), 1, "") for t in range(9)], "only turnless": lambda: [(105, 0, "u", "t", 1, "")],
    "copies": lambda: [(c, t, "u", "same", 1, "") for c in range(100, 700, 100) for t in range(20)], "nulls": lambda: [(None, None, None, None, None, None), (1, None, None, None, None, None)],
}


@pytest.mark.parametrize("case", SMALL)
def test_trie_equals_sql(spark, case):
    rows = SMALL[case]()
    fx.same(prefix_trie.query(spark, fx.frame(spark, rows, TURNS)), fx.sql(prefix_trie.SQL, conversations=(rows, TURNS)))


def test_trie_in_pieces(spark, monkeypatch):
    """Rounds of one and two turns, and ids joined three at a time."""
    for name, value in (("FEWEST_TURNS", 1), ("MOST_TURNS", 2), ("PIECE", 3)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = [(c, t, "u", "same" if t < 3 else f"{c % 2}{t}", 1, "") for c in range(100, 1_500, 100) for t in range(5)] + [(205, 0, "u", "x", 1, "")]
    fx.same(prefix_trie.query(spark, fx.frame(spark, rows, TURNS)), fx.sql(prefix_trie.SQL, conversations=(rows, TURNS)))


def test_turns_are_numbered_across_ranges(spark):
    """One conversation with most rows lies in many ranges."""
    rows = [(7, t % 500, "u", f"{t % 3}", 1, "") for t in range(3_000)] + [(c, 0, "u", "x", 1, "") for c in range(40)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = prefix_trie.numbered(prefix_trie.turns(fx.frame(spark, rows, TURNS).repartition(5))).where("c = 7").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert sorted(r["d"] for r in out) == list(range(1, 3_002))
