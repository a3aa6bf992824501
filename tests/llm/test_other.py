import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from alnspark.llm import ann, decontaminate, packing, resharding, toxicity, warc
from alnspark.llm.common import shared_path
from tests.llm import fixtures as fx

ITEMS, PAGES = "item_id long, text string", "page_id long, url string, html string"


@pytest.mark.parametrize("rows", [fx.documents(), fx.with_null_ids(), []])
@pytest.mark.parametrize("items", [fx.benchmark(), []])
def test_winnowing_equals_sql(spark, rows, items):
    out = decontaminate.query(spark, fx.frame(spark, rows), fx.frame(spark, items, ITEMS))
    fx.same(out, fx.sql(decontaminate.SQL, documents=(rows, fx.DOCS), benchmark=(items, ITEMS)))


def test_decontamination_words_that_collide_under_polynomials(spark):
    rows = fx.colliding()
    one, other = ("".join(x) for x in fx.thue_morse(4096, "x", "y"))
    rows += [(90, one, *[None] * 6), (91, f"a b c {one} d e f g h i j k", *[None] * 6)]
    items = [(1, other), (2, rows[0][1]), (3, f"a b c {other} d e f g h"), (4, " ".join(rows[5][1].split()[600:640]))]
    fx.same(decontaminate.query(spark, fx.frame(spark, rows), fx.frame(spark, items, ITEMS)), fx.sql(decontaminate.SQL, documents=(rows, fx.DOCS), benchmark=(items, ITEMS)))



def test_winnowing_cleans(spark):
    docs = fx.frame(spark, fx.with_null_ids())
    kept = decontaminate.clean(docs, fx.frame(spark, fx.benchmark(), ITEMS))
    assert kept.columns == docs.columns
    bad = {r["doc_id"] for r in decontaminate.query(spark, docs, fx.frame(spark, fx.benchmark(), ITEMS)).where("contaminated").collect()}
    assert ({r["doc_id"] for r in kept.collect()} - {None}) & bad == set()


def _pages():
    big, crlf = "<p>" + "x" * 200, "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "é" * 90
    return [(5, "http://a/5", big), (2, "http://a/2\r\nX: y", big), (9, None, big), (9, None, big), (2**60 + 1, "u", crlf), (2**60 + 3, "u", crlf), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", big), (None, "v", None)]


@pytest.mark.parametrize("few", [1_000_000, -1])
@pytest.mark.parametrize("rows", [_pages(), []])
def test_warc_equals_sql(spark, monkeypatch, rows, few):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", few)
    fx.same(warc.query(spark, fx.frame(spark, rows, PAGES)), fx.sql(warc.SQL, pages=(rows, PAGES)))


def test_warc_round_trip(spark, monkeypatch):
    rng = random.Random(2)
    breaks = [(100 + i, "u", "".join(rng.choice(["\r", "\n", "\r\n", "a", "WARC/1.1"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows = _pages() + breaks + [(1000, "long", "é\r\n\r\n" * 500_000), (1001, "u", "x\r\n")]
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    path = shared_path(spark, "t")
    warc.write(warc.resolve(fx.frame(spark, rows, PAGES)), path)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows)
    assert {(r["page_id"], r["payload"]) for r in got if r["record_type"] == "response"} <= {(p, h or "") for p, _, h in rows}
    assert {r["page_id"] for r in got} == {p for p, *_ in rows} and max(r["payload_bytes"] for r in got) == 3_000_000


def test_archives_are_ordinary(spark, monkeypatch, tmp_path):
    """A gzip member a record, read without Spark: headers, lengths and payloads fit; files begin with warcinfo and are cut by size."""
    monkeypatch.setattr(warc, "FILE_BYTES", 2_000)
    rows = _pages() + [(500 + i, f"http://b/{i}", f"<html>{i} " + "é" * (i * 7) + "\r\n\r\n</html>") for i in range(60)]
    warc.write(warc.resolve(fx.frame(spark, rows, PAGES).repartition(2)), f"file:{tmp_path}/warc")
    files = sorted((tmp_path / "warc").iterdir())
    assert len(files) > 4 and all(f.name.endswith(".warc.gz") and f.name.startswith("part-") for f in files)
    pages, ids = [], set()
    for file in files:
        data, kinds = file.read_bytes(), []
        while data:
            one = zlib.decompressobj(31)
            record = one.decompress(data)
            assert one.eof
            data = one.unused_data
            head, block = record.split(b"\r\n\r\n", 1)
            lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            assert lines[0] == "WARC/1.1" and block[int(fields["Content-Length"]) :] == b"\r\n\r\n"
            assert fields["WARC-Record-ID"].startswith("<urn:uuid:") and {"WARC-Date", "Content-Type"} <= set(fields)
            kinds.append(fields["WARC-Type"])
            if kinds[-1] == "response":
                pages.append(block[: int(fields["Content-Length"])].split(b"\r\n\r\n", 1)[1].decode())
            if kinds[-1] == "revisit":
                assert fields["WARC-Refers-To"].startswith("<urn:uuid:") and fields["WARC-Profile"] == warc.PROFILE
            ids.add(fields["WARC-Record-ID"])
        assert kinds[0] == "warcinfo" and set(kinds[1:]) <= {"response", "revisit"}
    assert set(pages) == {h or "" for _, _, h in rows}
    assert len(warc.read(spark, f"file:{tmp_path}/warc").collect()) == len(rows)


def _check_rows_law(out, n):
    shards = fx.pdf(out)
    counts = shards.groupby("shard").size().reindex(range(resharding.SHARDS), fill_value=0)
    assert len(shards) == n and counts.max() - counts.min() <= 1
    for _, g in shards.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    return shards


@pytest.mark.parametrize("rows", [fx.documents(), fx.with_null_ids()])
def test_resharding_law(spark, rows):
    got = _check_rows_law(resharding.query(spark, fx.frame(spark, rows)), len(rows))
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    assert sorted(zip(got["size"], got["text_crc32"])) == want


def test_resharding_empty(spark):
    assert resharding.query(spark, fx.frame(spark, [])).count() == 0


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(3)
    for _ in range(40):
        shards = rng.randint(1, 3)
        blocks = [(o, c, rng.randint(1, 3), 0) for o in range(rng.randint(1, 4)) for c in range(rng.randint(1, 2))]
        blocks = [(o, c, n, n * rng.randint(1, 20)) for o, c, n, _ in blocks]
        moved = sum((hi - lo) * max(1, size // n) for o, c, n, size in blocks for a, b, t, lo, hi in resharding.plan(blocks, shards) if (a, b) == (o, c) and t != o)
        units = [(o, max(1, s // n)) for o, c, n, s in blocks for _ in range(n)]
        if len(units) > 8:
            continue
        best = None
        for to in itertools.product(range(shards), repeat=len(units)):
            counts = [to.count(s) for s in range(shards)]
            if max(counts) - min(counts) <= 1:
                cost = sum(w for (o, w), t in zip(units, to) if t != o)
                best = cost if best is None else min(best, cost)
        assert moved == best


def _fewest_bytes(rows, shards):
    best = None
    for to in itertools.product(range(shards), repeat=len(rows)):
        counts = [to.count(s) for s in range(shards)]
        if max(counts) - min(counts) <= 1:
            cost = sum(size for (old, size), t in zip(rows, to) if t != old)
            best = cost if best is None else min(best, cost)
    return best


def test_resharding_moves_the_fewest_bytes(spark):
    rng = random.Random(4)
    cases = [([(0, 300), (0, 300), (0, 7), (0, 7), (0, 300), (1, 70_000)], 3), ([(0, 126)] * 3 + [(0, 100)] * 3, 2), ([(0, 0), (0, 1), (0, 2)], 2)]
    cases += [([(rng.choice([0, 0, 0, 1, 4]), rng.choice([5, 5, 260, rng.randint(0, 100_000)])) for _ in range(rng.randint(3, 7))], rng.randint(1, 3)) for _ in range(5)]
    for rows, shards in cases:
        df = spark.createDataFrame([(i, o, n, 1, "x") for i, (o, n) in enumerate(rows)], "doc_id long, old int, size long, _rank int, block string")
        out = resharding.reshard(df, "old", "size", ["doc_id"], shards)
        assert out.columns == [*df.columns, "shard"]
        got = out.collect()
        counts = [sum(r["shard"] == s for r in got) for s in range(shards)]
        assert len(got) == len(rows) and max(counts) - min(counts) <= 1
        assert sum(r["size"] for r in got if r["old"] != r["shard"]) == _fewest_bytes(rows, shards), rows


def test_rewrite_touches_changed_shards_only(spark):
    rows = spark.createDataFrame([(i, 0 if i < 6 else 1 if i < 12 else 2, 10) for i in range(19)], "doc_id long, old int, size long")
    placed = resharding.reshard(rows, "old", "size", ["doc_id"], 3)
    path = shared_path(spark, "t")
    changed = resharding.rewrite(rows.select("doc_id", F.lit("x").alias("text")), placed, ["doc_id"], path)
    assert changed == []  # 6, 6 and 7 rows are even already
    placed = resharding.reshard(rows, "old", "size", ["doc_id"], 4)
    changed = resharding.rewrite(rows.select("doc_id", F.lit("x").alias("text")), placed, ["doc_id"], path)
    back = spark.read.parquet(path)
    assert back.count() == placed.where(F.col("shard").isin(changed)).count()


def test_rewrite_keeps_columns_of_any_name(spark):
    path = shared_path(spark, "shards")
    docs = spark.createDataFrame([(5, 77, "a"), (5, 78, "b"), (5, 79, "c"), (6, 80, "d")], "doc_id long, _nth int, text string")
    places = spark.createDataFrame([(5, 0, 1), (5, 0, 0), (5, 0, 1), (6, 0, 0)], "doc_id long, old int, shard int")
    resharding.rewrite(docs, places, ["doc_id"], path)
    back = spark.read.parquet(path).select("doc_id", "_nth", "text")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, docs.collect()))


def test_wide_vectors_make_more_shards():
    assert ann.shards_of(262_144, 64) == 64 and ann.shards_of(100 * 262_144, 64) == 100
    assert all(-(-n // ann.shards_of(n, dim)) * dim * 8 <= ann.MOST_BYTES * 1.01 for n in (10**6, 10**9) for dim in (64, 1024, 4096))
    assert ann.shards_of(0, 0) == 1


def test_rewrite_keeps_rows_and_other_shards(spark):
    # shard 0 stays as it is, shard 1 loses all rows to shard 2, shard 3 has the only copies of two ids
    rows = [(None, "a", 1, 2), (None, "a", 1, 2), (None, "b", 1, 2), (5, "c", 1, 2), (5, "d", 1, 2), (6, "e", 2, 2), (7, "f", 0, 0), (8, "g", 0, 0), (9, "h", 3, 2), (9, "i", 3, 3)]
    placed = spark.createDataFrame(rows, "doc_id long, text string, old int, shard int")
    path = shared_path(spark, "t")
    placed.select("doc_id", "text", F.col("old").alias("shard")).write.partitionBy("shard").parquet(path)
    files = lambda shard: sorted(f for f in spark.read.parquet(path).where(F.col("shard") == shard).inputFiles() if f"shard={shard}/" in f)
    before = files(0)
    docs = spark.read.parquet(path).select("doc_id", "text")
    assert resharding.rewrite(docs, placed.drop("text"), ["doc_id"], path) == [1, 2, 3]
    back = [tuple(r) for r in spark.read.parquet(path).select("doc_id", "text", "shard").collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted([r[:2] for r in back], key=key) == sorted([r[:2] for r in rows], key=key)
    assert sorted([r[::2] for r in back], key=key) == sorted([(r[0], r[3]) for r in rows], key=key)
    assert files(0) == before and not files(1)
    # an id with different texts in a changed and an unchanged shard: neither is lost or doubled
    rows = [(1, "a", 0, 0), (1, "b", 1, 2), (2, "c", 2, 2)]
    placed, path = spark.createDataFrame(rows, "doc_id long, text string, old int, shard int"), shared_path(spark, "t")
    placed.select("doc_id", "text", F.col("old").alias("shard")).write.partitionBy("shard").parquet(path)
    assert resharding.rewrite(spark.read.parquet(path).select("doc_id", "text"), placed.drop("text"), ["doc_id"], path) == [0, 1, 2]
    assert sorted(r["text"] for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("rows", [fx.documents(), fx.with_null_ids(), []])
def test_packing_is_whole(spark, rows):
    out = fx.pdf(packing.query(spark, fx.frame(spark, rows)))
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for did, text, *_ in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(min(first, len(ids)), len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((str(did), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    if not rows:
        assert not len(out)
        return
    ids = ["None" if np.isnan(d) else str(int(d)) for d in out["doc_id"].astype(float)]
    assert sorted(zip(ids, out["piece"], out["start"], out["length"], out["ids_crc32"])) == sorted(want)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 2048
    assert out["sequence_id"].nunique() <= -(-out["length"].sum() // 2048) + 1


def test_encoder_equals_the_tokenizer(spark):
    vocabulary, ranks = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))
    tok, own = Tokenizer.from_file(vocabulary), packing.Encoder(vocabulary, ranks)
    rng = random.Random(4)
    alphabet = "ab  \n\t'sll09é ß²½ª·中 \u200b\u0085\xa0\u3000\x1c\x00“”—€!?.,_<|endoftext|>😀ŒŽ"
    letters = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 24))) for _ in range(3000)]
    ranges = [(0, 0x2FF), (0, 0xD7FF), (0xE000, 0x10FFFF)]
    anything = ["".join(chr(rng.randint(*rng.choice(ranges))) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    special = ["<|endoftext|>", "a<|endoftext|> b", "I'll  we've\r\n\r\n  x", " " * 70_000, "\n" * 70_000 + "a", " " * (packing.MOST_SPACE - 1) + "a", "x" * 50_000, "a   " * 20_000]
    real = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text in [*letters, *anything, *special, *real]:
        assert own(text).tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text[:80])


def test_best_two_fit_replaces_the_smallest():
    # 6 + 3 leaves 1 of 10; giving up the 3 makes room for 2 + 2
    steps = packing.plan({6: 1, 3: 1, 2: 2}, 10)
    assert sorted((s[0], s[3]) for s in steps if s[4] == 0) == [(2, 2), (6, 1)]


def test_packing_plan_covers_all_counts():
    rng = random.Random(6)
    for _ in range(30):
        counts = {rng.randint(1, 64): rng.randint(1, 500) for _ in range(rng.randint(1, 40))}
        steps = packing.plan(counts, 64)
        for length, n in counts.items():
            got = sorted((a, b) for k, a, b, *_ in steps if k == length)
            assert got[0][0] == 0 and got[-1][1] == n and all(x[1] == y[0] for x, y in zip(got, got[1:]))


def _vectors(n, dim=16, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]


def _nearest(rows, k):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for q in (i for i in ids if i % 50 == 0):
        a = ids.index(q)
        score = x @ x[a] / (norm * norm[a])
        order = sorted((-round(s, 12), i) for s, i in zip(score, ids) if i != q)[:k]
        out[q] = [i for _, i in order]
    return out


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("shards", [1, 5])
def test_neighbours_recall(spark, monkeypatch, shards):
    """Against brute force, with graphs that have more points than a beam; several shards and blocks of queries."""
    monkeypatch.setattr(ann, "LEAST_ROWS", 3000 // shards)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 20)
    rows = _vectors(3000, 24)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert ann.build(ann.usable(frame))[1] == shards
    got = fx.pdf(ann.query(spark, frame))
    want = _nearest(rows, 5)
    hits = sum(len(set(g["vec_id"]) & set(want[q])) for q, g in got.groupby("query_id"))
    assert hits / (5 * len(want)) >= 0.9 and len(got) == 5 * len(want)


def test_neighbours_of_doubles(spark):
    base = [1.0] * 16
    rows = [(0, base, 0)] + [(i, [1.0 + i * 1e-12, *base[1:]], 0) for i in range(1, 30)]  # apart in doubles alone
    got = ann.query(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == 5 and all(r["score"] <= 1 + 1e-15 for r in got)
    a, norm = np.array([r[1] for r in rows]), np.linalg.norm(np.array([r[1] for r in rows]), axis=1)
    score = a @ a[0] / (norm * norm[0])
    assert all(abs(r["score"] - score[r["vec_id"]]) < 1e-15 for r in got)


def test_neighbours_hard_cases(spark):
    good = _vectors(40)
    copies = [(1000 + i, good[0][1], 1) for i in range(30)]
    bad = [(2000, None, 0), (2050, [0.0] * 16, 0), (2100, [float("nan")] * 16, 0), (2150, [float("inf")] + [1.0] * 15, 0), (2200, [None] + [1.0] * 15, 0), (2250, [], 0), (None, good[1][1], 0), (2300, [1.0] * 3, 0)]
    rows = spark.createDataFrame([*good, *copies, *bad, good[3]], SCHEMA)
    got = fx.pdf(ann.query(spark, rows))
    want = _nearest([*good, *copies], 5)
    assert {q: g.sort_values("rank")["vec_id"].tolist() for q, g in got.groupby("query_id")} == want
    few = fx.pdf(ann.query(spark, spark.createDataFrame(good[:3], SCHEMA)))
    assert len(few) == 2
    assert ann.query(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def _toxic_tables(n=900):
    rng = random.Random(8)
    rude, plain = ["nasty", "vile", "rotten"], ["tree", "river", "stone", "cloud", "bread", "lamp"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if toxic:
            words[0] = rng.choice(rude)
        if rng.random() < (0.7 if toxic else 0.2):  # a group is named more often in toxic texts
            words[-1] = "muslim"
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_documents(spark, tmp_path):
    docs, labels = _toxic_tables()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = spark.createDataFrame([*docs, (None, None), (5000, "")], "doc_id long, text string")
    out = fx.pdf(toxicity.query(spark, rows, str(tmp_path)))
    assert len(out) == len(docs) + 2 and out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.7)).all()
    truth = {i: t for i, _, t in labels}
    held = out[out["held_out"] & out["doc_id"].notna() & (out["doc_id"] < 5000)]
    assert all(zlib.crc32(str(int(d)).encode()) % 3 == 1 for d in held["doc_id"])
    right = [truth[int(d)] == p for d, p in zip(held["doc_id"], held["predicted"])]
    assert np.mean(right) > 0.97


def test_counterfactual_penalty_levels_identity_terms(spark):
    docs, labels = _toxic_tables()
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    gap = {}
    for penalty in (0.0, 4.0):  # the query's own
        a, b = toxicity.train(docs, labels, penalty).scores([b"tree river muslim", b"tree river jewish"])
        gap[penalty] = abs(a - b)
    assert gap[4.0] < 0.8 * gap[0.0]


def test_swaps_stay_within_a_kind():
    assert toxicity.swapped("an Atheist") == "an christian"
    assert toxicity.swapped("ein Mann, Atheist") == "ein frau, christ"
    assert toxicity.swapped("no such term") == "no such term"


def test_toxicity_hard_cases(spark):
    docs, labels = _toxic_tables()
    docs = [(i, t, 9.5, "x") for i, t in docs] + [(1, "nasty nasty", 9.5, "x"), (1, "nasty nasty", 9.5, "x"), (None, "vile", None, None), (7000, "nasty " * 200_000, 1.0, "y")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, score double, prediction string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = toxicity.score(docs, model, out="rate").collect()
    assert len(out) == 904 and {r["score"] for r in out} == {9.5, None, 1.0}
    rates = {r["doc_id"]: r["rate"] for r in out}
    assert rates[7000] > 0.7 and rates[None] > 0.7


def test_toxicity_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    model = toxicity.train(docs, empty)
    assert toxicity.score(docs, model).first()["score"] < 0.01
