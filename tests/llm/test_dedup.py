import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from alnspark.llm import common, fingerprint_dedup, jaccard_join, line_dedup, suffix_array as suffixes, suffix_dedup
from alnspark.llm.common import shared_path
from alnspark.llm.suffix_array import shares_prefix, suffix_array
from tests.llm import fixtures as fx

CASES = {"documents": fx.documents, "null ids": fx.with_null_ids, "empty": list}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("module", [line_dedup, suffix_dedup, fingerprint_dedup])
def test_queries_equal_sql(spark, module, case):
    rows = CASES[case]()
    fx.same(module.query(spark, fx.frame(spark, rows)), fx.sql(module.SQL, documents=(rows, fx.DOCS)))


@pytest.mark.parametrize("case", ["documents", "empty"])
def test_jaccard_query_equals_sql(spark, case):
    rows = CASES[case]()
    fx.same(jaccard_join.query(spark, fx.frame(spark, rows)), fx.sql(jaccard_join.SQL, documents=(rows, fx.DOCS)))


def test_jaccard_null_ids_come_first(spark):
    rows = fx.with_null_ids()
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.query(spark, fx.frame(spark, rows)).collect()}
    assert (None, None) in got and (rows[9][0], None) in got  # linked with the null row's text


@pytest.mark.parametrize("module", [line_dedup, suffix_dedup, fingerprint_dedup, jaccard_join])
def test_words_that_collide_under_polynomials(spark, module):
    rows = fx.colliding()
    fx.same(module.query(spark, fx.frame(spark, rows)), fx.sql(module.SQL, documents=(rows, fx.DOCS)))


def _sets(texts, n):
    out = []
    for t in texts:
        w = t.lower().split()
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


@pytest.mark.parametrize("words,num,den", [(4, 85, 100), (5, 4, 5), (1, 1, 2)])
def test_partenum_finds_every_link(spark, words, num, den):
    from fractions import Fraction

    rng = random.Random(words)
    texts = []
    for _ in range(25):  # sizes in many bands, copies with a growing number of changes
        base = [str(rng.randint(0, 10**6)) for _ in range(rng.choice([1, 3, 6, 9, 15, 40, 90, 200, 420]))]
        for changes in range(0, 8):
            w = list(base)
            for _ in range(min(len(w), changes * max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = str(rng.randint(0, 10**6))
            texts.append(" ".join(w))
    sets = _sets(texts, words)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["did"]: (r["n"], r["component"]) for r in jaccard_join.join(docs, words, Fraction(num, den)).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_keep_one_keeps_a_document_of_each_group(spark):
    rows = fx.documents()
    docs = fx.frame(spark, rows)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    heads = {r["did"] for r in jaccard_join.join(docs).where("did = component").collect()}
    assert {r["doc_id"] for r in kept.collect()} == heads


def test_keep_one_counts_rows(spark):
    text = lambda tag, *ends: " ".join([*(f"{tag}{i}" for i in range(100)), *ends])
    rows = [(None, text("a")), (None, text("a")), (None, text("a", "x")), (7, text("b")), (7, text("b", "x")), (8, text("b", "y")), (4, text("c")), (4, text("c")), (None, text("d")), (3, text("d", "x")), (7, text("e")), (None, ""), (None, None)]
    docs = fx.frame(spark, [(i, t, None, None, 0, 0, 0.0, "") for i, t in rows])
    kept = [(r["doc_id"], (r["text"] or "").split("0")[0]) for r in jaccard_join.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(None, "a"), (7, "b"), (4, "c"), (3, "d"), (7, "e"), (None, ""), (None, "")], key=str)


def _filter_holds(index, keys):
    """Which keys the index's filters know."""
    made = {r["shard"]: line_dedup.Cuckoo(r["buckets"], bytes(r["cells"])) for r in index.filters().collect()}
    return {bytes(r["key"]): r["shard"] in made and bool(made[r["shard"]].holds(line_dedup._words([r["key"]]))[0]) for r in index._sharded(keys).collect()}


def test_line_index_is_reversible(spark):
    old = fx.frame(spark, [(i, f"alpha beta gamma delta {i % 2}\nother {i}\nnumber {i // 3} of a long line", None, None, 0, 0, 0.0, "") for i in range(9)])
    new = fx.frame(spark, [(100 + i, "ALPHA beta gamma delta 1  \nnew line", None, None, 0, 0, 0.0, "") for i in range(3)])
    path = shared_path(spark, "t")
    index = line_dedup.LineIndex(spark, path, shards=3)
    index.insert(old)
    before = fx.key([r.asDict() for r in index.counts().collect()])
    keys = index.counts().select("key")
    index.insert(new)
    counts = sorted((r["n_docs"], r["last_doc"]) for r in index.counts().collect())
    assert counts == [(3, 2), (3, 5), (3, 8), (5, 8), (7, 102)]
    index.delete(new)
    assert fx.key([r.asDict() for r in index.counts().collect()]) == before
    index = line_dedup.LineIndex(spark, path)  # opened again
    assert index.shards == 3 and len(index.batches) == 3
    assert all(_filter_holds(index, keys).values())
    index.delete(old.where("doc_id >= 6"))
    assert sorted((r["n_docs"], r["last_doc"]) for r in index.counts().collect()) == [(3, 2), (3, 4), (3, 5), (3, 5)]
    assert sum(_filter_holds(index, keys).values()) == 4  # the key that fell below the threshold left its filter
    index.delete(old.where("doc_id < 6"))
    assert index.counts().count() == 0 and not any(_filter_holds(index, keys).values())


def test_deleting_first_counts_nothing(spark):
    index = line_dedup.LineIndex(spark, shared_path(spark, "t"))
    docs = fx.frame(spark, [(i, "a line that is long enough", None, None, 0, 0, 0.0, "") for i in range(5)])
    index.delete(docs)
    assert index.counts().isEmpty()
    index.insert(docs)
    assert index.counts().isEmpty()


def test_a_full_filter_is_built_anew(spark):
    text = lambda lo, hi: "\n".join(f"line number {i} of many lines" for i in range(lo, hi))
    docs = lambda lo, hi: fx.frame(spark, [(i, text(lo, hi), None, None, 0, 0, 0.0, "") for i in range(3)])
    index = line_dedup.LineIndex(spark, shared_path(spark, "t"), shards=1)
    index.insert(docs(0, 50))
    small = index.filters().first()["buckets"]
    index.insert(docs(50, 900))
    assert index.filters().first()["buckets"] > small and all(_filter_holds(index, index.counts()).values()) and index.counts().count() == 900


def test_an_index_that_grows_gets_more_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 10)
    path = shared_path(spark, "t")
    docs = lambda lo, hi: fx.frame(spark, [(i, "\n".join(f"line number {k} of many lines" for k in range(lo, hi)), None, None, 0, 0, 0.0, "") for i in range(3)])
    index = line_dedup.LineIndex(spark, path)
    index.insert(docs(0, 5))
    assert index.shards == 1
    index.insert(docs(5, 300))
    assert index.shards == 30 and index.filters().count() == 30
    again = line_dedup.LineIndex(spark, path)  # opened again
    again.insert(docs(300, 310))
    assert again.shards == 30 and again.counts().count() == 310 and all(_filter_holds(again, again.counts()).values())
    again.delete(docs(0, 5))
    assert again.counts().count() == 305


@pytest.mark.parametrize("per_copy", [1_000_000, 3])
def test_filters_dealt_by_shard(spark, monkeypatch, per_copy):
    rows = fx.documents()
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 1)
    monkeypatch.setattr(line_dedup, "LINES_PER_COPY", per_copy)
    fx.same(line_dedup.query(spark, fx.frame(spark, rows)), fx.sql(line_dedup.SQL, documents=(rows, fx.DOCS)))


def test_cuckoo_filter():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2**63, (5000, 2)).astype(np.uint64)
    made = line_dedup.Cuckoo.of(words)
    assert made.holds(words).all()
    assert made.holds(rng.integers(0, 2**63, (5000, 2)).astype(np.uint64)).mean() < 0.01
    for w in words[:2500]:
        assert made.delete(w)
    assert made.holds(words[2500:]).all() and made.holds(words[:2500]).mean() < 0.01


def test_rewrite_documents_keeps_columns(spark):
    rows = fx.with_null_ids()
    docs = fx.frame(spark, rows)
    out = line_dedup.rewrite_documents(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = fx.pdf(out)
    assert (got["n_chars"] == got["text"].str.len()).all()


@pytest.mark.parametrize("small", [1, 1 << 17])
def test_suffix_array_by_induced_sorting(monkeypatch, small):
    """Random, periodic and repeated texts over few and many symbols; buckets at once, and suffix by suffix."""
    monkeypatch.setattr(suffixes, "SMALL", small)
    rng = np.random.default_rng(1)
    for turn in range(300):
        n, k = int(rng.integers(0, 80)), int(rng.choice([1, 2, 3, 4, 40, 100_000]))
        text = rng.integers(1, k + 1, n)
        text = np.append([text, np.tile(text[:7], 9), np.concatenate([text, text[n // 3 :], text])][turn % 3], 0)
        assert suffix_array(text, k + 1).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_suffix_array_of_long_runs():
    """Substrings of many words, which the names compare to their end."""
    rng = np.random.default_rng(2)
    text = np.concatenate([np.repeat([2, 1, 2, 3], n) for n in rng.choice([1, 2, 50, 51, 400], 60)])
    text = np.append(text, 0)
    assert suffix_array(text, 4).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_shared_prefixes():
    data = np.frombuffer(b"abcabcabxabc", np.uint8)
    sa = suffix_array(np.append(data.astype(np.int64) + 1, 0), 257)
    room = np.arange(len(data), -1, -1)
    got = shares_prefix(np.append(data, 0), sa, 3, room)
    seen = {}
    for i in sa:
        piece = data[i : i + 3].tobytes()
        assert got[i] == (len(piece) == 3 and piece in seen)
        seen[piece] = i


def test_suffix_dedup_with_whole_windows_and_shuffled_texts(spark, monkeypatch):
    """Every fingerprint dealt by windows, many groups, and texts moved instead of broadcast keys."""
    for name, value in (("HOT", 0), ("GROUP_BYTES", 2000), ("SHARD_BYTES", 3000), ("BROADCAST_ROWS", -1), ("BLOCK", 700)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = fx.documents()
    fx.same(suffix_dedup.query(spark, fx.frame(spark, rows)), fx.sql(suffix_dedup.SQL, documents=(rows, fx.DOCS)))


def test_buckets_grow_when_runs_are_merged(spark, monkeypatch):
    monkeypatch.setattr(fingerprint_dedup, "RUNS", 1)
    monkeypatch.setattr(fingerprint_dedup, "BUCKET_ROWS", 20)
    rows = fx.documents()
    docs = fx.frame(spark, rows)
    path = shared_path(spark, "t")
    index = fingerprint_dedup.FingerprintIndex(spark, path, buckets=1)
    for i in range(3):
        index.append(docs.where(F.col("doc_id") % 3 == i))
    assert index.buckets > 1 and fingerprint_dedup.FingerprintIndex(spark, path).buckets == index.buckets
    out = index.apply(docs).select(F.col("did").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
    fx.same(out, fx.sql(fingerprint_dedup.SQL, documents=(rows, fx.DOCS)))


def test_fingerprint_index_is_incremental(spark, monkeypatch):
    monkeypatch.setattr(fingerprint_dedup, "RUNS", 2)
    monkeypatch.setattr(fingerprint_dedup, "BROADCAST_ROWS", -1)
    rows = fx.documents()
    docs = fx.frame(spark, rows)
    path = shared_path(spark, "t")
    index = fingerprint_dedup.FingerprintIndex(spark, path)
    for i in range(4):
        index.append(docs.where(F.col("doc_id") % 4 == i))
    assert [r[:2] for r in index.runs] == [(0, 2), (3, 3)]  # compacted once
    again = fingerprint_dedup.FingerprintIndex(spark, path)  # opened again
    assert [r[:2] for r in again.runs] == [(0, 2), (3, 3)] and again.batches == 4 and again.buckets == index.buckets
    plan = again._found(again.runs[1][2])._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan.split("== Physical Plan ==")[1]  # history is not moved
    out = again.apply(docs).select(F.col("did").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
    fx.same(out, fx.sql(fingerprint_dedup.SQL, documents=(rows, fx.DOCS)))


def test_hash_of_nothing():
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum("shuffle_" in files.apply(i).getName() for i in range(files.size()))


def test_a_stored_table_leaves_no_shuffle_files_and_goes_when_discarded(spark):
    """Near duplicates filled the disk with the shuffles of all their steps."""
    import time

    before = _shuffle_files(spark)
    kept = common.stored(spark.range(20_000).repartition(7, "id").groupBy((F.col("id") % 900).alias("k")).count(), "some")
    for _ in range(100):
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert _shuffle_files(spark) <= before and kept.count() == 900
    files = [f.removeprefix("file://") for f in kept.inputFiles()]
    common.discard(kept)
    assert files and not any(os.path.exists(f) for f in files)


def test_marks_never_count_too_few_and_texts_decide_near_the_threshold(spark, monkeypatch):
    rng = np.random.default_rng(4)
    for _ in range(200):
        x, y = (rng.integers(0, 40, rng.integers(0, 30)).astype("<u4") for _ in range(2))
        assert jaccard_join.in_common(x, y) == sum((Counter(x.tolist()) & Counter(y.tolist())).values())
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[: 60 - i] + [f"x{i}.{j}" for j in range(i)]), "en", "s", 0, None, None, None) for i in range(14)]
    want = fx.sql(jaccard_join.SQL, documents=(rows, fx.DOCS))
    for spare, sure in ((4, 1 << 22), (0, 1 << 22), (0, 0)):
        monkeypatch.setattr(jaccard_join, "SPARE", spare)
        monkeypatch.setattr(jaccard_join, "SURE", sure)
        fx.same(jaccard_join.query(spark, fx.frame(spark, rows)), want)


def test_discarding_one_kind_leaves_the_others(spark):
    rows = common.stored(spark.range(9).select("id", (F.col("id") % 3).cast("int").alias("kind")), "kinds", "kind")
    common.discard(rows, part="kind=1")
    assert sorted(r["id"] for r in rows.where("kind <> 1").collect()) == [0, 2, 3, 5, 6, 8]
    common.discard(common.stored(spark.range(0).withColumn("kind", F.lit(0)), "kinds", "kind"))


def test_wide_sketches_never_differ_more_than_their_sets(monkeypatch):
    monkeypatch.setattr(jaccard_join, "WIDE", 20)
    rng = np.random.default_rng(4)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        x, y = (np.unique(rng.choice(pool, n, replace=False)) for n in rng.integers(0, 300, 2))
        found = jaccard_join.wide_sketches(np.repeat([0, 1], [len(x), len(y)]), np.concatenate([x, y]), np.array([len(x), len(y)]))
        assert [w is None for w in found] == [len(x) <= 20, len(y) <= 20]
        if None not in found:
            differ = len(np.setxor1d(x, y))
            odd = jaccard_join.odd_cells(*found)
            assert odd <= differ and (differ - odd) % 2 == 0


def test_chance_pairs_of_large_sets_end_before_their_marks_move(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    common = [[word() for _ in range(12)] for _ in range(40)]

    def text(n):  # passages that many documents hold, between words of its own
        return [w for _ in range(n) for w in [*rng.choice(common), *[word() for _ in range(36)]]]

    sets = [text(40) for _ in range(60)]
    near = list(sets[0])
    near[100] = word()
    rows = [(i, " ".join(w), "en", "s", 0, None, None, None) for i, w in enumerate([*sets, near])]
    tested, verified = [], jaccard_join.verified

    def spy(pairs, *rest):
        tested.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "verified", spy)
    got = {r["did"]: r["component"] for r in jaccard_join.join(fx.frame(spark, rows)).collect()}
    assert got == {i: i % 60 for i in range(61)}
    assert sum(tested) <= 3


def test_short_phrases_that_repeat_by_chance_send_no_runs(spark):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrst", k=n))
    phrases = [letters(26) for _ in range(5)]
    texts = ["".join(x for _ in range(40) for x in (letters(30), rng.choice(phrases))) for _ in range(30)]
    passage = letters(50)
    texts += [letters(200) + passage + letters(200), letters(70) + passage]
    rows = [(i, i, t, i % 4) for i, t in enumerate(texts)]
    hits = suffix_dedup.repeated_prints(spark.createDataFrame(rows, "did long, th long, text string, b int"), 50, 2, 4).collect()
    assert {r["b"] for r in hits} == {30 % 4, 31 % 4} and sum(len(r["keys"]) for r in hits) == 16


@pytest.mark.parametrize("hot", [2_000, 1])
def test_equal_windows_share_a_context_in_periodic_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(10)
    texts = []
    for i in range(40):
        period = "".join(rng.choices("ab", k=rng.randint(1, 40)))
        body = list((period * 300)[: rng.randint(49, 400)])
        for _ in range(rng.randint(0, 3)):
            body[rng.randrange(len(body))] = rng.choice("abc")
        texts += ["".join(body), "".join(rng.choices("xyz", k=rng.randint(0, 20))) + "".join(body[rng.randint(0, 30) :]) + "q"]
    rows = [(i, t, "en", "s", 0, None, None, None) for i, t in enumerate(texts)]
    fx.same(suffix_dedup.query(spark, fx.frame(spark, rows)), fx.sql(suffix_dedup.SQL, documents=(rows, fx.DOCS)))
    held = [suffix_dedup.Runs([t.encode()], 50) for t in texts]
    seen = {}
    for runs, text in zip(held, texts):  # each window lies in one run; equal windows have one of its contexts in common
        for n, (start, windows) in enumerate(zip(runs.start, runs.windows)):
            for at in range(start, start + windows):
                own = set(runs.context[runs.run == n].tolist())
                assert seen.setdefault(text[at : at + 50], own) & own
                seen[text[at : at + 50]] &= own
