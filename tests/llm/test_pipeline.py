"""The pipeline against plain Python; only the classifier's scores come from the library."""

import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from alnspark.llm import toxicity
from tests.llm import fixtures as fx

_SPACE = " \t\n\x0b\x0c\r"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _dedup_lines(docs):
    """Lines that three documents share stay in the last of them; who loses all text goes.  ``docs`` are (id, text)."""
    key = lambda line: line.strip(_SPACE).translate(_LOWER)
    holders = {}
    for i, text in docs:
        for line in text.split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in docs:
        kept = [x for x in text.split("\n") if len(holders.get(key(x), ())) < 3 or i == max(holders[key(x)])]
        new = "\n".join(kept)
        if new == text or new.strip(_SPACE):
            out.append((i, new))
    return out


def _one_of_each(docs):
    """One document of each group of similarity 0.8 on five words; documents without words stay."""
    sets = []
    for _, text in docs:
        w = text.translate(_LOWER).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(docs[i])
    return [d for i, g in groups.items() for d in (g if not sets[i] else [min(g)])]


def _clean(docs, items):
    words = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))
    windows = set()
    for _, text in items:
        w = words(text)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

    def hit(text):
        w = words(text)
        return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    return [d for d in docs if not hit(d[1])]


def _pieces(docs):
    tok, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for i, text in docs:
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        out += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return out


def test_run_equals_plain_python(spark, tmp_path):
    rows, sf = fx.documents() + fx.colliding(5000), str(tmp_path)
    fx.frame(spark, rows).write.parquet(f"{sf}/documents.parquet")
    fx.frame(spark, fx.benchmark(), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    labels = spark.createDataFrame([(r[0], 1, int(i % 7 == 0)) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rated = toxicity.score(docs, toxicity.train(docs, labels), out="rate").select("doc_id", "text", "rate").collect()
    kept = [(r["doc_id"], r["text"] or "") for r in rated if r["rate"] < 0.7]
    assert 0 < len(kept) < len(rows)
    sizes = [len(kept)]
    for stage in (_dedup_lines, _one_of_each, lambda d: _clean(d, fx.benchmark())):
        kept = stage(kept)
        sizes.append(len(kept))
    assert sizes == sorted(sizes, reverse=True) and sizes[1] > sizes[2] > sizes[3]
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(_pieces(kept))
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in places.values():
        pieces.sort()
        assert [at for at, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1]] and sum(n for _, n in pieces) <= 2048


def test_stages_keep_columns(spark, tmp_path):
    """Columns with the names that stages use themselves, and their values, come through."""
    sf = str(tmp_path)
    fx.frame(spark, fx.benchmark(), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    names = "doc_id long, text string, score double, _score double, did long, _did long, th string, _th string, equal int, row string, kept string, drop int"
    text = lambda i: "\n".join(f"word{i}{j} of line {j} in document {i}" for j in range(30))
    rows = [(i, text(i), 9.5, 0.25, 7, 8, "t", "u", 5, "r", "k", 3) for i in range(12)]
    docs = spark.createDataFrame(rows, names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes, name
        assert sorted(map(tuple, out.collect())) == rows, name
