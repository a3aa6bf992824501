"""Byte-level deduplication with induced suffix arrays over shards of the repeated text.

Each window of ``length`` bytes has a fingerprint, its least 16-byte hash, and neighbouring windows mostly share
it: a document is a row of runs.  Sixteen bytes repeat by chance, the more the larger the corpus is, so a window also has a
context: the bytes beside that hash's place, on the side that reaches farther into the window.  Contexts of one
document alone cannot repeat.  The runs that hold others,
each with the bytes that its windows cover, are dealt by fingerprint, so equal windows meet in one shard.
There, distinct runs are joined to one text whose suffix array and permuted common prefixes group the equal
windows; a window's least document goes back to the documents that hold it.

Rows between steps carry packed arrays for a group of documents, not one row a fingerprint.  A fingerprint
that very many groups hold is dealt by whole windows instead, so no shard grows with one passage.

Defined cases: null texts are empty; a null id comes before all others; rows with one id never remove from
each other; texts under ``length`` bytes keep everything; long texts are read in overlapping blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alnspark.llm.common import discard, id_or_null, keyed, slices, stored
from alnspark.llm.suffix_array import shares_prefix, suffix_array, words_at
from alnspark.llm.wordhash import U, mix, powers

LENGTH, GRAM = 50, 16
GROUP_BYTES, SHARD_BYTES, BLOCK = 4 << 20, 2 << 20, 2 << 20
#: Share of the text expected in shards; only the number of shards follows from it.
EXPECTED = 0.4
PART_ENTRIES = 1_000_000
#: A fingerprint whose repeated contexts are in more groups of documents than this is dealt by whole windows.
HOT = 2_000
HASH_BITS, PRINT_BITS = 39, 16
BROADCAST_ROWS = 2_000_000


class Runs:
    """The runs of some documents: number of the document, start, windows, fingerprint, and hash of the bytes covered; and the contexts
    of their windows, each with the number of its run."""

    def __init__(self, texts: list[bytes], length: int):
        out = []
        for slices, doc, base in _blocks(texts, length):
            *more, run = self._of(slices, doc, base, length)
            out.append((*more, run + sum(len(o[0]) for o in out)))
        self.doc, self.start, self.windows, self.print, self.code, self.context, self.run = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(7))
        self.print, self.code, self.context = self.print.astype(U), self.code.astype(U), self.context.astype(U)

    @staticmethod
    def _of(slices: list[bytes], doc: np.ndarray, base: np.ndarray, length: int):
        data = np.frombuffer(b"\n".join(slices) + b"\n" * (length + 1), np.uint8)
        sizes = np.fromiter(map(len, slices), np.int64, len(slices))
        at = np.concatenate([[0], np.cumsum(sizes + 1)])
        n = int(at[-1])
        gram = _grams(data)
        least, ahead = (x[:n] for x in _least(gram, length - GRAM + 1))
        owner = np.repeat(np.arange(len(slices)), sizes + 1)
        valid = np.arange(n) + length <= (at[:-1] + sizes)[owner]
        edge = np.ones(n + 1, bool)
        edge[1:n] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1]) | (owner[1:] != owner[:-1])
        edge = np.flatnonzero(edge)
        start, stop = edge[:-1], edge[1:]
        keep = valid[start]
        start, stop = start[keep], stop[keep]
        own = owner[start]
        side = (length - GRAM) // 2
        right = ahead <= length - GRAM - side
        new = valid.copy()  # another place of the least hash, or its other side
        new[1:] &= (ahead[1:] + 1 != ahead[:-1]) | (right[1:] != right[:-1]) | ~valid[:-1]
        new = np.flatnonzero(new)
        begin = new + ahead[new] - np.where(right[new], 0, side)
        context = mix(mix(gram[begin]) + gram[begin + side])
        return doc[own], start - at[own] + base[own], stop - start, least[start], _codes(gram, start, stop - start + length - 1), context, np.searchsorted(start, new, side="right") - 1


def _least(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of ``width`` values from each place, and how far ahead it is; of equal ones the first."""
    ahead, held = np.zeros(len(values), np.min_scalar_type(width)), 1
    while held < width:
        step = min(held, width - held)
        before, after = values[:-step], values[step:]
        ahead = np.where(after < before, ahead[step:] + step, ahead[:-step])
        values = np.minimum(before, after)
        held += step
    return values, ahead


def _grams(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each place, as far as 16 bytes are left."""
    eight = words_at(data)
    return mix(eight[:-8] * U(0x9E3779B97F4A7C15) + (eight[8:] ^ (eight[8:] >> U(29))) * U(0xD6E8FEB86659FD93))


def _codes(gram: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of slices, over the hashes of their grams: a polynomial over bytes has known collisions."""
    sums = np.zeros(len(gram) + 1, U)
    np.cumsum(gram * powers(0, len(gram)), out=sums[1:])
    return mix((sums[start + size - GRAM + 1] - sums[start]) * powers(0, len(gram) + 1, True)[start] + size.astype(U))


def _blocks(texts: list[bytes], length: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Slices of about BLOCK bytes in all, with their documents and offsets; slices of one text overlap."""
    slices, doc, base, total = [], [], [], 0
    for i, text in enumerate(texts):
        for lo in range(0, max(1, len(text) - length + 1), BLOCK):
            piece = text[lo : lo + BLOCK + length - 1]
            if slices and total + len(piece) > BLOCK:
                yield slices, np.array(doc), np.array(base)
                slices, doc, base, total = [], [], [], 0
            slices.append(piece)
            doc.append(i)
            base.append(lo)
            total += len(piece)
    if slices:
        yield slices, np.array(doc), np.array(base)


def _keys(runs: Runs, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts of contexts and their keys there: first ``PRINT_BITS`` of the fingerprint, by which the parts are dealt too."""
    spread, low = mix(runs.print)[runs.run], HASH_BITS - PRINT_BITS
    return (spread & U(0xFFFFFF)).astype(np.int64) % parts, (spread >> U(64 - PRINT_BITS) << U(low) | runs.context >> U(64 - low)).astype(np.int64)


def _spans_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of equal neighbours, and each place's number of them."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _pack(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values).astype(kind).tobytes()


def repeated_prints(docs: DataFrame, length: int, parts: int, groups: int) -> DataFrame:
    """(b, keys): for each group of documents, the packed keys of its contexts that two documents hold."""
    small = "<u2" if groups <= 1 << 16 else "<u4"

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part for whole in batches for part in slices(whole, 4_000)):
            runs = Runs([t.encode() for t in pdf["text"]], length)
            part, key = _keys(runs, parts)
            doc = runs.doc[runs.run]
            b = pdf["b"].to_numpy()[doc].astype(np.int64)
            order = np.lexsort(((b << 32) + doc, (part << HASH_BITS) + key))
            part, key, b, doc = part[order], key[order], b[order], doc[order]
            first = _first_of(part, key, b)
            several = np.zeros(len(first), bool)
            if len(first):
                several = np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first)
            part, key, b = part[first], key[first] * 2 + several, b[first]
            cut, _ = _spans_of(part)
            stop = np.append(cut[1:], len(part))
            five = np.ascontiguousarray(key.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
            yield pd.DataFrame({"part": part[cut].astype(np.int32), "keys": [five[i:j].tobytes() for i, j in zip(cut, stop)], "bs": [_pack(b[i:j], small) for i, j in zip(cut, stop)]})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = np.zeros((sum(map(len, pdf["keys"])) // 5, 8), np.uint8)
        raw[:, :5] = np.frombuffer(b"".join(pdf["keys"]), np.uint8).reshape(-1, 5)
        key = raw.view("<u8").ravel().astype(np.int64)
        b = np.frombuffer(b"".join(pdf["bs"]), small).astype(np.int64)
        order = np.argsort(key >> 1, kind="stable")
        key, b = key[order], b[order]
        first, number = _spans_of(key >> 1)
        count = np.bincount(number) if len(key) else np.zeros(0, np.int64)
        several = np.bitwise_or.reduceat(key & 1, first) if len(key) else count
        take = ((count > 1) | (several > 0))[number]
        key, b = key[take] >> 1, b[take]
        # a fingerprint's contexts are neighbours; it goes by windows where they are held by too many groups together
        first, number = _spans_of(key >> (HASH_BITS - PRINT_BITS))
        order = np.lexsort((b, number))
        new = np.ones(len(b), bool)
        new[1:] = (b[order][1:] != b[order][:-1]) | (number[order][1:] != number[order][:-1])
        out = key * 2 + (np.bincount(number[order][new], minlength=len(first)) > HOT)[number]
        order = np.lexsort((out, b))
        out, b = out[order], b[order]
        cut, _ = _spans_of(b)
        return pd.DataFrame({"b": b[cut].astype(np.int32), "part": np.full(len(cut), pdf["part"].iloc[0], np.int32), "keys": [_pack(x, "<i8") for x in np.split(out, cut[1:])] if len(cut) else []})

    posted = docs.mapInPandas(post, "part int, keys binary, bs binary")
    return posted.groupBy("part").applyInPandas(meet, "b int, part int, keys binary")


def _first_of(part: np.ndarray, key: np.ndarray, b: np.ndarray) -> np.ndarray:
    new = np.ones(len(part), bool)
    new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (b[1:] != b[:-1])
    return np.flatnonzero(new)


PIECES = "kind int, b int, shard int, did long, th long, n long, sha string, x1 binary, x2 binary, x3 binary, x4 binary, x5 binary, x6 binary"


def pieces(docs: DataFrame, hits: DataFrame, length: int, parts: int, shards: int) -> DataFrame:
    """Three kinds of rows: 0, a document; 1, a group's distinct repeated runs for one shard; 2, where a group's runs lie."""

    def cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["did", "th"], kind="stable").reset_index(drop=True)
        texts = [t.encode() for t in left["text"]]
        rows = [(0, None, None, int(d), int(h), len(t), hashlib.sha256(t).hexdigest(), *[None] * 6) for d, h, t in zip(left["did"], left["th"], texts)]
        if len(right) and texts:
            b = int(left["b"].iloc[0])
            known = np.sort(np.concatenate([np.frombuffer(k, "<i8") + (int(p) << (HASH_BITS + 1)) for p, k in zip(right["part"], right["keys"])]))
            runs = Runs(texts, length)
            part, key = _keys(runs, parts)
            full = (part << HASH_BITS) + key
            at = np.minimum(np.searchsorted(known >> 1, full), len(known) - 1)
            hit = (known >> 1)[at] == full
            take, one = np.unique(runs.run[hit], return_index=True)
            hot = (known[at] & 1).astype(bool)[hit][one]
            doc, start, windows, prints, code = runs.doc[take], runs.start[take], runs.windows[take], runs.print[take], runs.code[take]
            del runs, part, key, full, at
            offset = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            data = np.frombuffer(b"".join(texts) + b"\0" * GRAM, np.uint8)
            if hot.any():  # one piece a window
                many = np.repeat(np.flatnonzero(hot), windows[hot])
                step = np.arange(len(many)) - np.repeat(np.cumsum(windows[hot]) - windows[hot], windows[hot])
                d, s = doc[many], start[many] + step
                c = _codes(_grams(data), offset[d] + s, np.full(len(d), length))
                doc, start, windows, prints, code = (np.concatenate([x[~hot], y]) for x, y in ((doc, d), (start, s), (windows, np.ones(len(d), np.int64)), (prints, mix(c)), (code, c)))
            order = np.lexsort((doc, code, prints))
            doc, start, windows, prints, code = doc[order], start[order], windows[order], prints[order], code[order]
            new = np.ones(len(doc), bool)
            new[1:] = (prints[1:] != prints[:-1]) | (code[1:] != code[:-1])
            first, number = np.flatnonzero(new), np.cumsum(new) - 1
            if len(first):
                did = left["did"].to_numpy()
                shard = (mix(prints[first] ^ U(11)) % U(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                bounds, _ = _spans_of(shard[order])
                for one in np.split(order, bounds[1:]):
                    f = first[one]
                    size = windows[f] + length - 1
                    begin = offset[doc[f]] + start[f]
                    index = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
                    rows.append((1, b, int(shard[one[0]]), None, None, None, None, _pack(prints[f], "<u8"), _pack(size, "<u4"), _pack(did[doc[f]], "<i8"), _pack(one, "<u4"), zstandard.compress(data[index].tobytes(), 1), None))
                rows.append((2, b, None, None, None, None, None, _pack(doc, "<u4"), _pack(start, "<u8"), _pack(number, "<u4"), _pack(windows[first], "<u4"), _pack(did, "<i8"), _pack(left["th"].to_numpy(), "<i8")))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")], dtype=object)  # numbers beside nulls stay exact
        return out.astype({c: "Int64" for c in ("b", "shard", "did", "th", "n")})

    return docs.groupBy("b").cogroup(hits.groupBy("b")).applyInPandas(cut, PIECES)


def least_holders(shard: pd.DataFrame, length: int) -> pd.DataFrame:
    """Of a shard's runs: for each group and run, from which window on which document is the least to hold it."""
    read = lambda c, kind: np.frombuffer(b"".join(shard[c]), kind)
    prints, size, did, idx = read("x1", "<u8"), read("x2", "<u4").astype(np.int64), read("x3", "<i8"), read("x4", "<u4")
    group = np.repeat(shard["b"].to_numpy().astype(np.int64), [len(x) // 8 for x in shard["x1"]])
    data = np.frombuffer(b"".join(map(zstandard.decompress, shard["x5"])), np.uint8)
    begin = np.cumsum(size) - size
    cuts, _ = _spans_of(begin // BLOCK)
    code = np.concatenate([_codes(_grams(data[b[0] : b[-1] + n[-1]]), b - b[0], n) for b, n in zip(np.split(begin, cuts[1:]), np.split(size, cuts[1:]))])
    order = np.lexsort((did, code, prints))
    p, c = prints[order], code[order]
    new = np.ones(len(order), bool)
    new[1:] = (p[1:] != p[:-1]) | (c[1:] != c[:-1])
    first, number = np.flatnonzero(new), np.cumsum(new) - 1
    holder, size, begin, p = did[order][first], size[order][first], begin[order][first], p[first]
    # a fingerprint with one run needs no sorting: its first holder is the least for all its windows
    lead, same = _spans_of(p)
    lone = (np.diff(np.append(lead, len(p))) == 1)[same]
    run, off, least = [np.flatnonzero(lone)], [np.zeros(lone.sum(), np.int64)], [holder[lone]]
    rest = np.flatnonzero(~lone)
    # runs of one fingerprint stay together
    part = (np.cumsum(size[rest]) // SHARD_BYTES)[np.searchsorted(same[rest], same[rest])] if len(rest) else rest
    cuts, _ = _spans_of(part)
    for some in np.split(rest, cuts[1:]) if len(rest) else []:
        r, o, l = _by_suffixes(data, begin[some], size[some], holder[some], length)
        run.append(some[r])
        off.append(o)
        least.append(l)
    run, off, least = np.concatenate(run), np.concatenate(off), np.concatenate(least)
    by_run = np.lexsort((off, run))
    run, off, least = run[by_run], off[by_run], least[by_run]
    count = np.bincount(run, minlength=len(first))
    at = np.cumsum(count) - count
    # back to each group's own number of the run
    times = count[number]
    pick = np.repeat(at[number], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    g, i = np.repeat(group[order], times), np.repeat(idx[order], times)
    by_group = np.argsort(g, kind="stable")
    g = g[by_group]
    cut, _ = _spans_of(g)
    split = lambda x, kind: [_pack(v, kind) for v in np.split(x[by_group], cut[1:])]
    return pd.DataFrame({"b": g[cut].astype(np.int32), "idx": split(i, "<u4"), "off": split(off[pick], "<u4"), "least": split(least[pick], "<i8")})


def _by_suffixes(data: np.ndarray, begin: np.ndarray, size: np.ndarray, holder: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, offset, least holder from that window on) by the suffix array of the runs, joined with a separator."""
    total = int((size + 1).sum()) + 1
    place = np.cumsum(size + 1) - (size + 1)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    to, source = inside + np.repeat(place, size), inside + np.repeat(begin, size)
    text = np.ones(total, np.uint16)  # 1 separates, 0 ends
    text[-1] = 0
    text[to] = data[source].astype(np.uint16) + 2
    raw = np.zeros(total, np.uint8)
    raw[to] = data[source]
    room = np.zeros(total, np.int64)
    room[to] = np.repeat(size, size) - inside
    owner = np.zeros(total, np.int64)
    owner[to] = np.repeat(np.arange(len(size)), size)
    sa = suffix_array(text, 258)
    shares = shares_prefix(raw, sa, length, room)
    sa = sa[room[sa] >= length]  # equal windows stay neighbours
    first = np.flatnonzero(~shares[sa])
    least = np.empty(total, np.int64)
    if len(sa):
        low = np.minimum.reduceat(holder[owner[sa]], first)
        least[sa] = np.repeat(low, np.diff(np.append(first, len(sa))))
    windows = size - length + 1
    step = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    run = np.repeat(np.arange(len(size)), windows)
    value = least[step + np.repeat(place, windows)]
    new = step == 0
    new[1:] |= value[1:] != value[:-1]
    return run[new], step[new], value[new]


def removals(occurrences: DataFrame, holders: DataFrame, length: int) -> DataFrame:
    """(did, th, spans, n_removed, n_spans) of the documents that lose bytes; spans are packed (start, end) pairs."""
    names = ["did", "th", "spans", "n_removed", "n_spans"]

    def gather(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({n: [] for n in names})
        one = left.iloc[0]
        doc, start, number, windows, did, th = (np.frombuffer(one[f"x{i}"], k).astype(np.int64) for i, k in enumerate(("<u4", "<u8", "<u4", "<u4", "<i8", "<i8"), 1))
        idx, off, least = (np.frombuffer(b"".join(right[c]), k).astype(np.int64) for c, k in (("idx", "<u4"), ("off", "<u4"), ("least", "<i8")))
        order = np.lexsort((off, idx))
        idx, off, least = idx[order], off[order], least[order]
        stop = windows[idx].copy()
        follows = np.flatnonzero(idx[1:] == idx[:-1])
        stop[follows] = off[follows + 1]
        count = np.bincount(idx, minlength=len(windows))
        at = np.cumsum(count) - count
        times = count[number]
        pick = np.repeat(at[number], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        who, begin = np.repeat(doc, times), np.repeat(start, times)
        gone = least[pick] < did[who]
        who, lo, hi = who[gone], (begin + off[pick])[gone], (begin + stop[pick] - 1 + length)[gone]
        if not len(who):
            return pd.DataFrame({n: [] for n in names})
        order = np.lexsort((lo, who))
        who, lo, hi = who[order], lo[order], hi[order]
        far = int(hi.max()) + 1
        reach = np.maximum.accumulate(who * far + hi)  # documents in order, so it starts anew with each
        new = np.ones(len(who), bool)
        new[1:] = (who[1:] * far + lo[1:] > reach[:-1]) | (who[1:] != who[:-1])
        first = np.flatnonzero(new)
        end = reach[np.append(first[1:], len(who)) - 1] - who[first] * far
        begin, who = lo[first], who[first]
        cut, _ = _spans_of(who)
        pairs = np.stack([begin, end], 1)
        return pd.DataFrame({
            "did": did[who[cut]], "th": th[who[cut]], "spans": [_pack(x, "<i8") for x in np.split(pairs, cut[1:])],
            "n_removed": np.add.reduceat(end - begin, cut), "n_spans": np.diff(np.append(cut, len(who))),
        })

    out = occurrences.groupBy("b").cogroup(holders.groupBy("b")).applyInPandas(gather, "did long, th long, spans binary, n_removed long, n_spans long")
    return out.dropDuplicates(["did", "th"])


RESULT = "did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary, kept binary"


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Per row of ``docs``: did, n_bytes, n_removed, n_spans, kept_sha256, and where bytes go, spans (packed pairs)
    and, with ``texts``, kept (binary)."""
    if length < GRAM:
        raise ValueError(f"a window has {GRAM} bytes or more")
    own = keyed(docs, id_col, text_col).withColumn("size", F.octet_length("text"))
    total = own.agg(F.sum("size")).first()[0] or 0
    groups, shards = max(1, math.ceil(total / GROUP_BYTES)), max(1, math.ceil(total * EXPECTED / SHARD_BYTES))
    # later copies of a whole text lose all of it, and say nothing that the first does not
    firsts = stored(own.groupBy("th", "size").agg(F.min("did").alias("first"), F.max("did").alias("last")).where("first < last").drop("last"), "suffix-copies")
    marked = own.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts, ["th", "size"], "left")
    copies = marked.where("did > first")
    own = marked.where("first IS NULL OR did = first").select("did", "th", "text")
    parts = min(1 << 23, max(1, math.ceil(total / (length - GRAM) * 4 / PART_ENTRIES)))
    own = own.withColumn("b", F.pmod(F.xxhash64("did", "th"), F.lit(groups)).cast("int"))
    # a step's shuffle files, and what nothing reads any more, go before the next step begins
    hits = stored(repeated_prints(own, length, parts, groups), "suffix-prints")
    cut = stored(pieces(own, hits, length, parts, shards), "suffix-pieces", "kind")
    discard(hits)
    holders = cut.where("kind = 1").select("b", "shard", *[f"x{i}" for i in range(1, 6)]).groupBy("shard").applyInPandas(lambda pdf: least_holders(pdf, length), "b int, idx binary, off binary, least binary")
    holders = stored(holders, "suffix-holders")
    discard(cut, part="kind=1")
    gone = stored(removals(cut.where("kind = 2").select("b", *[f"x{i}" for i in range(1, 7)]), holders, length), "suffix-removed")

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part for whole in batches for part in slices(whole)):
            kept = []
            for text, spans in zip(pdf["text"], pdf["spans"]):
                data, at, out = text.encode(), 0, []
                for lo, hi in np.frombuffer(spans, "<i8").reshape(-1, 2).tolist():
                    out.append(data[at:lo])
                    at = hi
                kept.append(b"".join([*out, data[at:]]))
            yield pd.DataFrame({"did": pdf["did"], "n_bytes": pdf["size"], "n_removed": pdf["n_removed"], "n_spans": pdf["n_spans"], "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept], "spans": pdf["spans"], "kept": kept if texts else [None] * len(kept)})

    # texts stay where they are while the documents that change are few
    wanted = F.broadcast(gone) if (gone.agg(F.sum("n_spans")).first()[0] or 0) <= BROADCAST_ROWS else gone
    changed = own.select("did", "th", "text", F.octet_length("text").cast("long").alias("size")).join(wanted, ["did", "th"]).mapInPandas(rewrite, RESULT)
    unchanged = cut.where("kind = 0").join(gone.select("did", "th"), ["did", "th"], "left_anti").select(
        "did", F.col("n").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("binary").alias("spans"), F.lit(None).cast("binary").alias("kept"),
    )
    long = F.col("size") >= length
    kept = F.when(long, F.lit("")).otherwise(F.col("text")).cast("binary")
    return changed.union(unchanged).union(copies.select(
        "did", F.col("size").cast("long").alias("n_bytes"), F.when(long, F.col("size")).otherwise(0).cast("long").alias("n_removed"), long.cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"),
        F.lit(None).cast("binary").alias("spans"), kept.alias("kept"),
    ))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return dedup(docs, texts=False).select(id_or_null().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS did, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, did, p, substr(x, 2 * p + 1, 100) AS s FROM (SELECT r, did, x, unnest(range(0, len(x) // 2 - 49)) AS p FROM d WHERE len(x) >= 100)),
m AS (SELECT s, min(did) AS least FROM w GROUP BY s),
g AS (SELECT w.r, w.p FROM w JOIN m ON w.s = m.s WHERE m.least < w.did),
e AS (SELECT r, p, CASE WHEN lag(p) OVER o IS NULL OR p > lag(p) OVER o + 50 THEN 1 ELSE 0 END AS new FROM g WINDOW o AS (PARTITION BY r ORDER BY p)),
n AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS span FROM e),
s AS (SELECT r, span, min(p) AS lo, max(p) + 50 AS hi FROM n GROUP BY r, span),
k AS (SELECT s.r, span, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY s.r ORDER BY lo) AS before FROM s),
t AS (
  SELECT k.r, sum(hi - lo) AS n_removed, count(*) AS n_spans,
    string_agg(substr(x, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || substr(any_value(x), 2 * max(hi) + 1) AS kept
  FROM k JOIN d ON d.r = k.r GROUP BY k.r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN t ON d.r = t.r
"""
