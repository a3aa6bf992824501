import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from alnspark.functions import sequence as sq
from alnspark.functions import text as tx
from alnspark.operators import compare, coverage, edits, encode, filters, intervals, ordered, quality, rebuild
from alnspark.plans import views
from alnspark.sources import fasta, logs, sam
from alnspark.streaming import offsets

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_reverse_complement_is_an_involution(spark):
    rng = random.Random(1)
    for n in (0, 1, 13, 50):
        s = "".join(rng.choice("ACGTN") for _ in range(n))
        assert one(spark, sq.reverse_complement(sq.reverse_complement(F.col("s"))), s=s) == s


def test_minimizer_is_the_least_kmer(spark):
    s = "TTGACCATGCAGTACCA"
    assert one(spark, sq.minimizer(F.col("s"), 5), s=s) == min(s[i : i + 5] for i in range(len(s) - 4))
    assert one(spark, sq.minimizer(F.col("s"), 30), s=s) is None


def test_codes_round_trip(spark):
    assert one(spark, sq.inserted_base(sq.insert_code(F.col("s"))), s="NACGT") == "NACGT"
    for n in (0, 65535, 65536, 70000):
        assert one(spark, sq.splice_length(sq.splice_bytes(F.col("n"))), n=n) == n


def test_ordered_operators_equal_plain_windows(spark):
    rng = random.Random(2)
    data = [(rng.randint(0, 2), rng.randint(0, 60), i, rng.randint(-5, 5)) for i in range(300)]
    df = spark.createDataFrame(data, "k int, a int, b int, x int")
    out = ordered.previous(df, ["k"], ["a", "b"], "x", "before")
    out = ordered.running_sum(out, ["k"], ["a", "b"], F.col("x"), "total")
    got = {r["b"]: (r["before"], r["total"]) for r in out.collect()}
    for k in range(3):
        before, total = None, 0
        for _, a, b, x in sorted(d for d in data if d[0] == k):
            total += x
            assert got[b] == (before, total)
            before = x


def test_offsets_round_trip_and_counts(spark):
    aln = filters.mapped(views.aln(spark, SF))
    runs = encode.offset_runs(aln)
    assert runs.agg(F.sum("mult")).first()[0] == aln.count()
    back = encode.offsets_of(runs)
    pos = aln.select("ref_id", "pos")
    assert back.exceptAll(pos).isEmpty() and pos.exceptAll(back).isEmpty()


def test_depth_by_window_equals_depth_by_base(spark):
    aln = filters.mapped(views.aln(spark, SF))
    a = {r["ref_id"]: (r["bases"], r["covered"]) for r in coverage.depth(aln, 32).collect()}
    b = {r[0]: (r[1], r[2]) for r in coverage.depth_by_base(aln, 32).groupBy("ref_id").agg(F.sum("depth"), F.count("*")).collect()}
    assert a == b


def test_nested_bins_equal_theta_joins(spark, monkeypatch):
    monkeypatch.setattr(intervals, "FIRST", 2)
    monkeypatch.setattr(intervals, "STEP", 1)
    monkeypatch.setattr(intervals, "LEVELS", 7)
    rng = random.Random(3)
    def some(n, p):
        return spark.createDataFrame([(rng.randint(0, 1), i, s, s + rng.choice([0, 1, 5, 300, rng.randint(0, 2000)])) for i in range(n) for s in [rng.randint(0, 2000)]], f"ref_id int, {p} int, {p}_start int, {p}_stop int")
    a, b = some(60, "a"), some(40, "b")
    base = a.join(b, "ref_id")
    meet = base.where("a_start <= b_stop AND a_stop >= b_start").select("a", "b")
    inside = base.where("a_start >= b_start AND a_stop <= b_stop").select("a", "b")
    for got, want in ((intervals.overlap(a, b), meet), (intervals.contained(a, b), inside)):
        assert sorted(map(tuple, got.select("a", "b").collect())) == sorted(map(tuple, want.collect()))


def test_a_long_interval_is_one_row(spark):
    whole = spark.createDataFrame([(0, 0, 250_000_000), (0, 2**33, 2**40), (0, 2**60, 2**62)], "ref_id int, a_start long, a_stop long")
    point = spark.createDataFrame([(0, p, p) for p in (0, 249_999_999, 250_000_001, 2**39, 2**61)], "ref_id int, b_start long, b_stop long")
    assert intervals._own_bin(whole, "a").count() == 3
    for a, b in ((whole, point), (point.toDF("ref_id", "a_start", "a_stop"), whole.toDF("ref_id", "b_start", "b_stop"))):
        assert intervals.overlap(a, b).count() == 4
    asked = intervals._asking(intervals._own_bin(point, "b"), "b", intervals._levels(intervals._own_bin(whole, "a")), True)
    assert asked.groupBy("b_start").count().agg(F.max("count")).first()[0] <= 3


CASES = [  # cigar, md, sequence, mismatches, inserts, left, right, reference
    ("8M", "8", "ACGTACGT", [], "", "", "", "ACGTACGT"),
    ("8M", "3A4", "ACGGACGT", [(3, "G")], "", "", "", "ACGAACGT"),
    ("3M2I3M", "6", "ACGTTTAC", [], "TT", "", "", "ACGTAC"),
    ("3M2D3M", "3^TT3", "ACGACG", [], "", "", "", "ACGTTACG"),
    ("3M1D3M", "3^T0C2", "ACGGCG", [(3, "G")], "", "", "", "ACGTCCG"),
    ("2S4M2S", "4", "TTACGTGG", [], "", "TT", "GG", "ACGT"),
    ("5H4M", "4", "ACGT", [], "", "", "", "ACGT"),
    ("3H2S4M", "4", "TTACGT", [], "", "TT", "", "ACGT"),
    ("3M10N3M", "6", "ACGACG", [], "", "", "", "ACG" + "T" * 10 + "ACG"),
    ("2=1X2=", "2A2", "ACNGT", [(2, "N")], "", "", "", "ACAGT"),
    ("2M1I1D2M", "2^C2", "ACGGT", [], "G", "", "", "ACCGT"),
]


def read_of(cigar, reference, mismatches, inserts, left, right):
    """(sequence, MD) by walking the CIGAR base by base."""
    seq, md, equal, at, used, begun = "", "", 0, 0, 0, False
    changed = {}
    for spot, base in sorted(mismatches):
        changed.setdefault(spot, base)
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        n = int(n)
        if op == "S":
            seq += (right if begun else left)[:n]
        elif op == "I":
            seq += inserts[used : used + n]
            used += n
        elif op == "D":
            md += f"{equal}^{reference[at : at + n]}"
            equal = 0
        elif op in "M=X":
            for own in reference[at : at + n]:
                base = changed.get(len(seq), own)
                seq += base
                if base == own:
                    equal += 1
                else:
                    md += f"{equal}{own}"
                    equal = 0
        if op in "M=XDN":
            at += n
        begun |= op in "MIDN=X"
    return seq, md + str(equal)


def _rebuilt(rows):
    import pyarrow as pa

    mm = pa.list_(pa.struct([("at", pa.int32()), ("base", pa.string())]))
    columns = list(zip(*rows))
    columns[2] = [None if x is None else [{"at": a, "base": b} for a, b in x] for x in columns[2]]
    batch = pa.RecordBatch.from_arrays([pa.array(c, mm if i == 2 else pa.string()) for i, c in enumerate(columns)], rebuild.PARTS)
    return list(zip(*(x.to_pylist() for x in rebuild.read_and_md(batch))))


def test_rebuild_of_a_batch_equals_the_walk():
    rng, rows = random.Random(11), []
    bases = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    for _ in range(3000):
        ops = [(rng.choice([1, 2, 9, 120]), rng.choice("MMM=XIDN")) for _ in range(rng.randint(0, 6))]
        ends = [[(rng.randint(1, 5), "H")] * (rng.random() < 0.2) + [(rng.randint(1, 5), "S")] * (rng.random() < 0.3) for _ in range(2)]
        ops = ends[0] + ops + ends[1][::-1]
        size = lambda some: sum(n for n, op in ops if op in some)
        read = size("M=XIS")
        mm = [(rng.randrange(read), rng.choice("ACGTN")) for _ in range(rng.choice([0, 0, 1, 4]))] if read else []
        soft = [n for n, op in ops if op == "S"]
        rows.append(("".join(f"{n}{op}" for n, op in ops) or rng.choice(["*", ""]), bases(size("M=XDN") + rng.choice([0, 3])), mm or rng.choice([[], None]), bases(size("I")) or None, bases(max(soft, default=0)), bases(max(soft, default=0))))
    want = [read_of(c, r, m or [], i or "", a, b) for c, r, m, i, a, b in rows]
    assert _rebuilt(rows) == want
    assert _rebuilt(rows[:1]) == want[:1]
    with pytest.raises(ValueError, match="more bases"):
        _rebuilt([("9M", "ACGT", [], "", "", "")])


@pytest.mark.parametrize("case", CASES)
def test_rebuild(case):
    cigar, md, seq, mm, ins, left, right, ref = case
    assert read_of(cigar, ref, mm, ins, left, right) == (seq, md) and _rebuilt([(cigar, ref, mm, ins, left, right)]) == [(seq, md)]


def test_md_grammar(spark):
    for md, want in (("10A21", [(10, "A")]), ("10^ACG22", []), ("10^A0C21", [(10, "C")]), ("5A26", [(5, "A")]), ("0T0G1", [(0, "T"), (1, "G")])):
        got = one(spark, edits.md_mismatches(F.col("md")), md=md)
        assert [(x["at"], x["base"]) for x in got] == want


def test_merge_keeps_first_list_on_ties(spark):
    df = spark.sql("SELECT array(named_struct('at', 3, 'base', 'I'), named_struct('at', 9, 'base', 'D')) AS a, array(named_struct('at', 3, 'base', 'C'), named_struct('at', 1, 'base', 'T')) AS b")
    got = df.select(edits.merge(F.col("a"), F.col("b")).alias("m")).first()["m"]
    assert [(x["at"], x["base"]) for x in got] == [(1, "T"), (3, "I"), (3, "C"), (9, "D")]


def _trim_by_hand(qual, mode, least=8):
    """(prefix, core, suffix) from the pairs of neighbours with the mode."""
    n = len(qual)
    pairs = [i for i in range(n - 1) if mode in qual[i : i + 2]]
    head = pairs[0] + 1 if pairs else max(0, n - 1)
    last = max([i + 1 for i in pairs if i + 1 > head], default=min(head + 1, n - 1))
    start = head if head >= least else 0
    stop = max(start, last if n - last >= least else n)
    return qual[:start], qual[start:stop], qual[stop:]


def test_trim_and_mode_runs(spark):
    rng = random.Random(4)
    made = [("".join(rng.choice("II1J\\9abc") for _ in range(rng.choice([0, 1, 2, 5, 12, 30]))), rng.choice("IJ1")) for _ in range(400)]
    made += [("aaaaaaaaaaaIIIbbbbbbbbbbbbbb", "I"), ("abcdefghijkl", "I"), ("Iaaaaaaaaaaaaaaaa", "I"), ("aaaaaaaaaaaaaaaaI", "I")]
    df = spark.createDataFrame([(i, q, m) for i, (q, m) in enumerate(made)], "aln_idx long, qual string, mode string")
    split = quality.split_strings(df)
    for r in split.collect():
        assert (r["prefix"], r["core"], r["suffix"]) == _trim_by_hand(*made[r["aln_idx"]]), made[r["aln_idx"]]
    assert {r["aln_idx"]: r["qual"] for r in quality.restore_strings(split).collect()} == {i: q for i, (q, _) in enumerate(made)}


def test_long_clips_and_runs(spark):
    seq = "A" * 12_000 + "C" * 20 + "G" * 15_000
    df = spark.createDataFrame([("12000S20M15000S", seq)], "cigar string, seq string")
    got = edits.soft_clips(df).first()
    assert (got["left_clip"], got["right_clip"]) == ("A" * 12_000, "G" * 15_000)
    each = spark.createDataFrame([(0, 1, "I", 10, i) for i in range(1500)] + [(0, 2, "D", 1510, i) for i in range(3)], "aln_idx long, ord int, op string, at int, i int")
    assert sorted(map(tuple, edits.indel_runs(each, ["ord", "i"]).collect())) == [(0, 1, "I", 10, 1500), (0, 2, "D", 1510, 3)]


def test_weighted_mode_by_hand(spark):
    rng = random.Random(9)
    made = ["", " ", "  !", "~~~", "z"] + ["".join(chr(rng.randint(32, rng.choice([40, 126]))) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    got = spark.createDataFrame([(i, q) for i, q in enumerate(made)], "i int, q string").select("i", sq.weighted_mode(F.col("q")).alias("w")).collect()
    for r in got:
        mode, frequency = -1, 0
        for c in range(90):
            n = made[r["i"]].count(chr(c + 32))
            if c * n >= frequency * 10:
                mode, frequency = c, n
        assert (r["w"]["mode"], r["w"]["frequency"]) == (chr(mode + 32), frequency), made[r["i"]]


@pytest.fixture
def many_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    for k, v in zip(old, ("false", "23", "7")):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_carries_reach_over_ranges_and_batches(spark, many_ranges):
    rng = random.Random(5)
    data = [(rng.choice([0, 0, 0, 1]), rng.choice([3, 3, 3, 4, 50]), i, rng.randint(-5, 5)) for i in range(400)]  # one deep position
    df = spark.createDataFrame(data, "k int, a int, b int, x int")
    out = ordered.running_sum(ordered.previous(df, ["k"], ["a", "b"], "x", "before"), ["k"], ["a", "b"], F.col("x"), "total")
    out = ordered.latest(out.withColumn("some", F.when(F.col("b") % 70 == 0, F.col("x"))), ["k"], ["a", "b"], "some", "last")
    got = {r["b"]: (r["before"], r["total"], r["last"]) for r in out.collect()}
    for k in range(2):
        before, total, last = None, 0, None
        for _, a, b, x in sorted(d for d in data if d[0] == k):
            total, last = total + x, x if b % 70 == 0 else last
            assert got[b] == (before, total, last)
            before = x


def _greedy_by_hand(strings, share):
    """Cores of the leaders with more than ``share`` of all strings, one string after another."""
    made = []
    for qual in strings:
        weights = [(c, qual.count(chr(c + 32))) for c in range(90)]
        mode, frequency = -1, 0
        for c, n in weights:
            if c * n >= frequency * 10:
                mode, frequency = c, n
        if frequency * 100 < len(qual) * 26:
            continue
        core = _trim_by_hand(qual, chr(mode + 32))[1]
        if len(core) < 4:
            continue
        own = Counter(core[i : i + 4] for i in range(len(core) - 3))
        for one in made:
            d2 = sum((own[k] / own.total() - one[0][k] / one[0].total()) ** 2 for k in own.keys() | one[0].keys())
            if round(d2, 9) < 0.05:
                one[1] += 1
                break
        else:
            made.append([own, 1, core])
    return [m[2] for m in made if m[1] > share * len(strings)]


def _quality_strings():
    rng = random.Random(6)
    some = lambda n, chars: ["".join(rng.choice(chars) for _ in range(32)) for _ in range(n)]
    mixed = some(1100, "IIIIIIIIIIIIHFDB") + some(900, "!#%+5:?@ABCDEFGH")  # the second kind goes to the pile, mostly
    rng.shuffle(mixed)
    # two kinds that begin after row 2,000; the last one has over 5 % of the strings outside the pile, but not of all
    late = ["F" * 30 + rng.choice(["HH", "HF", "FH"]) for _ in range(400)] + ["5" * 29 + "HFH"] * 115
    return mixed + late


def test_leaders_equal_greedy_by_hand(spark):
    strings = _quality_strings()
    frame = spark.createDataFrame([(i * 3, q) for i, q in enumerate(strings)], "aln_idx long, qual string").repartition(5)
    got = [r["qual"] for r in quality.leaders_of(frame).orderBy("leader").collect()]
    assert got == _greedy_by_hand(strings, 0.05)
    assert any(q.count("F") > 20 for q in got) and not any("5" * 20 in q for q in got)
    assert [r["qual"] for r in quality.leaders_of(frame, sample=700).orderBy("leader").collect()] == _greedy_by_hand(strings[:700], 0.05)
    for share, block, sample in ((0.05, 7, 10**6), (0.01, 50, 10**6), (0.002, 30, 300)):  # leaders come from many blocks
        got = [r["qual"] for r in quality.leaders_of(frame, sample, share, block).orderBy("leader").collect()]
        assert got == _greedy_by_hand(strings[:sample], share)
    assert quality.leaders_of(frame.limit(0)).isEmpty()
    assert quality.leaders_of(frame.withColumn("qual", F.lit("!#%+5:?@ABCDEFGH"))).isEmpty()  # all in the pile


def test_sam_round_trip(spark, tmp_path):
    header = "@HD\tVN:1.0\n@SQ\tSN:chrX\tLN:100\n@SQ\tSN:chr 2\tLN:50\n"
    lines = ["r1\t0\tchrX\t1\t60\t4M\t=\t11\t14\tACGT\tIIII\tMD:Z:4\tXS:i:3\tXS:A:c", "r2\t16\tchrX\t5\t60\t4M\t*\t0\t0\tACNT\tIIII\tMD:Z:2G1", "r3\t0\tchr 2\t7\t9\t4M\tchrX\t3\t0\tACGT\t!!!!\tMD:Z:4", "r4\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t!!!!"]
    (tmp_path / "a.sam").write_text(header + "\n".join(lines) + "\n")
    refs = sam.read_header(spark, str(tmp_path / "a.sam"))
    assert [tuple(r) for r in refs.collect()] == [(0, "chrX", 100), (1, "chr 2", 50)]
    rows = sam.read(spark, str(tmp_path / "a.sam"))
    assert [tuple(t) for t in rows.where("qname = 'r1'").first()["opt"]] == [("MD", "Z", "4"), ("XS", "i", "3"), ("XS", "A", "c")]
    assert rows.where("qname = 'r4'").first()["ref_id"] == -1
    sam.write(rows, refs, str(tmp_path / "out"), version="1.0")
    back = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(back) == sorted([*header.replace("VN:1.0", "VN:1.0\tSO:coordinate").strip().split("\n"), *lines])
    first = sorted((tmp_path / "out").glob("part-00000*"))[0].read_text().split("\n")
    assert first[0].startswith("@HD") and sam.read_version(spark, str(tmp_path / "out")) == "1.0"
    fq = sam.unaligned_fastq(spark.createDataFrame([("u", 4, "AC", "II"), ("v", 0, "AC", "II")], "qname string, flag int, seq string, qual string"))
    assert [r["value"] for r in fq.collect()] == ["@u\nAC\n+\nII"]


def test_fasta_and_index(spark, tmp_path):
    path = str(tmp_path / "a.fa")
    (tmp_path / "a.fa").write_text(">c1 first\nACGT\nAC\n>c2\nGGGG\n")
    assert sorted(map(tuple, fasta.read(spark, path).collect())) == [("c1", 6, "ACGTAC"), ("c2", 4, "GGGG")]
    index = [tuple(r) for r in fasta.index(spark, path).drop("file").collect()]
    assert index == [("c1", 6, 10, 4, 5), ("c2", 4, 22, 4, 5)]
    fasta.write_fai(fasta.index(spark, path), str(tmp_path / "fai"))
    assert sorted(map(tuple, fasta.read_fai(spark, str(tmp_path / "fai")).collect())) == sorted(index)
    assert [tuple(r) for r in fasta.load(spark, str(tmp_path / "fai"), path).where("name = 'c1'").select("name", "length", "seq").collect()] == [("c1", 6, "ACGTAC")]
    (tmp_path / "b.fa").write_bytes(b">a\r\nACGT\r\n>b\r\nGG\r\nGG\r\nG")
    assert [tuple(r) for r in fasta.index(spark, str(tmp_path / "b.fa")).drop("file").collect()] == [("a", 4, 4, 4, 6), ("b", 5, 14, 2, 4)]
    (tmp_path / "c.fq").write_text("@r1 x\nAC\n+\n@I\n@r2\nGT\n+r2\nII\n")
    assert sorted(map(tuple, fasta.read_fastq(spark, str(tmp_path / "c.fq")).collect())) == [("r1", "AC", "@I"), ("r2", "GT", "II")]


def test_difference_is_exact_and_equal_tables_move_digests_only(spark):
    rng = random.Random(6)
    row = lambda: (rng.choice([None, 1, 2, 3]), rng.choice([None, "", "x", "y"]), rng.choice([None, 0.5]))
    a = [row() for _ in range(500)]
    b = [r for i, r in enumerate(a) if i % 50] + [row() for _ in range(9)] + [(None, "only in b", None)] * 3
    frame = lambda rows: spark.createDataFrame(rows, "k int, s string, `a.b` double")
    want, (x, y) = {}, (Counter(a), Counter(b))
    for r in {*x, *y}:
        if x[r] != y[r]:
            want[r] = (max(x[r] - y[r], 0), max(y[r] - x[r], 0))
    for buckets in (1, 7, 4096):
        assert {tuple(r)[:3]: tuple(r)[3:] for r in compare.difference(frame(a), frame(b), buckets).collect()} == want
    rng.shuffle(a)
    assert compare.difference(frame(a), frame(a[::-1])).isEmpty()
    assert compare.difference(frame([]), frame([])).isEmpty()
    swapped = frame([(None, "x", None), (1, None, None)]), frame([(1, "x", None), (None, None, None)])  # nulls change places
    assert compare.difference(*swapped).count() == 4


def test_logs(spark, tmp_path):
    (tmp_path / "sizes").write_text("# SAM\n100 a/x.sam\n# tool\n10 a/x.offs.lz\n7 a/x.ids.lz\n")
    assert [tuple(r) for r in logs.sizes(spark, str(tmp_path / "sizes")).orderBy("bytes").collect()] == [("tool", 7, "a/x.ids.lz"), ("tool", 10, "a/x.offs.lz"), ("SAM", 100, "a/x.sam")]
    (tmp_path / "rates").write_text("*** S1 z=0.9\nedits: 5\n10 a\n20 b\n*** S1 z=0.8\nEdits: 7\n1 a\n")
    assert sorted(map(tuple, logs.error_rates(spark, str(tmp_path / "rates")).collect())) == [("S1", 0.8, 7, 1), ("S1", 0.9, 5, 30)]
    (tmp_path / "time").write_text("x\n  Elapsed (wall clock) time (h:mm:ss or m:ss): 1:02:03.5\n")
    assert logs.elapsed(spark, str(tmp_path / "time")).first()["seconds"] == 3723.5
    (tmp_path / "lengths").write_text("f1\n40\n100\nf2\n8\n51\n")
    assert sorted(map(tuple, logs.read_lengths(spark, str(tmp_path / "lengths")).collect())) == [("f1", 40, 100), ("f2", 8, 51)]


def test_texts(spark):
    assert one(spark, tx.binary_size(F.col("n")), n=2048) == "2.00 KiB"
    assert one(spark, tx.duration(F.col("n")), n=59) == "0059s" and one(spark, tx.duration(F.col("n")), n=3661) == "1h1m1s"


def test_streaming_depth(spark, tmp_path):
    rows = [(0, 10, 0), (0, 2000, 0), (1, 5, 4), (0, 12, 0)]
    spark.createDataFrame(rows, "ref_id int, pos int, flag int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ref_id int, pos int, flag int").parquet(str(tmp_path / "in"))
    q = offsets.running_depth(stream, 32).writeStream.outputMode("complete").format("memory").queryName("depth").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("depth").collect())) == [(0, 0, 2, 64), (0, 1, 1, 32)]


def test_empty_inputs(spark):
    none = views.aln(spark, SF).limit(0)
    for df in (coverage.depth(none, 32), encode.offset_runs(none), intervals.block_spans(none, 10), edits.cigar_ops(none)):
        assert df.isEmpty()


def test_distances_move_no_string(spark):
    """Every k-mer was a row that was shuffled."""
    import random
    from collections import Counter

    from alnspark.operators import quality

    rng = random.Random(8)
    texts = ["".join(rng.choice("IHFé") for _ in range(rng.choice([0, 3, 4, 9, 32]))) for _ in range(300)] + [None]
    strings = spark.createDataFrame(list(enumerate(texts)), "aln_idx long, qual string")
    leaders = spark.createDataFrame([(3, "IIIIHHHH"), (5, "III"), (9, "HIFHIFHIFH")], "leader int, qual string")
    found = quality.d2(strings, leaders)
    parts = lambda s: Counter(s[i : i + 4] for i in range(len(s) - 3))
    want = {}
    for i, s in enumerate(texts):
        for n, other in ((3, "IIIIHHHH"), (9, "HIFHIFHIFH")) if s and len(s) > 3 else ():
            x, y = parts(s), parts(other)
            want[i, n] = sum((x[k] / x.total() - y[k] / y.total()) ** 2 for k in x | y)
    got = {(r["aln_idx"], r["leader"]): r["d2"] for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    near = {r["aln_idx"]: r["cluster"] for r in quality.nearest(strings, leaders).collect()}
    assert near == {r["aln_idx"]: r["cluster"] for r in quality.assign(found).collect()}


@pytest.mark.parametrize("shift", [-1000, 2**40])
def test_totals_of_intervals_equal_grouped_pairs(spark, shift):
    rng = random.Random(8)
    length = lambda: rng.choice([0, 1, 31, 300, -4, -60, rng.randint(0, 2000)])  # noqa: E731  some end before they begin
    def some(n, p):
        rows = [(rng.choice([0, 1, 1, None]), i, s + shift, s + shift + length()) for i in range(n) for s in [rng.choice([5, 512, rng.randint(-30, 2000)])]]
        return spark.createDataFrame([*rows, *rows[:9], (1, n, None, 7), (1, n + 1, 7, None)], f"ref_id int, {p} long, {p}_start long, {p}_stop long")
    a, b = some(200, "a"), some(120, "b")
    base = a.join(b.distinct(), "ref_id")
    for pairs, totals in (("a_start <= b_stop AND a_stop >= b_start", intervals.overlap_totals), ("a_start >= b_start AND a_stop <= b_stop", intervals.contained_totals)):
        want = base.where(pairs).groupBy("b").agg(F.count("*"), F.sum("a"))
        got = totals(a, b.distinct(), "a").select("b", "n", "total")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
        assert totals(a, b, "a").count() == b.join(want, "b").count()
        assert totals(a.limit(0), b, "a").count() == totals(a, b.limit(0), "a").count() == 0


def test_totals_of_intervals_make_no_pairs(spark):
    n = 100_000  # 10**10 pairs
    a = spark.range(n).select(F.lit(0).alias("ref_id"), "id", (F.col("id") % 50).alias("a_start"), (F.col("id") % 50 + 60).alias("a_stop"))
    b = spark.range(n).select(F.lit(0).alias("ref_id"), F.col("id").alias("b"), F.lit(0).alias("b_start"), (F.col("id") + 200).alias("b_stop"))
    for totals in (intervals.overlap_totals, intervals.contained_totals):
        assert totals(a, b, "id").agg(F.count("*"), F.min("n"), F.max("n"), F.min("total"), F.max("total")).first()[:] == (n, n, n, n * (n - 1) // 2, n * (n - 1) // 2)
