"""Records over several lines and splits, against a plain reader of one line after the other."""

import random

import pytest

from alnspark.sources import fasta, records


def plain(text):
    """(name, seq, qual) by the line machine, without splits."""
    printed = lambda line: "".join(x for x in line if 32 < ord(x) < 127)
    out, head, seq, qual = [], None, "", None
    for line in text.split("\n"):
        if head is not None and qual is not None:
            if len(qual) < len(seq):
                qual += printed(line)
            if len(qual) >= len(seq):
                out.append((head, seq, qual[: len(seq)]))
                head = qual = None
                if line and seq == "" and line[0] in ">@":  # no qualities were wanted: the line is free
                    head = line[1:].split()[0] if line[1:].split() else ""
                    seq = ""
        elif line[:1] in (">", "@"):
            if head is not None:
                out.append((head, seq, None))
            head, seq, qual = (line[1:].split() or [""])[0], "", None
        elif head is not None and line[:1] == "+":
            qual = ""
        elif head is not None:
            seq += printed(line)
    if head is not None and qual is None:
        out.append((head, seq, None))
    return out


def random_text(rng, n):
    end, out = rng.choice(["\n", "\r\n"]), []
    wrap = lambda s, k: end.join(s[i : i + k] for i in range(0, len(s), k))
    for i in range(n):
        seq = "".join(rng.choice("ACGTN") for _ in range(rng.choice([1, 5, 30, 200])))
        note = rng.choice(["", " x->y @z", "\tlen=3 >"])
        if rng.random() < 0.6:
            qual = "".join(rng.choice("@+>!IIF") for _ in seq)
            out.append(f"@r{i}{note}{end}{wrap(seq, rng.choice([7, 60]))}{end}+{rng.choice(['', f'r{i}'])}{end}{wrap(qual, rng.choice([5, 11, 60]))}{end}")
        else:
            out.append(f">r{i}{note}{end}{wrap(seq, rng.choice([7, 60]))}{end}{rng.choice(['', end])}")
    return "".join(out)


def write(folder, **texts):
    folder.mkdir(exist_ok=True)
    for name, text in texts.items():
        (folder / f"{name}.txt").write_bytes(text.encode())
    return str(folder)


def got(spark, path):
    return sorted(((r["name"], r["seq"], r["qual"]) for r in records.read(spark, path).collect()), key=str)


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "331")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(2))
def test_any_layout_across_splits(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    texts = {f"f{i}": random_text(rng, 20) for i in range(3)}
    want = sorted((r for t in texts.values() for r in plain(t)), key=str)
    path = write(tmp_path / "x", **texts)
    assert got(spark, path) == want
    assert spark.read.text(path).rdd.getNumPartitions() > 20


CASES = {
    "header with marks": ">c1 x->y\nAC\nGT\n@r 1>2\nAC\n+\n@>\n",
    "qualities like headers": "@r1\nACGT\nACGT\n+r1\n@@@@\n+>@+\n@r2\nA\n+\n@\n",
    "carriage returns": "@r1\r\nAC\r\nGT\r\n+\r\nII\r\nII\r\n>c\r\nAC GT\r\n",
    "junk, no records": "junk\n\n+\nACGT\n",
    "too few qualities": "@r1\nACGT\n+\nII\n",
    "too many qualities": "@r1\nAC\n+\nIIII\n@r2\nA\n+\nI\n",
    "empty": "", "no bases": ">a\n>b\n\n>c\nAC", "no line end": ">a\nAC\nG",
}


@pytest.mark.parametrize("case", CASES)
def test_cases(spark, tmp_path, case):
    assert got(spark, write(tmp_path / "x", a=CASES[case])) == sorted(plain(CASES[case]), key=str)


def test_functions_compose(spark):
    """The function of a whole equals that of its parts, from every state."""
    import pyarrow as pa

    rng = random.Random(9)
    for _ in range(60):
        lines = random_text(rng, 6).encode().split(b"\n")[:-1]
        if rng.random() < 0.5:
            rng.shuffle(lines)
        cut = rng.randrange(len(lines) + 1)
        whole = records.Lines(0, pa.array(lines, pa.binary()))
        parts = [records.Lines(0, pa.array(lines[:cut], pa.binary())), records.Lines(int(whole.place[cut]) if cut < len(lines) else 10**6, pa.array(lines[cut:], pa.binary()))]
        for state in [(0, 0, 0), *((1, k, -7) for k in (0, 3, 50)), *((2, k, -7) for k in (1, 4, 30, 500))]:
            now = state
            for part in parts:
                now = records.state_after(part.function(), *now)
            assert now == records.state_after(whole.function(), *state)


def test_fasta_and_fastq(spark, tmp_path):
    path = write(tmp_path / "x", a=">c1 x->y\nAC\nGT\n@r1\nA\nC\n+\n@\nI\n")
    assert [tuple(r) for r in fasta.read(spark, path).collect()] == [("c1", 4, "ACGT")]
    assert [tuple(r) for r in fasta.read_fastq(spark, path).collect()] == [("r1", "AC", "@I")]


def test_index_across_splits(spark, tmp_path, small_splits):
    """Against a walk through the bytes."""
    rng = random.Random(3)
    want = []
    (tmp_path / "fa").mkdir()
    for k, end in enumerate(["\n", "\r\n"]):
        data = b"" if k else b"no record yet\n"
        for i in range(30):
            seq, head = "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 59, 60, 61, 700]))), f">s{k}.{i}{rng.choice(['', ' a > b'])}{end}"
            if seq:
                want.append((f"s{k}.{i}", len(seq), len(data) + len(head), min(60, len(seq)), min(60, len(seq)) + len(end), f"f{k}.fa"))
            data += (head + "".join(seq[j : j + 60] + end for j in range(0, len(seq), 60))).encode()
        (tmp_path / "fa" / f"f{k}.fa").write_bytes(data)
    got = [(*tuple(r)[:5], r["file"].rsplit("/", 1)[1]) for r in fasta.index(spark, str(tmp_path / "fa")).collect()]
    assert got == want


def test_blocks_of_a_split_are_bounded_and_compose(spark):
    """A task held the whole split, at some 20 bytes of memory a byte."""
    import pyarrow as pa

    rng = random.Random(12)
    for _ in range(40):
        lines = random_text(rng, 12).encode().split(b"\n")[:-1]
        step = rng.choice([1, 7, 1000])
        parts = [lines[i : i + step] for i in range(0, len(lines), step)]
        batches = [pa.RecordBatch.from_pydict({"file": ["f"] * len(x), "split": pa.array([5] * len(x), pa.int64()), "value": [y.decode() for y in x]}) for x in parts]
        whole, now, got, many = records.Lines(5, pa.array(lines, pa.binary())), (0, 0, 0), [], 0
        for file, split, ahead, first, values in records.blocks(iter(batches), 120):
            assert (file, split, first.num_rows) == ("f", 5, 1) and ahead == sum(len(x) + 1 for x in got)
            own = values.to_pylist()
            assert len(own) == 1 or sum(len(x) + 1 for x in own[:-1]) <= 120
            now, got, many = records.state_after(records.Lines(split + ahead, values).function(), *now), got + own, many + 1
        assert got == lines and many > 2
        assert now == records.state_after(whole.function(), 0, 0, 0)


def test_many_blocks_a_split(spark, tmp_path):
    text = "".join(f"@r{i}\nACGT\nAC\n+\n@>+I\nII\n>c{i} x\nAC\nGT\n" for i in range(150_000))
    path = write(tmp_path / "x", a=text)
    found = records.read(spark, path).groupBy("comment", "seq", "qual").count().collect()
    assert sorted((r["seq"], r["qual"], r["count"]) for r in found) == [("ACGT", None, 150_000), ("ACGTAC", "@>+III", 150_000)]
    assert len(text) > 2 * records.BLOCK_BYTES
    assert fasta.index(spark, write(tmp_path / "y", a=text.replace("@", "N").replace("+", "N"))).count() == 150_000
