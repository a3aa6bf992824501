"""Byte-range sources: order, pushed conditions, and how much is read."""

import random

import pytest

from alnspark.sources import fasta, ranges, sam


def test_lines_of_ranges_are_whole_and_once(tmp_path):
    rng = random.Random(2)
    for _ in range(30):
        lines = ["x" * rng.choice([0, 1, 7, 300]) for _ in range(rng.randint(0, 40))]
        data = ("\r\n" if rng.random() < 0.3 else "\n").join(lines).encode() + (b"\n" if rng.random() < 0.5 else b"")
        file = tmp_path / "a.txt"
        file.write_bytes(data)
        want, at = [], 0
        for line in data.split(b"\n"):
            want.append((at, line.removesuffix(b"\r")))
            at += len(line) + 1
        if not want[-1][1]:
            want.pop()
        step = rng.choice([1, 5, 100, 10**6])
        got = [x for k in range(0, max(len(data), 1), step) for x in ranges._lines(str(file), k, min(step, len(data) - k), len(data), chunk=rng.choice([1, 13, 1 << 20]))]
        assert [x for x in got if x[0] < len(data)] == want


def _folder(tmp_path):
    rng, want = random.Random(1), []
    (tmp_path / "_hidden").write_text("no alignment")
    for i, n in enumerate([3, 4000, 1, 900, 20]):
        lines = ["@HD\tVN:1.6", "@SQ\tSN:c1\tLN:9999", "@SQ\tSN:c2\tLN:9999"] if not i else []
        for k in range(n):
            row = (f"r{i}.{k}", rng.choice([0, 4, 16, 20]), f"c{rng.randint(1, 2)}", rng.randint(0, 5000), rng.randint(0, 60))
            want.append(row)
            lines.append("\t".join(map(str, [*row[:3], row[3] + 1, row[4], "4M", "=", 7, 0, "ACGT", "IIII", "MD:Z:4"])))
        (tmp_path / f"part-{i:02d}.sam").write_text("\n".join(lines) + "\n")
    return str(tmp_path), want


@pytest.mark.parametrize("size", [1 << 25, 5000])
def test_a_folder_of_mixed_sizes_comes_in_order(spark, tmp_path, size):
    path, want = _folder(tmp_path)
    rows = sam.scan(spark, path, partitionBytes=size).orderBy("aln_idx").collect()
    assert [(r["qname"], r["flag"], r["rname"], r["pos"], r["mapq"]) for r in rows] == want
    assert len({r["aln_idx"] for r in rows}) == len(want)
    assert [r["ref_id"] for r in sam.read_header(spark, path).collect()] == [0, 1]


def _plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_conditions_reach_the_scan(spark, tmp_path):
    path, want = _folder(tmp_path)
    found = sam.region(spark, path, "c2", 1000, 1500, required=16, excluded=4).where("mapq > 30")
    assert sorted(r["qname"] for r in found.collect()) == sorted(q for q, f, c, p, m in want if c == "c2" and 1000 <= p < 1500 and m > 30 and f == 16)
    plan = _plan(found)
    pushed = next(x for x in plan.split("\n") if x.startswith("PushedFilters"))
    assert all(x in pushed for x in ("EqualTo(rname,c2)", "GreaterThanOrEqual(pos,1000)", "LessThan(pos,1500)", "GreaterThan(mapq,30)"))
    assert next(x for x in plan.split("\n") if x.startswith("Condition")).count("AND") == 2  # only that there are values is left to Spark


def test_bytes_read_follow_the_entries(spark, tmp_path):
    rng = random.Random(5)
    texts = {f"f{k}": {f"{k}s{i}": "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 3, 60, 61, 5000]))) for i in range(40)} for k in range(2)}
    folder = tmp_path / "fa"
    folder.mkdir()
    for k, (file, own) in enumerate(texts.items()):
        end = "\r\n" if k else "\n"
        (folder / f"{file}.fa").write_bytes("".join(f">{n} x{end}" + "".join(s[i : i + 60] + end for i in range(0, len(s), 60)) for n, s in own.items()).encode())
    index = str(tmp_path / "index")
    fasta.write_index(fasta.index(spark, str(folder)), index)
    every = {n: s for own in texts.values() for n, s in own.items() if s}
    for options in ({}, {"pieceBytes": 100, "partitionBytes": 1000}):
        assert {r["name"]: r["seq"] for r in fasta.load(spark, index, **options).collect()} == every
    wanted = sorted(every)[:3]
    parts = fasta.pieces(spark, index, pieceBytes=100).where(f"name IN ({', '.join(map(repr, wanted))})")
    rows = parts.collect()
    assert {r["name"] for r in rows} == set(wanted)
    assert sum(r["bytes_read"] for r in rows) <= sum(len(every[n]) * 62 // 60 + 2 for n in wanted)
    one = fasta.load(spark, index).where(f"name = {wanted[0]!r}")  # through the grouping
    assert [r["seq"] for r in one.collect()] == [every[wanted[0]]]
    assert f"EqualTo(name,{wanted[0]})" in _plan(one)


def test_a_large_index_is_cut_by_the_tasks(spark, tmp_path):
    """The driver read and cut all of it."""
    seqs = {f"s{i}": "ACGT" * (1 + i % 40) for i in range(300)}
    (tmp_path / "a.fa").write_text("".join(f">{n}\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) for n, s in seqs.items()))
    index = str(tmp_path / "index")
    fasta.write_index(fasta.index(spark, str(tmp_path / "a.fa")), index)
    options = {"planBytes": 0, "indexBytes": 500, "pieceBytes": 70}
    planned = ranges.FastaReader({k.lower(): str(v) for k, v in options.items()} | {"index": index}).partitions()
    assert len(planned) > 10 and all(isinstance(p, ranges.IndexRange) and p.size <= 500 for p in planned)
    assert {r["name"]: r["seq"] for r in fasta.load(spark, index, **options).collect()} == seqs
    one = fasta.pieces(spark, index, **options).where("name = 's7'").collect()
    assert "".join(r["seq"] for r in sorted(one, key=lambda r: r["start"])) == seqs["s7"]


def test_batches_are_bounded_in_bytes(tmp_path):
    (tmp_path / "a").write_bytes(b"A" * (40 << 20))
    reader = ranges.FastaReader({"index": str(tmp_path)})
    part = ranges.Ranges([(str(tmp_path / "a"), k << 20, 1 << 20, "a", k << 20) for k in range(40)])
    sizes = [b.nbytes for b in reader.read(part)]
    assert len(sizes) == 10 and max(sizes) < 5 << 20


def test_pushed_names_pick_the_ranges():
    """The reader plans nothing but what is asked for."""
    from pyspark.sql.datasource import EqualTo, In, StringStartsWith

    reader = ranges.FastaReader({"index": __file__})
    left = list(reader.pushFilters([In(("name",), ("a", "b")), EqualTo(("file",), "f"), StringStartsWith(("name",), "a")]))
    assert left == [StringStartsWith(("name",), "a")]
    reader.entries = lambda: [e for e in [("f", "a", 10, 0, 5, 6), ("f", "c", 10, 50, 5, 6), ("g", "b", 10, 0, 5, 6)] if reader.passes(file=e[0], name=e[1])]
    assert [p.parts for p in reader.partitions()] == [[("f", 0, 11, "a", 0)]]
