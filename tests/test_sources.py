import gzip
import struct

import pytest
from pyspark.sql import functions as F

from clonalis.functions import alignments as al
from clonalis.operators import cells as cl
from clonalis.plans import pipelines
from clonalis.sources import alignment_files as af
from clonalis.sources import dataset, layouts, lists, sinks

#: (position 1-based, CIGAR, sequence, tags)
READS = [
    (95, "20M", "ACGTACGTACGTACGTACGT", "CB:Z:C1-1\tUB:Z:U1"),
    (100, "5M15S", "AAAAACCCCCGGGGGTTTTT", "CB:Z:C1-1\tUB:Z:U2"),
    (106, "8S12M", "AAAACCCCGGGGTTTTACGT", "CB:Z:C2-1\tUB:Z:U1"),
    (98, "5M3I6M", "ACGTACCCGTACGT", "CB:Z:C2-1\tUB:Z:U2"),
    (98, "6M4D6M", "ACGTACGTACGT", "CB:Z:C2-1\tUB:Z:U3"),
    (90, "5M20N5M", "ACGTACGTAC", "CB:Z:C3-1\tUB:Z:U4"),
    (101, "4=1X5=", "ACGTACGTAC", "CB:Z:C3-1\tUB:Z:U5\tNM:i:1"),
    (101, "3H10M2H", "ACGTACGTAC", "CB:Z:C3-1\tUB:Z:"),
    (101, "10M", "ACGTACGTAC", "CB:Z:C3-1"),
    (101, "10M", "ACGTACGTAC", "UB:Z:U9"),
    (300, "10M", "ACGTACGTAC", "CB:Z:C3-1\tUB:Z:U9"),
]
SPAN = (100, 110)  # 0-based, half-open


def walk(pos, cigar, seq):
    """(read position, reference position) pairs, base by base."""
    q, r, out = 0, pos, []
    for n, op in al.operations(cigar):
        for _ in range(n):
            if op in "M=X":
                out.append((q, r))
                q, r = q + 1, r + 1
            elif op in "DN":
                out.append((None, r))
                r += 1
            elif op in "IS":
                out.append((q, None))
                q += 1
    return out


def plain_project(pos, cigar, seq, start, end):
    ops = [x for x in al.operations(cigar) if x[1] != "H"]
    left = ops[0][0] if ops[0][1] == "S" else 0
    right = len(seq) - (ops[-1][0] if ops[-1][1] == "S" else 0)
    out, bases = ["-"] * (end - start), 0
    for q, r in walk(pos, cigar, seq):
        if r is None:
            r = pos + al.reference_length(cigar) + q - right if q >= right else pos - (left - q) if q < left else None
        if r is not None and start <= r < end:
            out[r - start] = "0" if q is None else seq[q]
            bases += q is not None
    return "".join(out) if bases else None


@pytest.mark.parametrize("read", READS)
def test_projection(read):
    pos, cigar, seq, _ = read
    for start, end in (SPAN, (95, 125), (104, 106), (0, 400)):
        assert al.project(pos - 1, cigar, seq, start, end) == plain_project(pos - 1, cigar, seq, start, end)


def test_projection_without_bases():
    assert al.project(0, "*", "ACGT", 0, 4) is None and al.project(0, "4M", "*", 0, 4) is None and al.project(0, "4S", "ACGT", 0, 4) is None


def sam_file(folder):
    path = folder / "x.sam"
    lines = ["@HD\tVN:1.6", "@SQ\tSN:other\tLN:500", "@SQ\tSN:chrX\tLN:500"]
    lines += [f"r{i}\t0\tchrX\t{p}\t60\t{c}\t*\t0\t0\t{s}\t{'I' * len(s)}\t{t}" for i, (p, c, s, t) in enumerate(READS)]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def bam_file(folder):
    def bgzf(data):
        return gzip.compress(data)

    refs = [("other", 500), ("chrX", 500)]
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(refs)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", ln) for n, ln in refs)
    body = b""
    for i, (p, c, s, tags) in enumerate(READS):
        ops = al.operations(c)
        packed = bytes(af._BASES.index(s[k]) << 4 | (af._BASES.index(s[k + 1]) if k + 1 < len(s) else 0) for k in range(0, len(s), 2))
        extra = b"XBBC" + struct.pack("<i", 3) + b"abc" + b"XFf" + struct.pack("<f", 1.5) + b"XAAz"
        for t in tags.split("\t"):
            name, kind, value = t.split(":", 2)
            extra += name.encode() + (b"Z" + value.encode() + b"\0" if kind == "Z" else b"i" + struct.pack("<i", int(value)))
        name = f"r{i}".encode() + b"\0"
        row = struct.pack("<2i2B3H4i", 1, p - 1, len(name), 60, 0, len(ops), 0, len(s), -1, -1, 0) + name + struct.pack(f"<{len(ops)}I", *(n << 4 | af._CIGAR.index(o) for n, o in ops)) + packed + b"\xff" * len(s) + extra
        body += struct.pack("<i", len(row)) + row
    path = folder / "x.bam"
    half = len(body) // 2
    path.write_bytes(bgzf(head + body[:half]) + bgzf(body[half:]) + bgzf(b""))
    return str(path)


def test_both_formats_give_the_same_table(spark, tmp_path):
    sam, bam = af.read_sam(spark, sam_file(tmp_path)), af.read_bam(spark, bam_file(tmp_path))
    key = lambda r: (r.pos, r.cigar, r.seq, sorted(r.tags.items()))
    clean = lambda rows: sorted(key(r) for r in rows)
    got = [(p, c, s, [t for t in tags if t[0] in ("CB", "UB")]) for p, c, s, tags in clean(bam.collect())]
    assert got == clean(sam.collect()) and len(got) == len(READS)
    assert af.bam_references(spark, str(tmp_path / "x.bam")) == [("other", 500), ("chrX", 500)]


def test_usable_reads(spark, tmp_path):
    table = af.read_sam(spark, sam_file(tmp_path))
    reads, counters = al.read_alignments(table, "chrX", *SPAN)
    want = []
    for p, c, s, t in READS[:7]:
        tags = dict((x[:2], x[5:]) for x in t.split("\t"))
        clone = plain_project(p - 1, c, s, *SPAN)
        if clone:
            want.append((tags["CB"][:-2], tags["UB"], clone))
    assert sorted(tuple(r) for r in reads.collect()) == sorted(want)
    assert tuple(counters.first()) == (1, 2)
    allowed = spark.createDataFrame([("C1-1",)], "cell_id string")
    assert {r.cell_id for r in al.read_alignments(table, "chrX", *SPAN, allowed=allowed)[0].collect()} == {"C1"}
    loose, _ = al.read_alignments(table.withColumn("tags", F.map_from_arrays(F.array(F.lit("BC")), F.array(F.lit("K")))), "chrX", *SPAN, require_umis=False, cell_id_tag="BC")
    assert {(r.cell_id, r.umi) for r in loose.collect()} == {("K", None)}
    with pytest.raises(Exception, match="-1"):
        al.read_alignments(table.withColumn("tags", F.map_from_arrays(F.array(F.lit("CB"), F.lit("UB")), F.array(F.lit("K"), F.lit("U")))), "chrX", *SPAN)[0].collect()


def test_detection(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        barcode = "".join(rng.choice(list("ACGT"), 12))
        rows.append(("c", 70, "30M", "A" * 30, 0, {}))
        rows.append(("c", 80, "20M6S", "A" * 20 + barcode[:6], 0, {}))
        rows.append(("c", 90, "30M", "A" * 10 + barcode + "G" * 8, 0, {}))
    d = spark.createDataFrame(rows, "rname string, pos long, cigar string, seq string, flag int, tags map<string,string>")
    assert al.detect_span(d, "c", 500) == (100, 112)
    with pytest.raises(ValueError):
        al.detect_span(d, "c", 90)


def test_lists_and_layouts(spark, tmp_path):
    (tmp_path / "allowed.tsv").write_text("0\tC1\n1\tC2\n")
    (tmp_path / "bad.tsv").write_text("0\tC1-1\n")
    (tmp_path / "ex.csv").write_text("ACGT\nAC--\n")
    with gzip.open(tmp_path / "b.tsv.gz", "wt") as f:
        f.write("C1-1\nC2-1\n")
    assert {r[0] for r in lists.read_allowed_cells(spark, str(tmp_path / "allowed.tsv")).collect()} == {"C1", "C2"}
    with pytest.raises(Exception, match="-1"):
        lists.read_allowed_cells(spark, str(tmp_path / "bad.tsv")).collect()
    assert {r[0] for r in lists.read_excluded_clone_ids(spark, str(tmp_path / "ex.csv")).collect()} == {"ACGT", "AC--"}
    assert {r[0] for r in lists.read_barcodes(spark, str(tmp_path / "b.tsv.gz")).collect()} == {"C1-1", "C2-1"}
    with pytest.raises(layouts.LayoutError):
        layouts.find_cellranger(str(tmp_path))
    (tmp_path / "outs/filtered_gene_bc_matrices/g").mkdir(parents=True)
    assert layouts.find_cellranger(str(tmp_path)).barcodes.endswith("g/barcodes.tsv")
    (tmp_path / "y.bam").touch()
    assert layouts.find_bams(str(tmp_path), "BC") == [str(tmp_path / "y.bam")] and layouts.find_bams(str(tmp_path), "CB") == [str(tmp_path)]


def run_reads(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    ids = ["".join(rng.choice(list("ACGT"), 30)) for _ in range(4)]
    rows = []
    for cell in range(12):
        for k in (cell % 4, (cell + 1) % 4):
            for u in range(3):
                for _ in range(2):
                    s = list(ids[k])
                    if rng.random() < 0.2:
                        s[rng.integers(30)] = "ACGT"[rng.integers(4)]
                    rows.append((f"C{cell:02d}", f"U{k}{u}", "".join(s)))
    return spark.createDataFrame(rows, "cell_id string, umi string, clone_id string")


def test_runs_and_files(spark, tmp_path):
    reads = run_reads(spark)
    found = pipelines.run_10x(reads, excluded=spark.createDataFrame([("T" * 30,)], "clone_id string"))
    assert sum(1 for _ in found["clones"].collect()) == 12
    sinks.write_outputs(str(tmp_path / "a"), found, True, "umi_count_matrix.csv", spark.createDataFrame([("C00",)], "cell_id string"))
    back = lists.read_cells(spark, str(tmp_path / "a/cells_filtered.txt"))
    own = {(r.cell_id, r.clone_id, r["count"]) for r in found["cells_filtered"].collect()}
    assert {(r.cell_id, r.clone_id, r["count"]) for r in back.collect()} == own
    assert {(r.cell_id, r.clone_id, r["count"]) for r in lists.read_count_matrix(spark, str(tmp_path / "a/umi_count_matrix.csv")).collect()} == own
    assert {tuple(r) for r in lists.read_clones(spark, str(tmp_path / "a/clones.txt")).collect()} == {tuple(r) for r in found["clones"].collect()}
    assert lists.read_molecules(spark, str(tmp_path / "a/molecules.txt")).count() == found["molecules"].count()
    sinks.write_dot(str(tmp_path / "g.gv"), found["graph"])
    assert (tmp_path / "g.gv").read_text().startswith("graph g {")
    assert len(found["doublets"]) == 2
    three = pipelines.run_smartseq3(reads)
    two = pipelines.run_smartseq2(reads, readcount_threshold=1)
    assert three["clones"].count() == 12 and two["clones"].count() == 12
    tables = pipelines.quality_tables(found["reads"], found["molecules"], found["molecules_corrected"], found["cells"], found["cells_filtered"], found["clones"])
    assert all(t.count() > 0 for t in tables.values())
    wide = sinks.barcode_attributes(found["cells_filtered"], spark.createDataFrame([("C00-1",), ("ZZ-1",)], "cell_id string"))
    assert {r.cell_id: r.cloneid_count_1 > 0 for r in wide.collect()} == {"C00": True, "ZZ": False}


def test_samples(spark):
    a = spark.createDataFrame([("C", "U", "ACGT")], "cell_id string, umi string, clone_id string")
    assert [r.cell_id for r in dataset.merge_samples([a, a], ["x", "y"]).collect()] == ["C_x", "C_y"]
    assert [r.cell_id for r in dataset.merge_samples([a, a], ["x", "y"], prefix=True).collect()] == ["x_C", "y_C"]
    with pytest.raises(ValueError):
        dataset.merge_samples([a, a], ["x", "x"])
    assert cl.count_matrix(spark.createDataFrame([("a", "x", 2, 1), ("b", "y", 1, 1)], "cell_id string, clone_id string, count long, ord long")).count() == 2


def test_command_line(spark, tmp_path, capsys):
    from clonalis import __main__ as cli

    a = cli.parser().parse_args(["run10x", sam_file(tmp_path), "--chr", "chrX", "-s", "101", "-e", "110", "--min-length", "5", "--keep-single-reads", "--keep-cross-contamination", "-o", str(tmp_path / "out")])
    cli.run(spark, a)
    assert (tmp_path / "out/clones.txt").read_text().startswith("clone_nr\tcell_id\n")
    with pytest.raises(cli.CommandError):
        cli.run(spark, a)
    cli.quality(spark, cli.parser().parse_args(["qc", str(tmp_path / "out")]))
    assert (tmp_path / "out/quality/clone_sizes").is_dir()


def test_bam_run_keeps_its_alignments_and_logs(spark, tmp_path):
    from clonalis import __main__ as cli

    args = ["--chr", "chrX", "-s", "101", "-e", "110", "--min-length", "5", "--keep-single-reads", "--keep-cross-contamination"]
    (tmp_path / "s").mkdir()
    cli.run(spark, cli.parser().parse_args(["run10x", sam_file(tmp_path / "s"), *args, "-o", str(tmp_path / "sam")]))
    cli.run(spark, cli.parser().parse_args(["run10x", bam_file(tmp_path / "s"), *args, "-o", str(tmp_path / "bam"), "--umi-matrix"]))
    for name in ("reads.txt", "molecules.txt", "cells.txt", "clones.txt"):
        assert (tmp_path / "sam" / name).read_text() == (tmp_path / "bam" / name).read_text()
    assert not (tmp_path / "sam/entries.bam").exists()
    back, _ = al.read_alignments(af.read_bam(spark, str(tmp_path / "bam/entries.bam")), "chrX", *SPAN)
    n = len((tmp_path / "bam/reads.txt").read_text().splitlines()) - 1
    assert back.count() == n == af.read_bam(spark, str(tmp_path / "bam/entries.bam")).count()
    lines = (tmp_path / "bam/log.txt").read_text().splitlines()
    assert lines[0].startswith("Reading cloneIDs from chrX:101-110 in ") and lines[1] == f"Found {n} reads with usable cloneIDs and UMIs. Skipped 1 without cell id, 2 without UMI."
    assert lines[2].startswith(f"Read {n} reads containing (parts of) the cloneID (") and "Writing UMI matrix" in lines and lines[-1].startswith("Average clone size: ")
    assert lines.index(" size count") == lines.index("Clone size histogram") + 1


def test_projection_of_tables(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(95, "*", "ACGT"), (95, "4S", "ACGT"), (95, "30M", "*"), (95, "30M", ""), (95, None, "ACGT"), (None, "4M", "ACGT"), (20, "5M70000N5M", "ACGTACGTAC")]
    for _ in range(400):
        inner = [(int(rng.integers(1, 12)), str(rng.choice(list("MIDN=X")))) for _ in range(int(rng.integers(0, 6)))]
        ops = [(2, "H")] * int(rng.integers(0, 2)) + [(int(rng.integers(1, 9)), "S")] * int(rng.integers(0, 2)) + [(int(rng.integers(1, 9)), "M"), *inner, (1, "M")]
        ops += [(int(rng.integers(1, 30)), "S")] * int(rng.integers(0, 2)) + [(3, "H")] * int(rng.integers(0, 2))
        n = sum(m for m, op in ops if op in "MIS=X")
        rows.append((int(rng.integers(60, 130)), "".join(f"{m}{op}" for m, op in ops), "".join(rng.choice(list("ACGTN"), n))))
    table = spark.createDataFrame(rows, "pos long, cigar string, seq string")
    for span in (SPAN, (95, 125), (104, 106), (0, 400)):
        for r in al.extract_clone_ids(table, *span).collect():
            usable = None not in (r.pos, r.cigar) and r.cigar.strip("0123456789S*") and r.seq not in ("", "*")
            want = plain_project(r.pos, r.cigar, r.seq, *span) if usable else None
            assert r.clone_id == want, (r, span)
