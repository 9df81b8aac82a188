from pyspark.sql import functions as F

from locusframe.operators import coverage, records
from locusframe.sources import alignments, lines, sequences

SAM = "\n".join(
    ["@HD\tVN:1.0", "@SQ\tSN:chr1\tLN:1000", "@SQ\tSN:chr2\tLN:500", "r1\t99\tchr1\t101\t60\t10M\t=\t201\t110\tACGTACGTAC\tIIIIIIIIII\tAS:i:5\tXS:A:+", "r1\t147\tchr1\t201\t60\t4M2I4M\t=\t101\t-110\tACGTACGTAC\tIIIIIIIIII", "r2\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII", "broken\tline", ""]
)


def test_sam_round_trip(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    df = alignments.read_alignments(spark, str(tmp_path / "a.sam"))
    rows = {(r.qname, r.flag): r for r in df.collect()}
    assert rows["r1", 99].pos == 100 and rows["r1", 99].pnext == 200 and rows["r1", 99].tags["AS"].value == "5"
    assert rows["r2", 4].pos == 0 and rows["r2", 4].cigar == "4S"
    assert [r._corrupt for r in df.where("_corrupt IS NOT NULL").collect()] == ["broken\tline"]
    back = {r.value for r in alignments.render(df.where("_corrupt IS NULL AND qname = 'r1'")).collect()}
    assert back == set(SAM.split("\n")[3:5])
    tagged = alignments.with_tag(df.where("qname = 'r1'"), "AS", "i", F.lit(9))
    assert {r[0] for r in tagged.select(alignments.tag("AS")).collect()} == {"9"}
    c = records.contig_table(alignments.contigs(alignments.header(spark, str(tmp_path / "a.sam"))))
    assert [(r.contig, r.offset) for r in c.orderBy("ord").collect()] == [("chr1", 0), ("chr2", 1000), ("*", 1500)]


def test_fragments_join_mates_with_the_gap(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    df = alignments.read_alignments(spark, str(tmp_path / "a.sam")).where("qname = 'r1'").withColumn("fid", F.lit(1)).withColumn("reflen", F.when(F.col("flag") == 99, 10).otherwise(8))
    row = alignments.fragments(df).first()
    assert (row.pos, row.cigar, row.left_is_first, row.reads) == (100, "10M90T4M2I4M", True, 2)


def test_fastq_and_fasta(spark, tmp_path):
    (tmp_path / "a.fq").write_text("".join(f"@id{i}\nACGT{'ACGT'[i % 4]}\n+x\nIIII{i % 10}\n" for i in range(50)) + "@cut\nAC\n")
    fq = sequences.read_fastq(spark, str(tmp_path / "a.fq")).orderBy("rec_no").collect()
    assert [r.id for r in fq] == [f"id{i}" for i in range(50)] and fq[3].s == "ACGTT" and fq[7].q == "IIII7"
    assert sequences.fastq_lines(sequences.read_fastq(spark, str(tmp_path / "a.fq")).where("rec_no = 0")).first().value == "@id0\nACGTA\n+\nIIII0"
    (tmp_path / "a.fa").write_text(">one first\nACGT\nAC\n>two\nGG\n\n>three\n")
    fa = sequences.read_fasta(spark, str(tmp_path / "a.fa"))
    assert {r.name: r.s for r in fa.collect()} == {"one": "ACGTAC", "two": "GG", "three": ""}
    assert {r.value for r in sequences.sequence_header(fa).collect()} >= {"@SQ\tSN:one\tLN:6"}


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "t.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = lines.numbered_lines(spark, str(tmp_path / "t.txt")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(r.value == f"line {r.line}" for r in got) and len(got) == 5000


def test_gtf_and_tables(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#c\nchr1\tsrc\texon\t11\t20\t.\t+\t.\tgene_id "g"; transcript_id "t";\nchr1\tsrc\texon\t31\t40\t2.5\t-\t0\tgene_id "g"; transcript_id "u";\n')
    rows = sequences.read_gtf(spark, str(tmp_path / "a.gtf")).orderBy("start").collect()
    assert (rows[0].start, rows[0].stop, rows[0].score, rows[0].gene, rows[1].transcript) == (10, 20, -1.0, "g", "u")
    (tmp_path / "d.tsv").write_text("# x\nc\t5\t7\n")
    assert lines.read_named(spark, str(tmp_path / "d.tsv"), "depth").select("chrom", "locus", "depth").first() == ("c", 5, 7)
    (tmp_path / "q").write_text("score_tag: AS\n0 2 0 255\n2 3 2 10\n")
    tag, q = lines.read_calibration(spark, str(tmp_path / "q"))
    assert tag == "AS" and q.where("given = 0").first().mapq == 255
    (tmp_path / "s").write_text("# x\nTG\nchr1\tG\ntx1\tT\n")
    pref, spaces = lines.read_contig_spaces(spark, str(tmp_path / "s"))
    assert pref == "TG" and {r.contig: r.space for r in spaces.collect()} == {"chr1": "G", "tx1": "T"}
    (tmp_path / "r.qseq").write_text("m\t1\t2\t3\t4\t5\t0\t1\tAC.T\thhhh\t1\n")
    assert sequences.read_qseq(spark, str(tmp_path / "r.qseq")).first() == ("m:2:3:4:5/1", "ACNT", "hhhh")


def test_jumps_of_the_documented_example(spark):
    """Truth 25M1000N25M and alignment 25M1010N25M at 500: the bases of the second block are placed ten off."""
    truth = [("chrI", 500, 525, 1, 0, 0), ("chrI", 1525, 1550, 1, 0, 0)]
    placed = [("chrI", 500, 525, 0, 1, 0), ("chrI", 1535, 1560, 0, 0, 1)]
    df = spark.createDataFrame(truth + placed, "contig string, start long, stop long, guide int, correct int, error int")
    got = [(r.pos, r.guide, r.correct, r.error) for r in coverage.jumps(df).orderBy("pos").collect()]
    assert got == [(500, 1, 1, 0), (525, -1, -1, 0), (1525, 1, 0, 0), (1535, 0, 0, 1), (1550, -1, 0, 0), (1560, 0, 0, -1)]


def test_extract_round_trip(spark):
    """Sorting by fragment and extracting twice gives the same reads; orphans are those without a mate."""
    rows = [(i // 2, i % 2, i, f"S{i}") for i in range(40) if i % 7]
    df = spark.createDataFrame(rows + rows[:5], "fid long, readno int, seq long, s string").withColumn("order", F.col("seq"))
    parts = records.extract_reads(df, ["order"])
    again = records.extract_reads(records.extract_reads(df, ["order"], paired=False)["reads"].orderBy("fid"), ["order"])
    for k in parts:
        assert sorted(parts[k].collect()) == sorted(again[k].collect())
    lone = {f for f, r, *_ in rows if (f, 1 - r) not in {(a, b) for a, b, *_ in rows}}
    assert {r.fid for r in parts["orphans"].collect()} == lone


def test_offsets_chunks_and_groups_of_lines(spark, tmp_path):
    text = "".join(f"line {i} {'é' * (i % 4)}\r\n" if i % 5 == 0 else f"line {i} {'é' * (i % 4)}\n" for i in range(400))
    (tmp_path / "a.txt").write_bytes(text.encode())
    data, path = text.encode(), str(tmp_path / "a.txt")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = lines.lines_with_offsets(spark, path).orderBy("start").collect()
        assert len(rows) == 400 and all(data[r.start : r.stop] == r.value.encode() + b"\n" for r in rows)
        chunks = lines.line_chunks(spark, path, 1000).orderBy("chunk").collect()
        assert [(a.stop, b.start) for a, b in zip(chunks, chunks[1:], strict=False) if a.stop != b.start] == [] and chunks[0].start == 0 and chunks[-1].stop == len(data)
        assert sum(c.lines for c in chunks) == 400 and all(abs(c.stop - c.start - 1000) < 60 for c in chunks[:-1])
        part = lines.chunk_lines(spark, path, 1000, 2).orderBy("start").collect()
        assert "\n".join(r.value for r in part).encode() + b"\n" == data[chunks[2].start : chunks[2].stop]
        groups = lines.line_groups(spark, path, 3, 1).orderBy("group").collect()
        assert len(groups) == 133 and groups[4].lines[0].startswith("line 13 ")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_fasta_index_and_binary_contigs(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGT\nAC\n>two\nGG\n>three\n")
    data = (tmp_path / "a.fa").read_bytes()
    index = {r.contig: data[r.start : r.stop] for r in sequences.fasta_index(spark, str(tmp_path / "a.fa"), "demo").collect()}
    assert index == {"one": b"ACGT\nAC\n", "two": b"GG\n", "three": b""}
    fa = sequences.read_fasta(spark, str(tmp_path / "a.fa")).where("name != 'three'")
    contigs = spark.createDataFrame([("two", 1, 2), ("one", 2, 6)], "contig string, ord int, length long")
    sequences.write_contigs(fa, contigs, str(tmp_path / "bin"))
    assert [(r.ord, r.name, r.s) for r in spark.read.parquet(str(tmp_path / "bin")).orderBy("ord").collect()] == [(1, "two", "GG"), (2, "one", "ACGTAC")]


def test_region_tables(spark, tmp_path):
    (tmp_path / "r.rdb").write_text("1\tdemo\tc\t100\t50\t+\n2\tdemo\tc\t5\t95\tNEG\n3\tdemo\tz\t5\t9\t.\n")
    lengths = spark.createDataFrame([("c", 110)], "contig string, length long")
    got = {r.id: (r.start, r.stop, r.strand) for r in lines.read_regions(spark, str(tmp_path / "r.rdb"), lengths, 20, 7).collect()}
    assert got == {1: (30, 107, "POS"), 2: (0, 110, "NEG")}
    (tmp_path / "g.rdb").write_text("1\t9\tdemo\tc\t10\t50\t-\n")
    assert [(r.id, r.group_id, r.start, r.stop) for r in lines.read_regions(spark, str(tmp_path / "g.rdb"), lengths, grouped=True).collect()] == [(1, 9, 10, 50)]


def test_fragments_split_into_their_reads_again(spark, tmp_path):
    reads = "array<struct<seq:string,qual:string>>"
    df = spark.createDataFrame(
        [(1, "c", 100, 60, "4M90T3M1I2M", True, True, [("AACG", "abcd"), ("GGTTCA", "uvwxyz")]), (2, "c", 100, 60, "4M-2T4M", False, True, [("AACG", "abcd"), ("CCCA", "wxyz")]),
         (3, "c", 7, 60, "4M", True, True, [("AACG", "abcd")]), (4, "*", 0, 0, "*", True, False, [("AA", "ab"), ("CC", "cd")])],
        f"fid int, rname string, pos long, mapq int, cigar string, left_is_first boolean, mapped boolean, reads {reads}",
    )
    got = {(r.qname, r.flag): (r.pos, r.cigar, r.pnext, r.tlen, r.seq, r.qual) for r in alignments.split_fragments(df).collect()}
    assert got == {
        ("1", 99): (100, "4M", 194, 99, "AACG", "abcd"), ("1", 147): (194, "3M1I2M", 100, -99, "TGAACC", "zyxwvu"),
        ("2", 163): (100, "4M", 102, 6, "CCCA", "wxyz"), ("2", 83): (102, "4M", 100, -6, "CGTT", "dcba"),
        ("3", 2): (7, "4M", 0, 0, "AACG", "abcd"),
        ("4", 109): (0, "*", 0, 0, "AA", "ab"), ("4", 157): (0, "*", 0, 0, "GG", "dc"),
    }
    alignments.write_alignments(alignments.split_fragments(df.where("fid = 1")), str(tmp_path / "out.sam"))
    back = alignments.read_alignments(spark, str(tmp_path / "out.sam")).withColumn("fid", F.lit(1)).withColumn("reflen", F.when(F.col("flag") == 99, 4).otherwise(5))
    assert alignments.fragments(back).first().cigar == "4M90T3M1I2M"
