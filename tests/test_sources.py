import gzip

import pytest
from pyspark.sql import functions as F

from spanweave.operators.intervals import lookup
from spanweave.sources.bed import read_bed
from spanweave.sources.sam import read_sam
from spanweave.sources.tables import create_views, read_tables, write_tables
from spanweave.sources.vcf import read_vcf, read_vcf_lines

VCF = """##fileformat=VCFv4.2
##contig=<ID=chrA,length=1000,assembly=toy>
##contig=<ID=chrB,length=500,assembly=toy>
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, total">
##INFO=<ID=AF,Number=A,Type=Float,Description="x">
##INFO=<ID=DB,Number=0,Type=Flag,Description="x">
##FORMAT=<ID=GT,Number=1,Type=String,Description="x">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="x">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
chrB\t10\trs1;rs2\tA\tC,G\t30.5\tPASS\tDP=7;AF=0.5,.;DB\tGT:AD\t0/1:3,4,0\t1|2:.
chrA\t5\t.\tACG\t.\t.\t.\tEND=20\tGT:AD\t./.:1\t0|0:2,3
"""

SAM = """@SQ\tSN:chrA\tLN:1000\tM5:abc
@RG\tID:g1\tSM:me\tPL:x
r1\t99\tchrA\t101\t60\t5M2D3M\t=\t150\t60\tACGTACGT\tIIIIIIII\tRG:Z:g1\tNM:i:2\tMD:Z:5^AC3
r2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*
"""


def test_vcf_tables(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    vcf = read_vcf(spark, str(tmp_path / "a.vcf"))
    a, b = vcf.variants.orderBy("variant_rowid").collect()
    assert (a.rid, a.POS, a.rlen, a.ID_jsarray, a.ALT_jsarray, a.QUAL, a.DB, a.DP) == (0, 4, 16, None, "[]", None, 0, None)
    assert (b.rid, b.POS, b.rlen, b.ID_jsarray, b.ALT_jsarray, b.QUAL, b.FILTER_jsarray, b.DP, b.AF_jsarray, b.DB) == (1, 9, 1, '["rs1","rs2"]', '["C","G"]', 30.5, '["PASS"]', 7, "[0.5,null]", 1)
    calls = {(r.variant_rowid, r.sample_id): r for r in vcf.genotypes.collect()}
    x = calls[b.variant_rowid, 0]
    assert (x.GT1, x.GT2, x.GT_ploidy, x.AD_jsarray) == (0, 1, 2, "[3,4,0]")
    assert (calls[b.variant_rowid, 1].GT_ploidy, calls[b.variant_rowid, 1].AD_jsarray) == (-2, None)
    assert (calls[a.variant_rowid, 0].GT1, calls[a.variant_rowid, 0].GT_ploidy, calls[a.variant_rowid, 0].AD_jsarray) == (None, 0, "1")
    assert [r.sample_name for r in vcf.samples.orderBy("sample_id").collect()] == ["s1", "s2"]
    with pytest.raises(Exception, match="alleles"):
        read_vcf(spark, str(tmp_path / "a.vcf"), ploidy=1).genotypes.collect()


def test_vcf_lines(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    rows = {r.CHROM: r for r in read_vcf_lines(spark, str(tmp_path / "a.vcf")).collect()}
    assert (rows["chrA"].POS, rows["chrA"].rlen) == (4, 16) and (rows["chrB"].POS, rows["chrB"].rlen) == (9, 1)
    assert rows[None].line.startswith("##fileformat") and rows[None].POS is None
    (tmp_path / "bad.vcf").write_text("chrA\t0\t.\tA\tC\t.\t.\t.\n")
    with pytest.raises(Exception, match="POS below 1"):
        read_vcf_lines(spark, str(tmp_path / "bad.vcf")).collect()


def test_sam_tables(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    sam = read_sam(spark, str(tmp_path / "a.sam"))
    rows = {r.flag: r for r in sam.reads.collect()}
    r = rows[99]
    assert (r.rid, r.pos, r.endpos, r.mapq, r.cigar, r.rnext, r.pnext, r.tlen, r.rg_id) == (0, 100, 110, 60, "5M2D3M", 0, 149, 60, 0)
    assert (rows[4].rid, rows[4].pos, rows[4].endpos, rows[4].cigar, rows[4].tlen, rows[4].rg_id) == (None, None, None, None, None, None)
    tags = {x.rowid: x.tags_json for x in sam.tags.collect()}
    assert tags[r.rowid] == '{"NM":2,"MD":"5^AC3"}' and tags[rows[4].rowid] == "{}"
    assert sam.readgroups.first().rg_tags_json == '{"PL":"x","SM":"me"}'
    assert sam.refseqs.first().gri_refget_id == "abc"
    assert {x.qname: x.seq for x in sam.seqs.collect()} == {"r1": "ACGTACGT", "r2": None}
    (tmp_path / "b.sam").write_text(SAM.replace("RG:Z:g1", "RG:Z:other"))
    with pytest.raises(Exception, match="unknown read group"):
        read_sam(spark, str(tmp_path / "b.sam")).reads.collect()


def test_folder_of_files_and_unknown_contig(spark, tmp_path):
    folder = tmp_path / "vcf"
    folder.mkdir()
    (folder / "a.vcf").write_text(VCF)
    (folder / "b.vcf").write_text(VCF)
    vcf = read_vcf(spark, str(folder))
    assert sorted(r.variant_rowid for r in vcf.variants.collect()) == [1, 2, 3, 4]
    assert vcf.genotypes.join(vcf.variants, "variant_rowid").count() == 8 and vcf.refseqs.count() == 2
    with gzip.open(tmp_path / "c.vcf.gz", "wt") as f:
        f.write(VCF + "chrX\t1\t.\tA\tC\t.\t.\t.\tGT\t0/0\t0/1\n")
    with pytest.raises(Exception, match="contig not in the header"):
        read_vcf(spark, str(tmp_path / "c.vcf.gz")).variants.collect()


def test_equal_reads_and_many_tags(spark, tmp_path):
    read = SAM.splitlines()[2] + "".join(f"\tX{i}:i:{i}" for i in range(1500))
    (tmp_path / "a.sam").write_text("\n".join(SAM.splitlines()[:2] + [read] * 3) + "\n")
    sam = read_sam(spark, str(tmp_path / "a.sam"))
    assert sorted(r.rowid for r in sam.reads.collect()) == [1, 2, 3]
    assert sam.reads.join(sam.seqs, "rowid").join(sam.tags, "rowid").count() == 3
    assert '"X1499":1499' in sam.tags.first().tags_json


def test_views_and_written_tables(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    sam = read_sam(spark, str(tmp_path / "a.sam"))
    assert "x_reads" in create_views(sam, "x_") and spark.sql("SELECT count(*) FROM x_reads JOIN x_seqs USING (rowid)").first()[0] == 2
    names = write_tables(sam, str(tmp_path / "out"), "x_", by={"seqs": ["qname"]})
    back = read_tables(spark, str(tmp_path / "out"), names)
    assert lookup(back["x_reads"], 0, 90, 105).first().pos == 100 and [r.qname for r in back["x_seqs"].collect()] == ["r1", "r2"]
    plan = back["x_seqs"].filter("qname = 'r1'")._jdf.queryExecution().toString()
    assert "EqualTo(qname,r1)" in plan


def test_bed(spark, tmp_path):
    (tmp_path / "a.bed").write_text("chrA\t11\t20\tx\t0\t+\n")
    assert read_bed(spark, str(tmp_path / "a.bed"), one_based=True).select(F.col("beg")).first()[0] == 10
