import itertools
import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from spanweave.functions import json_docs as j
from spanweave.functions import natural_order, nucleotides, range_text
from spanweave.operators import refseq
from spanweave.plans.session import Engine, EngineConfig

one = lambda spark, column, **values: spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint'}" for k, v in values.items())).select(column).first()[0]


def test_reverse_complement(spark):
    for text, expected in (("ACCGTtga", "tcaACGGT"), ("c", "g"), ("", ""), (None, None)):
        assert one(spark, nucleotides.dna_revcomp("s"), s=text) == expected
    for bad in ("ACGN", "AC GT", "acu"):
        with pytest.raises(Exception, match="non-DNA"):
            one(spark, nucleotides.dna_revcomp("s"), s=bad)


def test_twobit_round_trip_and_slices(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ACGTacgtUu") for _ in range(n)) for n in [*range(1, 70), 127, 128, 129, 300]]
    db = sqlite3.connect(":memory:")
    rows = [(i, t, rng.randint(-9, 9), rng.randint(-9, 9)) for i, t in enumerate(texts * 3)]
    df = spark.createDataFrame(rows, "i int, s string, y int, z int").withColumn("x", nucleotides.nucleotides_twobit("s"))
    got = df.select("s", "y", "z", nucleotides.twobit_dna("x").alias("dna"), nucleotides.twobit_rna("x").alias("rna"), nucleotides.twobit_length("x").alias("n"), F.octet_length("x.bits").alias("bytes"), nucleotides.twobit_dna("x", F.col("y"), F.col("z")).alias("part"), nucleotides.twobit_rna("x", F.col("y")).alias("tail")).collect()
    for r in got:
        dna = r.s.upper().replace("U", "T")
        assert r.dna == dna and r.rna == dna.replace("T", "U") and r.n == len(dna)
        assert r.bytes == (1 if len(dna) == 1 else (len(dna) + 3) // 4 + 1)
        assert r.part == db.execute("SELECT substr(?,?,?)", (dna, r.y, r.z)).fetchone()[0]
        assert r.tail == db.execute("SELECT substr(?,?)", (dna.replace("T", "U"), r.y)).fetchone()[0]


def test_twobit_keeps_other_text(spark):
    draw = random.Random(12)
    kept = ["".join(draw.choice("ACGTUacgtu") for _ in range(draw.randint(0, 20))) + draw.choice("Nn xyz-*.5\t") + "".join(draw.choice("ACGTU") for _ in range(draw.randint(0, 9))) for _ in range(60)]
    df = spark.createDataFrame([*enumerate(kept), (1000, ""), (1001, None), (1002, "GATTACA")], "i int, s string")
    got = {r.i: (r.bits, r.txt) for r in df.select("i", nucleotides.nucleotides_twobit("s").alias("x")).select("i", "x.bits", "x.txt").collect()}
    assert all(got[i] == (None, text) for i, text in enumerate(kept)) and got[1000] == (None, "") and got[1001] == (None, None)
    # T is 00, C 01, A 10 and G 11; the first byte says how many of the last byte count.
    assert got[1002][1] is None and len(got[1002][0]) == 3
    with pytest.raises(Exception, match="ASCII"):
        one(spark, F.to_json(nucleotides.nucleotides_twobit("s")), s="ACGT\u00fc")


def test_range_text(spark):
    draw = random.Random(4)
    commas = lambda n: "".join(c + "," * draw.randint(0, 1) * draw.randint(0, 2) for c in "0" * draw.randint(0, 2) + str(n))
    ranges = []
    for k in range(300):
        name = "".join(draw.choice("abcXYZ019_.|*\u4e2d\u00fc") for _ in range(draw.randint(1, 12)))
        begin, end = sorted(draw.choice([draw.randint(1, 99), draw.randint(1, range_text.MOST), range_text.MOST]) for _ in range(2))
        ranges.append((k, f"{name}:{commas(begin)}-{commas(end)}", name, begin - 1, end))
    df = spark.createDataFrame(ranges, "k int, s string, name string, b bigint, e bigint")
    rows = df.select("*", range_text.parse_range("s").alias("r"), range_text.parse_genomic_range_begin("s").alias("first"), range_text.parse_genomic_range_end("s").alias("last"), range_text.parse_genomic_range_sequence("s").alias("of")).collect()
    assert all(tuple(r.r) == (r.name, r.b, r.e) == (r.of, r.first, r["last"]) for r in rows) and len(rows) == 300
    assert one(spark, range_text.parse_range("s"), s=None) is None
    for k in range(0, 24):
        name, begin, end = "sq", draw.randint(5, 99), draw.randint(100, 999)
        bad = [f"{begin}-{end}", f":{begin}-{end}", f"{name}:", f"{name}:{begin}", f"{name}:{begin}-", f"{name}:-{end}", f"{name}:{end}-{begin}", f"{name}:0-{end}", f"{name} {name}:{begin}-{end}", f"{name}:{begin}-{end} ", f"{name}:{begin}-{end}e", f"{name}:{begin}-{range_text.MOST + 1 + draw.randint(0, 10**30)}"][k % 12]
        with pytest.raises(Exception, match="parse_genomic_range"):
            one(spark, range_text.parse_genomic_range_end("s"), s=bad)


def test_natural_order(spark):
    draw = random.Random(9)
    names = ["".join(draw.choice(["a", "b", "-", " ", "z", "0", "1", "7", str(draw.randint(0, 10**25))]) for _ in range(draw.randint(0, 6))) for _ in range(800)]
    signs = re.compile("[0-9]+|[^0-9]")
    # A run of digits is its value, which stands where a digit does among other signs.
    plain = lambda name: [("0", int(x)) if x.isdigit() else (x, -1) for x in signs.findall(name)]
    keys = {r.s: r.k for r in spark.createDataFrame([(x,) for x in [*names, None]], "s string").select("s", natural_order.natural_key("s").alias("k")).collect()}
    assert keys.pop(None) is None
    ordered = sorted(keys, key=plain)
    assert [plain(x) for x in sorted(keys, key=keys.get)] == [plain(x) for x in ordered]
    assert all((keys[x] == keys[y]) == (plain(x) == plain(y)) for x, y in itertools.pairwise(ordered))


DOC = '{"a":[1,2.5,"x",null,true],"b":{"c":"d e"},"k.l":7}'


PATHS = ["$.a[0]", "$.a[1]", "$.a[2]", "$.a[3]", "$.a[4]", "$.b", "$.b.c", '$."k.l"', "$.none", "$.a[#-1]", "$.a[#-2]", "$.a[#-4]", "$.a[#-9]", "$.a[#]", "$.a[9]"]


def test_json_reading(spark):
    db = sqlite3.connect(":memory:")
    df = spark.createDataFrame([(DOC,)], "s string")
    row = df.select(*[j.json_extract("s", p) for p in PATHS], *[j.json_type("s", p) for p in PATHS], *[j.json_extract("s", p, "$.b") for p in PATHS], *[j.json_array_length("s", p) for p in PATHS]).first()
    expected = [None if v is None else str(v) for p in PATHS for v in db.execute("SELECT json_extract(?,?)", (DOC, p)).fetchone()]
    expected += [db.execute("SELECT json_type(?,?)", (DOC, p)).fetchone()[0] for p in PATHS]
    expected += [db.execute("SELECT json_extract(?,?,'$.b')", (DOC, p)).fetchone()[0] for p in PATHS]
    expected += [db.execute("SELECT json_array_length(?,?)", (DOC, p)).fetchone()[0] for p in PATHS]
    assert list(row) == expected


def test_json_validity(spark):
    for text in ("1", "[1,]", '{"a":1}}', "1],[2", "{}", "null", "", "nan", "'a'", "01"):
        assert one(spark, j.json_valid("s"), s=text) == sqlite3.connect(":memory:").execute("SELECT json_valid(?)", (text,)).fetchone()[0], text
    assert one(spark, j.json_valid("s"), s=None) == 0
    with pytest.raises(Exception, match="malformed"):
        one(spark, j.json_array_length("s"), s="[1")


EDITS = [("set", "$.a[1]"), ("set", "$.n.m"), ("set", "$.a[#]"), ("set", "$.a[7]"), ("insert", "$.b.c"), ("insert", "$.b.x"), ("insert", "$.q[0]"), ("replace", "$.b.c"), ("replace", "$.zz"), ("set", "$")]


def test_json_edits(spark):
    db = sqlite3.connect(":memory:")
    df = spark.createDataFrame([(DOC,)], "s string")
    row = df.select(*[getattr(j, f"json_{kind}")("s", path, F.lit(9)) for kind, path in EDITS], j.json_set("s", "$.a[0]", F.lit("u"), "$.b.c", F.lit(None).cast("int"), "$.n", F.lit(2.5))).first()
    assert list(row) == [str(db.execute(f"SELECT json_{kind}(?,?,9)", (DOC, path)).fetchone()[0]) for kind, path in EDITS] + [db.execute("SELECT json_set(?,'$.a[0]','u','$.b.c',null,'$.n',2.5)", (DOC,)).fetchone()[0]]


def test_edits_keep_what_they_do_not_touch(spark):
    text = '{ "a":1.50, "b" : 1e3, "a":2, "c":[1.0, -0, 12345678901234567890] }'
    db = sqlite3.connect(":memory:")
    row = spark.createDataFrame([(text,)], "s string").select(j.json_minify("s"), j.json_set("s", "$.a", F.lit(7)), j.json_remove("s", "$.a"), j.json_insert("s", "$.c[#]", F.lit(1))).first()
    assert list(row) == [db.execute(f"SELECT {q}", (text,)).fetchone()[0] for q in ("json(?)", "json_set(?,'$.a',7)", "json_remove(?,'$.a')", "json_insert(?,'$.c[#]',1)")]


def test_json_remove_and_patch(spark):
    db = sqlite3.connect(":memory:")
    for path in ("$.a[0]", "$.a[#-1]", "$.b.c", "$.none", "$"):
        assert one(spark, j.json_remove("s", path), s=DOC) == db.execute("SELECT json_remove(?,?)", (DOC, path)).fetchone()[0]
    for patch in ('{"a":null}', '{"b":{"c":null,"d":1}}', "[1]", '{"z":{"y":null}}'):
        assert one(spark, j.json_patch("s", "p"), s=DOC, p=patch) == db.execute("SELECT json_patch(?,?)", (DOC, patch)).fetchone()[0]


@pytest.mark.parametrize("root", ["$", "$.a", "$.a[1]", "$[1]", "$.none"])
def test_json_rows(spark, root):
    db = sqlite3.connect(":memory:")
    docs = [DOC, "[1,{\"a\":2}]", "5", "{}"]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, doc string")
    for kind in ("each", "tree"):
        rows = j.json_each(df, "doc", path=root) if kind == "each" else df.lateralJoin(j.json_tree()(F.col("doc").outer(), F.lit(root)))
        # The standard library's release names the root by its place in full keys below an array element, and as a key.
        plain, whole = not root.endswith("]"), root == "$"
        row = lambda i, key, value, name, full: (i, "" if key is None or not whole else str(key), None if value is None else str(value), name, full if plain else "")  # noqa: B023, E731
        expected = [row(i, *found) for i, doc in enumerate(docs) for found in db.execute(f"SELECT key, value, type, fullkey FROM json_{kind}(?,?)", (doc, root))]
        assert sorted((row(r.i, r.key, r.value, r.type, r.fullkey) for r in rows.collect()), key=repr) == sorted(expected, key=repr)


def test_json_groups(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, "a", 6)], "i int, k string, v int")
    assert df.agg(j.json_group_array("v", "i")).first()[0] == "[null,5,6]"
    assert df.agg(j.json_group_object("k", "v", "i")).first()[0] == '{"a":null,"b":5,"a":6}'
    assert df.filter("false").agg(j.json_group_array("v")).first()[0] == "[]"


def test_refseqs(spark):
    table = refseq.put_assembly(refseq.empty(spark))
    names, ids = refseq.by_name(table), refseq.by_rid(table)
    assert len(ids) == 195 and names["chr17"].rid == 17 and ids[17].length == 83257441
    more = refseq.put_sequence(table, "plasmid", 5000, meta={"circular": True})
    assert refseq.by_name(more)["plasmid"] == (196, "plasmid", 5000, None, None, {"circular": True})
    with pytest.raises(ValueError):
        refseq.put_assembly(table)
    with pytest.raises(ValueError):
        refseq.put_assembly(table, "other")


def test_engine(spark, tmp_path):
    config = EngineConfig().merged('{"zstd_level": 3, "broadcast_mb": null}')
    assert config.zstd_level == 3 and config.broadcast_mb == 10
    with pytest.raises(TypeError):
        config.merged({"adaptive": "yes"})
    with pytest.raises(ValueError):
        config.merged({"nothing": 1})
    spark.createDataFrame([(1, "a", 5, 9)], "_rowid_ bigint, rid string, beg bigint, end bigint").write.parquet(str(tmp_path / "f.parquet"))
    engine = Engine(spark, config)
    assert engine.attach(str(tmp_path), "db2") == ["db2_f"]
    engine.index("db2_f", "rid", "beg", "end")
    assert spark.sql("SELECT * FROM db2_f_rowids('a', 9, 12)").first()[0] == 1
    assert spark.sql("""SELECT json_set('{"a":1}', '$.a', 2, '$.b', 'x') AS s, json_remove('[1,2]', '$[#-1]') AS r, json_patch('{"a":1.0}', '{"b":[ ]}') AS p, json_minify('[1 ]') AS m""").first() == ('{"a":2,"b":"x"}', "[1]", '{"a":1.0,"b":[]}', "[1]")
    got = spark.sql("SELECT dna_revcomp('GATC') AS a, parse_genomic_range_begin('chr1:2,345-06,789') AS b, natural_key('chr2') < natural_key('chr10') AS c").first()
    assert tuple(got) == ("GATC", 2344, True)
    assert spark.sql("SELECT count(*) FROM db2_f_rowids('a', 9, 12, 0)").first()[0] == 0 and tuple(spark.sql("SELECT * FROM db2_f_levels()").first()) == (1, 1)
    with pytest.raises(Exception, match="levels must satisfy"):
        spark.sql("SELECT * FROM db2_f_rowids('a', 9, 12, 1, 2)").collect()
    assert spark.sql("SELECT engine_version()").first()[0] == Engine.version
    # A join of ranges across two attached schemas.
    spark.createDataFrame([(7, "a", 8, 8), (8, "b", 8, 8)], "id bigint, rid string, beg bigint, end bigint").write.parquet(str(tmp_path / "other" / "q.parquet"))
    engine.attach(str(tmp_path / "other"), "db3")
    assert [tuple(r) for r in spark.sql("SELECT q.id, t._rowid_ FROM db3_q q LEFT JOIN LATERAL db2_f_rowids(q.rid, q.beg, q.end) t ORDER BY 1").collect()] == [(7, 1), (8, None)]


def test_twobit_in_sql(spark):
    Engine(spark)
    rng, db = random.Random(3), sqlite3.connect(":memory:")
    rows = [("".join(rng.choice("ACGTUacgtu") for _ in range(n)), rng.randint(-9, 9), rng.randint(-9, 9)) for n in [*range(1, 40), 63, 64, 65, 400] * 3] + [("no dna", 2, 3), ("", 1, 1), (None, 1, 1)]
    spark.createDataFrame(rows, "s string, y bigint, z bigint").selectExpr("*", "nucleotides_twobit(s) AS x").createOrReplaceTempView("twobit_rows")
    for r in spark.sql("SELECT s, y, z, twobit_dna(x) AS dna, twobit_rna(x, y) AS tail, twobit_dna(x, y, z) AS part, twobit_length(x) AS n, x.bits IS NULL AS kept FROM twobit_rows").collect():
        dna = r.s if r.kept else r.s.upper().replace("U", "T")
        rna = r.s if r.kept else dna.replace("T", "U")
        assert (r.dna, r.n) == (dna, None if dna is None else len(dna))
        assert r.part == db.execute("SELECT substr(?,?,?)", (dna, r.y, r.z)).fetchone()[0] and r.tail == db.execute("SELECT substr(?,?)", (rna, r.y)).fetchone()[0]
