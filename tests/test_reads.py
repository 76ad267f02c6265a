import bz2
import gzip
import random

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from strandloom import cli, session
from strandloom.operators import chunk, merge, sine
from strandloom.plans import catalog
from strandloom.sources import fastx
from strandloom.streaming import reads as streaming
from tests.test_fuzzy import brute

random.seed(9)
BASES = "".join(random.choice("ACGT") for _ in range(700))
COMP = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(COMP)


def spoil(s, *places):
    s = list(s)
    for p in places:
        s[p] = "A" if s[p] != "A" else "C"
    return "".join(s)


def pairs(spark, *mates):
    return spark.createDataFrame([(i, f"r{i}", a, b) for i, (a, b) in enumerate(mates)], "record_index long, id string, seq string, seq2 string")


def test_merge(spark):
    r1, mate = BASES[:150], BASES[127:277]
    got = merge.merge_pairs(
        pairs(spark, (r1, rc(mate)), (r1, rc(spoil(mate, 4, 12))), (r1, rc(BASES[400:550])))
    ).orderBy("record_index").collect()
    assert [(len(r.seq), r.seed_start, r.overlap, r.merged) for r in got] == [(277, 3, 23, True), (277, 3, 23, True), (300, None, 0, False)]
    assert got[0].seq == BASES[:277] and got[1].seq == BASES[:127] + spoil(mate, 4, 12)
    assert got[2].seq == r1 + BASES[400:550] and set(got[0].qual) == {"?"} and len(got[0].qual) == 277
    counts = merge.merge_counts(merge.merge_pairs(pairs(spark, (r1, rc(mate)), (r1, rc(BASES[400:550]))))).first()
    assert (counts.pairs, counts.seeded, counts.merged) == (2, 1, 1)


def test_registered_pairs_hold_the_whole_text(spark, tmp_path):
    rng = random.Random(4)
    texts = {i: "".join(rng.choice("abcd") for _ in range(n)) for i, n in enumerate([0, 3, 30, 279, 280, 281, 1505, 4000])}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("source", F.lit(None).cast("string")).write.parquet(f"{tmp_path}/documents.parquet")
    got, as_bases = {}, str.maketrans("abcd", "ACGT")
    rows = catalog.QUERIES["merge_pairs"](spark, str(tmp_path)).collect()
    for r in rows:
        got.setdefault(r.record_index, []).append((int(r.id.split(":")[1]), r.seq))
    assert {i: "".join(s for _, s in sorted(x)) for i, x in got.items()} == {i: t.translate(as_bases) for i, t in texts.items() if t}
    assert {r.overlap for r in rows} == {0, 20, 30, 45, 80, 120} and {r.merged for r in rows} == {True, False}


def test_registered_pairs_are_those_of_the_sql_where_an_overlap_passes_a_mates_start(spark, tmp_path):
    texts = ["ACTATAACATTATATAGATACAACTAACTAGAAAAGATAGTAGCATTAACTATAACATTATATAGATACAACTAACTAGAAAAGATAG"]  # of sf0.1
    texts += [BASES[i : i + n] + BASES[i + d : i + n + d] for i, n, d in ((0, 44, 0), (50, 40, 2), (100, 48, 1), (200, 21, 0), (300, 30, 3))]
    rows = [(i, t.lower().translate(str.maketrans("acgt", "abcd"))) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s1")).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("merge_pairs", "merge_counts"):
        rows = catalog.QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(map(tuple, rows)) == sorted(con.execute(catalog.ORACLES[name]).fetchall())
    mate = texts[0][44:]
    assert merge.merge_pairs(pairs(spark, (texts[0][:44], rc(mate)))).first().seq == mate  # else all of a mate may lie anywhere


def test_padding_and_pairing(spark):
    got = merge.merge_pairs(pairs(spark, (BASES[:60], rc(BASES[300:360]))), padding=3).first()
    assert got.seq == BASES[:60] + "NNN" + BASES[300:360]
    r1 = spark.createDataFrame([(0, "a", "A"), (1, "b", "C")], "record_index long, id string, seq string")
    r2 = spark.createDataFrame([(0, "x", "G")], "record_index long, id string, seq string")
    assert merge.pair_up(r1, r2).count() == 1 and merge.pair_up(r1, r2, same_id=True).count() == 0


ELEMENT = "".join(random.choice("ACGT") for _ in range(100))


def sines(spark):
    head = ELEMENT[:67]
    rows = [
        (0, "at36", BASES[:36] + head + "ACGT"), (1, "at35", BASES[:35] + head), (2, "worn", BASES[:50] + spoil(head, *range(3, 63, 6))),
        (3, "back", rc(BASES[:40] + head)), (4, "none", BASES[200:400]), (5, "coarse", BASES[:50] + spoil(head, *range(3, 66, 4))),
    ]
    return spark.createDataFrame(rows, "record_index long, id string, seq string")


def test_candidates_locate_and_cut(spark):
    r = sines(spark)
    ids = lambda df: {x.id for x in df.collect()}
    assert ids(sine.candidates(r, ELEMENT)) == {"at36", "at35", "worn", "coarse"}
    assert ids(sine.candidates(r, ELEMENT, direction="rc")) == {"back"}
    with pytest.raises(ValueError):
        sine.candidates(r, ELEMENT, direction="up")
    found = sine.locate(r, ELEMENT)
    assert {(x.id, x.sine_start, x.cost) for x in found.collect()} == {("at36", 36, 0), ("at35", 35, 0), ("worn", 50, 10)}
    assert ids(sine.locate(r, ELEMENT, strand="rc")) == {"back"}
    strands = {(x.id, x.strand, x.sine_start, x.cost) for x in sine.locate_both(r, ELEMENT).collect()}
    assert strands == {("at36", "forward", 36, 0), ("at35", "forward", 35, 0), ("worn", "forward", 50, 10), ("back", "rc", 40, 0)}
    both = sine.locate_each(r, {"e": ELEMENT, "f": BASES[200:267]}).select("id", "element").collect()
    assert {tuple(x) for x in both} == {("at36", "e"), ("at35", "e"), ("worn", "e"), ("none", "f")}
    cut = {x.id: x.barcode for x in sine.barcodes(found).collect()}
    assert cut == {"at36": BASES[:36], "worn": BASES[14:50]}
    assert {x.sine for x in sine.bodies(found).filter("id = 'at36'").collect()} == {ELEMENT[:67]}


def test_each_element_is_located_with_errors(spark, tmp_path):
    words = {"word": catalog.WORD, "reversed": catalog.WORD[::-1]}
    seqs = [BASES[:60] + spoil(w, *places) + BASES[90:120] for w in words.values() for places in ((), (5,), (3, 8), (1, 5, 9))]
    rows = [(i, s.lower().translate(str.maketrans("acgt", "abcd"))) for i, s in enumerate(seqs)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s1")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalog.QUERIES["locate_each"](spark, str(tmp_path)).select("record_index", "element", "sine_start", "sine_end", "cost").collect()}
    found = {(i, name, *brute(w, s, 2)) for i, s in enumerate(seqs) for name, w in words.items()}
    assert got == {x for x in found if x[-1] >= 0}
    assert {x[-1] for x in got if x[1] == "reversed"} == {0, 1, 2}


def test_sample_and_centers(spark):
    r = sines(spark)
    assert sine.sample(r, 3).count() == 3 and sine.sample(r, 3).collect() == sine.sample(r.repartition(5), 3).collect()
    c = spark.createDataFrame([(ELEMENT[:67],), (spoil(ELEMENT[:67], 30),), ("ACGT",)], ["center"])
    got = [(x.distance, x.centers) for x in sine.distance_histogram(sine.consensus_distances(c, ELEMENT)).collect()]
    assert got == [(0, 1), (1, 1)]
    assert tuple(sine.mean_distance(sine.consensus_distances(c, ELEMENT)).first()) == (2, 0.5)


def test_record_index_and_chunks(spark):
    rows = spark.range(1000).select((F.lit(999) - F.col("id")).alias("x")).repartition(7)
    got = chunk.chunked(chunk.with_record_index(rows, "x"), 300, skip=(1,)).orderBy("x").collect()
    assert [r.record_index for r in got] == [*range(300), *range(600, 1000)] and {r.part for r in got} == {0, 2, 3}


def fastq(n):
    return "".join(f"@r{i} some words\n{BASES[i : i + 50]}\n+\n{'@' if i % 3 else 'I'}{'I' * 49}\n" for i in range(n))


@pytest.mark.parametrize("suffix", ["", ".gz", ".bz2", ".zst"])
def test_codecs(spark, tmp_path, suffix):
    text = fastq(40).encode()
    pack = {"": lambda b: b, ".gz": gzip.compress, ".bz2": bz2.compress, ".zst": zstandard.ZstdCompressor().compress}[suffix]
    path = tmp_path / f"a.fastq{suffix}"
    path.write_bytes(pack(text))
    got = fastx.read(spark, str(path)).orderBy("position").collect()
    assert [r.id for r in got] == [f"r{i}" for i in range(40)]
    assert got[1].description == "r1 some words" and got[1].seq == BASES[1:51] and got[1].qual[0] == "@"


@pytest.mark.parametrize("size", [1, 37, 200, 1000])
def test_byte_ranges_lose_and_repeat_nothing(spark, tmp_path, size):
    (tmp_path / "a.fastq").write_text(fastq(30))
    got = fastx.read(spark, str(tmp_path), rangeBytes=str(size)) if size > 1 else fastx.read(spark, str(tmp_path / "a.fastq"), rangeBytes="113")
    assert [r.id for r in got.orderBy("position").collect()] == [f"r{i}" for i in range(30)]


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">x one\nACGT\n>y\nGG\n>z")
    assert [(r.id, r.seq) for r in fastx.read(spark, str(tmp_path / "a.fasta")).orderBy("position").collect()] == [("x", "ACGT"), ("y", "GG")]
    (tmp_path / "w.fasta").write_text(">x\nACGT\nACGT\n")
    assert fastx.reference(spark, str(tmp_path / "w.fasta")) == "ACGTACGT"
    with pytest.raises(ValueError):
        fastx.reference(spark, str(tmp_path / "a.fasta"))
    (tmp_path / "bad.fastq").write_text("@x\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="no FASTQ record"):
        fastx.read(spark, str(tmp_path / "bad.fastq")).collect()
    (tmp_path / "odd.txt").write_text("hello\n")
    with pytest.raises(Exception, match="neither"):
        fastx.read(spark, str(tmp_path / "odd.txt")).collect()


def test_writing(spark, tmp_path):
    df = spark.createDataFrame([("x", "ACGT", 0), ("y", "GG", 1)], "id string, seq string, part int")
    fastx.write(df, f"{tmp_path}/q", "fastq", by="part")
    assert {(r.id, r.qual) for r in fastx.read(spark, f"{tmp_path}/q").collect()} == {("x", "####"), ("y", "##")}
    assert fastx.base_and_suffix("d/a.fastq.gz") == ("d/a", ".fastq.gz") and fastx.base_and_suffix("a") == ("a", "")


def test_commands(spark, tmp_path):
    (tmp_path / "e.fasta").write_text(f">e\n{ELEMENT}\n")
    (tmp_path / "r.fasta").write_text("".join(f">{r.id}\n{r.seq}\n" for r in sines(spark).collect()))
    cli.main(["barcodes", f"{tmp_path}/r.fasta", f"{tmp_path}/e.fasta", f"{tmp_path}/b"])
    assert spark.read.parquet(f"{tmp_path}/b").count() == 2
    cli.main(["histogram", f"{tmp_path}/b", f"{tmp_path}/h", "--length", "4"])
    assert spark.read.text(f"{tmp_path}/h").first().value == "0,2,0,0"
    cli.main(["report", f"{tmp_path}/h"])
    cli.main(["components", f"{tmp_path}/b", f"{tmp_path}/g"])
    assert spark.read.parquet(f"{tmp_path}/g/stats").count() == 2
    cli.main(["split", f"{tmp_path}/r.fasta", f"{tmp_path}/s", "--records", "4", "--format", "fasta"])
    assert spark.read.text(f"{tmp_path}/s").select("part").distinct().count() == 2
    cli.main(["dictionary", f"{tmp_path}/b", f"{tmp_path}/dict"])
    assert spark.read.parquet(f"{tmp_path}/dict").select("id").distinct().count() == 2
    cli.main(["fake-quality", f"{tmp_path}/r.fasta", f"{tmp_path}/q"])
    assert {(len(r.seq), r.qual) for r in fastx.read(spark, f"{tmp_path}/q").collect()} == {(len(r.seq), "?" * len(r.seq)) for r in sines(spark).collect()}


def test_parts_are_read_in_natural_order(spark, tmp_path):
    (tmp_path / "r.fastq").write_text(fastq(24))
    cli.main(["split", f"{tmp_path}/r.fastq", f"{tmp_path}/s", "--records", "2"])
    assert [r.id for r in cli.indexed(spark, f"{tmp_path}/s").orderBy("record_index").collect()] == [f"r{i}" for i in range(24)]
    (tmp_path / "c").mkdir()
    cli.main(["split", f"{tmp_path}/r.fastq", f"{tmp_path}/c/reads", "--power", "1", "--skip", "3"])  # of two records each
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == sorted(f"reads.part{i}e1.fastq.gz" for i in range(12) if i != 3)
    back = cli.indexed(spark, f"{tmp_path}/c").orderBy("record_index").collect()
    assert [r.id for r in back] == [f"r{i}" for i in range(24) if i not in (6, 7)] and back[0].description == "r0 some words"


def test_modes_run_one_after_the_other(spark, tmp_path):
    (tmp_path / "e.fasta").write_text(f">e\n{ELEMENT}\n")
    head, own, both = ELEMENT[:67], BASES[100:136], BASES[200:236]
    samples = {"wt": [own, both, both], "old": [spoil(both, 3), BASES[300:336]]}
    for name, cuts in samples.items():
        (tmp_path / f"{name}.fasta").write_text("".join(f">{name}{i}\n{c}{head}\n" for i, c in enumerate(cuts)))
        cli.main(["run", "all", f"{tmp_path}/{name}.fasta", f"{tmp_path}/e.fasta", f"{tmp_path}/o", "--sample", name, "--buckets", "5"])
    for mode in ("cross", "bodies", "bodies", "graph", "dictionary"):
        cli.main(["run", mode, "-", "-", f"{tmp_path}/o", "--sample", "wt", "--other", "old", "--buckets", "5"])
    line = lambda table: spark.read.text(f"{tmp_path}/o/wt-{table}").first().value
    assert line("histogram") == "0,1,2,0,0" and line("crossed-histogram") == "1,0,0,0,0" and line("filtered-histogram") == "0,1,2,0,0"
    assert [r.value for r in spark.read.text(f"{tmp_path}/o/wt-bodies").collect()] == [head] * 6  # appended
    assert spark.read.text(f"{tmp_path}/o/wt-bodies-random").count() == 6


def test_the_package_can_be_shipped(spark):
    session.ship(spark)
    assert spark.range(1).mapInArrow(lambda it: it, "id long").count() == 1


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    sines(spark).write.parquet(f"{tmp_path}/in")
    stream = streaming.read_stream(spark, f"{tmp_path}/in", "record_index long, id string, seq string")
    streaming.write_stream(streaming.barcode_stream(stream, ELEMENT), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    assert {r.barcode for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {BASES[:36], BASES[14:50]}
