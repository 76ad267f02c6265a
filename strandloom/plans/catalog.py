"""Registered queries over the given tables, with the SQL that each is held against.

The tables hold prose, so reads are made from documents: letters become bases. A read's id is its doc_id as text and
its place the doc_id itself. Barcodes are all disjoint pieces of every read, each a record of its own; its sample goes by
the number in the document's source.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequence import (
    but_suffix, cut, dna, fake_quality, first_token, parts, pieces, revcomp, suffix, windows,
)
from strandloom.operators import chunk, graph, lineage, merge, neighbors, sine
from strandloom.operators.index import NeighborIndex
from strandloom.operators.simjoin import near_and_same, similar_pairs
from strandloom.session import scratch_dir, settled, stored
from strandloom.sources import fastx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: A word that is searched, its errors, and the reads' length and overlaps, in turn.
WORD, WORD_ERRORS, READ, OVERLAPS = "ACGTTGCAATCG", 2, 150, (20, 45, 0, 80, 30, 120)
#: More pieces than any text has.
PLACES = 1 << 26

#: The start of every oracle: reads and barcodes as below.
READS_SQL = r"""
with reads as materialized (select doc_id as record_index, doc_id::varchar as id, upper(regexp_replace(translate(lower(text),
  'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtac'), '[^acgt]', '', 'g')) as seq,
  if(coalesce(try_cast(regexp_extract(source, '[0-9]+') as int), 0) % 2 = 0, 'even', 'odd') as sample from documents
  where text is not null),
bc as materialized (select record_index * 67108864 + i as record_index, id || ':' || i as id, seq[i * 36 + 1 : i * 36 + 36] as barcode,
  sample from (select *, unnest(range(length(seq) // 36)) as i from reads))"""
REVCOMP_SQL = "reverse(translate({}, 'ACGT', 'TGCA'))"


def query(sql: str | None = None):
    """Register a function under its name; its SQL follows the tables reads and bc."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = READS_SQL + sql
        return f

    return add


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reads(spark, sf_dir).drop("source")


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").filter("text is not null")
    cores = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:  # a file of one row group is one task; larger inputs stay where they are
        docs = docs.repartition(cores)
    return docs.select(
        F.col("doc_id").alias("record_index"), F.col("doc_id").cast("string").alias("id"), dna(F.col("text")).alias("seq"), "source"
    )


def barcoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_index, id, barcode, sample) of every piece of every read.

    Barcodes are written once: the queries below use them several times, and their making costs more than they do.
    """
    number = F.coalesce(F.regexp_extract("source", "[0-9]+", 0).try_cast("int"), F.lit(0))
    sample = F.when(number % 2 == 0, "even").otherwise("odd").alias("sample")
    r = _reads(spark, sf_dir).select("record_index", "id", sample, F.explode(pieces(F.col("seq"))).alias("p"))
    return settled(
        r.select(
            (F.col("record_index") * PLACES + F.col("p.place")).alias("record_index"), F.concat_ws(":", "id", "p.place").alias("id"),
            F.col("p.piece").alias("barcode"), "sample",
        ),
        "barcodes",
    )


def samples(barcodes: DataFrame) -> dict[str, DataFrame]:
    return {name: barcodes.filter(F.col("sample") == name) for name in ("even", "odd")}


def each_sample(f: Callable[[DataFrame, DataFrame], DataFrame], barcodes: DataFrame) -> DataFrame:
    """f of each sample and the other one, with the name of the former."""
    both = samples(barcodes)
    made = [f(both[x], both[y]).withColumn("sample", F.lit(x)) for x, y in (("even", "odd"), ("odd", "even"))]
    return made[0].unionByName(made[1])


def element(spark: SparkSession, sf_dir: str) -> str:
    """The single-record reference: the first document that is long enough, as bases."""
    long = reads(spark, sf_dir).filter(F.char_length("seq") >= sine.HEAD)
    return long.select(F.min_by("seq", "record_index").alias("s")).first().s or ""


# -- projections


@query(f", x as (select record_index, {REVCOMP_SQL.format('seq')} as rc from reads) select record_index, rc from x")
def reverse_complement(spark, sf_dir):
    return reads(spark, sf_dir).select("record_index", revcomp(F.col("seq")).alias("rc"))


@query(" select record_index, seq, repeat('?', length(seq)) as qual from reads")
def fasta_to_fastq(spark, sf_dir):
    return reads(spark, sf_dir).select("record_index", "seq", fake_quality(F.col("seq")).alias("qual"))


@query(r" select doc_id, regexp_split_to_array(trim(text), '\s+')[1] as token from documents where text is not null")
def id_token(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null")
    return docs.select("doc_id", first_token(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("token"))


@query(""" select record_index, right(seq, 20) as tail, left(seq, greatest(length(seq) - 20, 0)) as rest, seq[31:67] as mid
from reads""")
def suffix_cut(spark, sf_dir):
    seq = F.col("seq")
    return reads(spark, sf_dir).select(
        "record_index", suffix(seq, 20).alias("tail"), but_suffix(seq, 20).alias("rest"), cut(seq, 30, 67).alias("mid")
    )


@query(""", x as (select id, unnest(range(3)) as i, barcode from bc)
select id, (i * 9)::int as place, substr(barcode, i * 9 + 1, 9) as kmer from x""")
def barcode_parts(spark, sf_dir):
    b = barcoded(spark, sf_dir).select("id", F.explode(parts(F.col("barcode"), complete=False)).alias("p"))
    return b.select("id", "p.place", "p.kmer")


@query(""", x as (select id, unnest(range(27)) as j, barcode from bc) select distinct id, substr(barcode, j + 1, 9) as kmer from x""")
def kmer_windows(spark, sf_dir):
    return barcoded(spark, sf_dir).select("id", F.explode(windows(F.col("barcode"), complete=False)).alias("kmer"))


@query(""", x as (select distinct id, unnest(range(27)) as j, barcode from bc)
select distinct substr(barcode, j + 1, 9) as kmer, barcode, id from x""")
def kmer_dictionary(spark, sf_dir):
    return neighbors.dictionary(barcoded(spark, sf_dir))


@query(""", x as (select barcode, arg_max(id, record_index) as id from bc group by 1), y as (select *, unnest(range(27)) as j from x)
select distinct substr(barcode, j + 1, 9) as kmer, barcode, id from y""")
def kmer_dictionary_last(spark, sf_dir):
    return neighbors.dictionary(barcoded(spark, sf_dir), keep="last")


# -- similarity joins

COMPAT_SQL = """, d as materialized (select distinct barcode as b from bc),
w as (select distinct b, substr(b, j + 1, 9) as k from (select b, unnest(range(27)) as j from d)),
p as (select distinct b, substr(b, i * 9 + 1, 9) as k from (select b, unnest(range(3)) as i from d)),
met as (select p.b as a, w.b as b from p join w using (k)),
compat as materialized (select distinct a, b, levenshtein(a, b)::int as cost from met where levenshtein(a, b) <= 3)"""
#: Every pair with a part that is whole, at any offset: no pair within three edits is missed.
COMPLETE_SQL = """, d as materialized (select distinct barcode as b from bc),
w as (select distinct b, substr(b, j + 1, 9) as k from (select b, unnest(range(28)) as j from d)),
p as (select distinct b, substr(b, i * 9 + 1, 9) as k from (select b, unnest(range(4)) as i from d)),
met as (select p.b as a, w.b as b from p join w using (k)),
full_ as materialized (select distinct a, b, levenshtein(a, b)::int as cost from met where levenshtein(a, b) <= 3)"""
#: What lies within three edits of a part of a text is within six of the text.
INFIX = "levenshtein(a, b) <= 6 and (" + " or ".join(
    f"levenshtein(a, substr(b, {start + 1}, {n})) <= 3" for n in range(33, 37) for start in range(37 - n)
) + ")"
INFIX_SQL = COMPLETE_SQL + f", infix as materialized (select distinct a, b from met where {INFIX})"


@query(COMPAT_SQL + " select a, b, cost from compat")
def neighbor_pairs_compat(spark, sf_dir):
    b = barcoded(spark, sf_dir)
    return similar_pairs(b, b, recall="compat")


@query(COMPLETE_SQL + " select a, b, cost from full_")
def neighbor_pairs_complete(spark, sf_dir):
    b = barcoded(spark, sf_dir)
    return similar_pairs(b, b)


@query(COMPAT_SQL + f" select distinct a, b from met where {INFIX}")
def neighbor_pairs_infix_compat(spark, sf_dir):
    b = barcoded(spark, sf_dir)
    return similar_pairs(b, b, "infix", "compat").select("a", "b")


@query(INFIX_SQL + " select a, b from infix")
def neighbor_pairs_infix(spark, sf_dir):
    b = barcoded(spark, sf_dir)
    return similar_pairs(b, b, "infix").select("a", "b")


# -- neighbour counts and histograms

COUNTS_SQL = """, n as (select a, count(distinct id) as n from full_ join bc on bc.barcode = full_.b group by 1),
c as materialized (select record_index, id, barcode, coalesce(n, 0) as neighbors from bc left join n on n.a = bc.barcode),
h as materialized (select neighbors, count(*) as barcodes from c group by 1)"""
DENSE_SQL = COMPLETE_SQL + COUNTS_SQL + """,
dense as materialized (select b as bucket, coalesce(sum(barcodes), 0)::bigint as barcodes
  from range(50) r(b) left join h on least(h.neighbors, 49) = r.b group by 1)"""


@query(COMPLETE_SQL + COUNTS_SQL + " select record_index, id, barcode, neighbors from c")
def neighbor_counts(spark, sf_dir):
    return neighbors.neighbor_counts(barcoded(spark, sf_dir))


@query(COMPLETE_SQL + COUNTS_SQL + " select neighbors, barcodes from h")
def neighbor_histogram(spark, sf_dir):
    return neighbors.histogram(neighbors.neighbor_counts(barcoded(spark, sf_dir)))


@query((COMPLETE_SQL + COUNTS_SQL).replace("full_", "compat_").replace("range(28)", "range(27)").replace("range(4)", "range(3)") + " select neighbors, barcodes from h")
def neighbor_histogram_compat(spark, sf_dir):
    return neighbors.histogram(neighbors.neighbor_counts(barcoded(spark, sf_dir), recall="compat"))


@query(COMPLETE_SQL + """, i as (select a, id, min(cost) as cost from full_ join bc on bc.barcode = full_.b group by 1, 2)
select a as barcode, count(*) filter (cost = 0) as cost0, count(*) filter (cost = 1) as cost1,
  count(*) filter (cost = 2) as cost2, count(*) filter (cost = 3) as cost3 from i group by 1""")
def neighbor_cost_profile(spark, sf_dir):
    return neighbors.cost_profile(barcoded(spark, sf_dir))


@query(DENSE_SQL + " select bucket, barcodes from dense")
def dense_histogram(spark, sf_dir):
    return neighbors.dense_histogram(neighbors.neighbor_counts(barcoded(spark, sf_dir)))


@query(DENSE_SQL + " select string_agg(barcodes::varchar, ',' order by bucket) as value from dense")
def dense_histogram_line(spark, sf_dir):
    return neighbors.as_line(neighbors.dense_histogram(neighbors.neighbor_counts(barcoded(spark, sf_dir))))


@query(DENSE_SQL + """ select bucket, round(barcodes / sum(barcodes) over () * 100, 6) as pct,
  round(barcodes / (bucket + 1) / sum(barcodes / (bucket + 1)) over () * 100, 6) as weighted_pct,
  round(coalesce(case when bucket < 49 then barcodes / (bucket + 1) end
    / sum(case when bucket < 49 then barcodes / (bucket + 1) end) over () * 100, 0), 6) as weighted_pct_but_last from dense""")
def histogram_pct(spark, sf_dir):
    p = neighbors.percentages(neighbors.dense_histogram(neighbors.neighbor_counts(barcoded(spark, sf_dir))))
    return p.select("bucket", *[F.round(c, 6).alias(c) for c in ("pct", "weighted_pct", "weighted_pct_but_last")])


# -- new or inherited


@query(""" select record_index, id, barcode, count(*) over (partition by barcode) as copies,
  count(*) over (partition by barcode) = 1 as maybe_new from bc""")
def initial_singletons(spark, sf_dir):
    return lineage.exact_copies(barcoded(spark, sf_dir)).select("record_index", "id", "barcode", "copies", "maybe_new")


@query(INFIX_SQL + """, s as (select *, count(*) over (partition by barcode) as n from bc),
i as (select distinct s.record_index from s join infix on infix.a = s.barcode join bc o on o.barcode = infix.b where n = 1 and o.id <> s.id)
select s.record_index, s.id, s.barcode, i.record_index is not null as is_inherited from s left join i using (record_index) where n = 1""")
def new_or_inherited(spark, sf_dir):
    return lineage.new_or_inherited(barcoded(spark, sf_dir))


CROSS_SQL = """, m as (select infix.a, o.sample as other, count(distinct o.id) as n from infix join bc o on o.barcode = infix.b group by all),
x as materialized (select bc.*, coalesce(n, 0) as matches from bc left join m on m.a = bc.barcode and m.other <> bc.sample)"""


@query(INFIX_SQL + CROSS_SQL + " select *, matches = 0 as unmatched, matches = 1 as single_match from x")
def cross_sample_new(spark, sf_dir):
    """Each sample's records against the other sample."""
    return each_sample(lineage.cross_sample, barcoded(spark, sf_dir))


@query(INFIX_SQL + CROSS_SQL + " select *, matches = 0 as unmatched, matches = 1 as single_match from x")
def cross_sample_indexed(spark, sf_dir):
    """The same by stored indexes: each sample's barcodes are indexed once, the other's records are looked up there."""
    b = barcoded(spark, sf_dir)
    index = {}
    for name, x in samples(b).items():
        index[name] = NeighborIndex(spark, f"{scratch_dir(spark)}/index-{name}-{uuid.uuid4().hex}")
        index[name].append(x)
    other = {"even": "odd", "odd": "even"}
    found = [lineage.cross_sample(x, samples(b)[other[n]], index=index[other[n]]).withColumn("sample", F.lit(n)) for n, x in samples(b).items()]
    return found[0].unionByName(found[1])


@query(COMPLETE_SQL + " select a, b, cost from full_")
def indexed_pairs_of_versions(spark, sf_dir):
    """All near pairs by an index to which one sample is appended after the other."""
    b = barcoded(spark, sf_dir)
    index = NeighborIndex(spark, f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}")
    for x in samples(b).values():
        index.append(x)
    return similar_pairs(b, index)


@query(INFIX_SQL + CROSS_SQL + """, n as (select full_.a, o.sample, count(distinct o.id) as n from full_ join bc o on o.barcode = full_.b group by all),
h as (select bc.sample, coalesce(n, 0) as neighbors, count(*) as barcodes from bc left join n on n.a = bc.barcode and n.sample = bc.sample group by all),
dense as (select s.sample, b as bucket, coalesce(sum(barcodes), 0)::bigint as barcodes from (values ('even'), ('odd')) s(sample)
  cross join range(50) r(b) left join h on h.sample = s.sample and least(h.neighbors, 49) = r.b group by all)
select sample, bucket, case when bucket = 1 then (select count(*) from x where x.sample = dense.sample and matches = 0)
  else barcodes end as barcodes from dense""")
def patched_histogram(spark, sf_dir):
    """Each sample's own histogram, its bucket 1 replaced by how many of its records the other sample doesn't match."""
    return each_sample(lineage.patched_histogram, barcoded(spark, sf_dir))


# -- the similarity graph

EDGES_SQL = INFIX_SQL + """, e as materialized (select distinct least(a, b) as src, greatest(a, b) as dst from infix where a <> b)"""
COMPONENTS_SQL = EDGES_SQL.replace("\nwith ", "\nwith recursive ") + """,
both_ as (select src as x, dst as y from e union all select dst, src from e),
r(x, y) as (select b, b from d union select r.x, both_.y from r join both_ on r.y = both_.x),
comp as materialized (select x as barcode, min(y) as component from r group by 1)"""
STATS_SQL = COMPONENTS_SQL + """, n as (select component, count(*) as nodes from comp group by 1),
k as (select component, count(*) as edges from e join comp on e.src = comp.barcode group by 1),
stats as materialized (select component, nodes, coalesce(edges, 0) as edges, coalesce(edges, 0) * 2 = nodes * (nodes - 1) as is_clique
  from n left join k using (component))"""


@query(EDGES_SQL + " select src, dst from e")
def graph_edges(spark, sf_dir):
    return graph.edges(barcoded(spark, sf_dir))


@query(EDGES_SQL + " select src, dst from e")
def graph_union(spark, sf_dir):
    """The union of what two disjoint parts of the barcodes find against all of them."""
    b = barcoded(spark, sf_dir)
    halves = [near_and_same(h, b, "infix")[0] for h in samples(b).values()]
    return graph.union(*[h.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")) for h in halves])


@query(" select barcode, arg_max(id, record_index) as id from bc group by 1")
def graph_vertices(spark, sf_dir):
    return graph.vertices(barcoded(spark, sf_dir))


def _graph(spark, sf_dir):
    b = barcoded(spark, sf_dir)
    e = stored(graph.edges(b), "edges")
    return stored(graph.components(graph.vertices(b), e), "members"), e


@query()
def graph_components(spark, sf_dir):
    return _graph(spark, sf_dir)[0]


@query()
def component_stats(spark, sf_dir):
    return graph.component_stats(*_graph(spark, sf_dir))


@query()
def component_sizes(spark, sf_dir):
    return graph.size_histogram(graph.component_stats(*_graph(spark, sf_dir)))


def _recursive(name: str, sql: str) -> None:
    ORACLES[name] = "with recursive" + (READS_SQL + sql).strip().removeprefix("with")


_recursive("graph_components", COMPONENTS_SQL + " select barcode, component from comp")
_recursive("component_stats", STATS_SQL + " select component, nodes, edges, is_clique from stats")
_recursive("component_sizes", STATS_SQL + " select is_clique, nodes, count(*) as components from stats group by 1, 2")


@query()
def clique_numbers(spark, sf_dir):
    return graph.clique_numbers(*_graph(spark, sf_dir))


#: Every clique of the components that aren't cliques, grown by later neighbours of all its members.
CLIQUES_SQL = STATS_SQL + """, open_ as (select component, nodes from stats where not is_clique),
after_ as materialized (select component, src, list(dst) as later from e join comp on e.src = comp.barcode join open_ using (component) group by all),
q(component, later, k) as (select component, later, 1 from after_ union all
  select q.component, list_intersect(q.later, coalesce(a.later, [])), k + 1
  from (select component, later, k, unnest(later) as v from q) q left join after_ a on a.src = q.v)"""
_recursive("clique_numbers", CLIQUES_SQL + " select component, nodes, max(k) as clique_number from q join open_ using (component) group by 1, 2")


# -- fuzzy search

def locate_sql(word: str, name: str = "") -> str:
    """Where the word occurs best in each read, as table {name}best.

    A third of the word is whole where at most two edits touch it; only starts near such a third are tried.
    """
    thirds = ", ".join(f"({i}, '{word[i : i + 4]}')" for i in range(0, len(word), 4))
    return f""", {name}spot as (select record_index, seq, unnest(range(length(seq) - 3)) as p from reads),
{name}near as (select record_index, seq, p - o as f from {name}spot join (values {thirds}) t(o, third) on seq[p + 1 : p + 4] = third),
{name}s as (select distinct record_index, seq, f + d as start from {name}near, (values (-2), (-1), (0), (1), (2)) x(d) where f + d >= 0),
{name}l as (select *, unnest(range({len(word) - WORD_ERRORS}, {len(word) + WORD_ERRORS + 1})) as n from {name}s),
{name}m as (select record_index, start, start + n as stop, levenshtein(seq[start + 1 : start + n], '{word}') as cost from {name}l
  where start + n <= length(seq)),
{name}best as (select record_index, arg_min({{'start': start, 'stop': stop, 'cost': cost}}, cost * 1e12 + start * 1e4 - stop + start) as b
  from {name}m where cost <= {WORD_ERRORS} group by 1)"""


LOCATE_SQL = locate_sql(WORD)


@query(LOCATE_SQL + " select record_index, b.start::int as sine_start, b.stop::int as sine_end, b.cost::int as cost from best")
def fuzzy_locate_word(spark, sf_dir):
    return sine.locate(reads(spark, sf_dir), WORD, most=WORD_ERRORS).drop("id", "seq")


@query(LOCATE_SQL + " select record_index from best")
def fuzzy_candidates_fwd(spark, sf_dir):
    return sine.candidates(reads(spark, sf_dir), WORD, most=WORD_ERRORS).select("record_index")


@query(LOCATE_SQL.replace("from reads),", f"from (select record_index, {REVCOMP_SQL.format('seq')} as seq from reads)),") + " select record_index from best")
def fuzzy_candidates_rc(spark, sf_dir):
    return sine.candidates(reads(spark, sf_dir), WORD, most=WORD_ERRORS, direction="rc").select("record_index")


@query(LOCATE_SQL + """ select record_index, seq[b.start - 35 : b.start] as barcode from best join reads using (record_index)
where b.start >= 36""")
def barcode_extract(spark, sf_dir):
    return sine.barcodes(sine.locate(reads(spark, sf_dir), WORD, most=WORD_ERRORS)).select("record_index", "barcode")


@query(LOCATE_SQL + " select record_index, seq[b.start + 1 : b.stop] as sine from best join reads using (record_index)")
def sine_bodies(spark, sf_dir):
    return sine.bodies(sine.locate(reads(spark, sf_dir), WORD, most=WORD_ERRORS)).select("record_index", "sine")


EACH_SQL = """ select record_index, '{0}' as element, b.start::int as sine_start, b.stop::int as sine_end, b.cost::int as cost from {1}best"""


@query(LOCATE_SQL + locate_sql(WORD[::-1], "mirror_") + EACH_SQL.format("word", "") + " union all" + EACH_SQL.format("reversed", "mirror_"))
def locate_each(spark, sf_dir):
    """The word and its mirror image, both with errors: several elements at once."""
    return sine.locate_each(reads(spark, sf_dir), {"word": WORD, "reversed": WORD[::-1]}, most=WORD_ERRORS).drop("id", "seq")


@query(DENSE_SQL.replace("least(h.neighbors, 49)", "least(greatest(h.neighbors - 1, 0), 49)") + " select bucket, barcodes from dense")
def dense_histogram_of_others(spark, sf_dir):
    """The dense histogram by the number of matches less one."""
    return neighbors.dense_histogram(neighbors.neighbor_counts(barcoded(spark, sf_dir)), offset=1)


@query()
def locate_element(spark, sf_dir):
    """The precise search with its own constants, on both strands."""
    return sine.locate_both(reads(spark, sf_dir), element(spark, sf_dir))


def mates(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Consecutive pairs of reads over the whole of every sequence, with id and place as the pair's id.

    Mates of READ bases overlap by each of OVERLAPS in turn; what is left at the end is cut in two halves that don't
    overlap, so they can't be merged but by chance.
    """
    lengths = [2 * READ - n for n in OVERLAPS]
    starts, total = [sum(lengths[:i]) for i in range(len(lengths))], sum(lengths)
    n = F.char_length("seq")
    cycles = F.sequence(F.lit(0), F.floor((n - 1) / total).cast("int"))
    cuts = F.flatten(F.transform(cycles, lambda c: F.array(*[
        F.struct((c * len(lengths) + i).alias("place"), (c * total + starts[i]).alias("start"), F.lit(lengths[i]).alias("n"))
        for i in range(len(lengths))
    ])))
    cutted = r.filter("seq <> ''").select("record_index", "id", "seq", F.explode(F.filter(cuts, lambda p: p["start"] < n)).alias("p"))
    pieces = cutted.select(
        "record_index", F.concat_ws(":", "id", "p.place").alias("id"), F.col("p.n").alias("n"),
        cut(F.col("seq"), F.col("p.start"), F.col("p.start") + F.col("p.n")).alias("piece"),
    )
    size = F.char_length("piece")
    half = F.ceil(size / 2).cast("int")
    first = F.when(size == F.col("n"), F.lit(READ)).otherwise(half)
    second = F.when(size == F.col("n"), F.lit(READ)).otherwise(size - half)
    r1 = pieces.select("record_index", "id", F.left("piece", first).alias("seq"))
    r2 = pieces.select("record_index", "id", revcomp(F.right("piece", second)).alias("seq"))
    return r1, r2


#: Where each of OVERLAPS begins and how long its pair is, in turn over the whole sequence.
CUTS = ", ".join(f"({i}, {sum(2 * READ - n for n in OVERLAPS[:i])}, {2 * READ - OVERLAPS[i]})" for i in range(len(OVERLAPS)))
CYCLE = sum(2 * READ - n for n in OVERLAPS)
MERGE_SQL = f""", cuts(i, first, n) as (values {CUTS}),
turns as (select *, unnest(range((length(seq) - 1) // {CYCLE} + 1)) as c from reads where seq <> ''),
piece as (select record_index, id || ':' || (c * {len(OVERLAPS)} + i) as id, n, seq[c * {CYCLE} + first + 1 : c * {CYCLE} + first + n] as piece
  from turns, cuts where c * {CYCLE} + first < length(seq)),
mate as materialized (select record_index, id, left(piece, case when length(piece) = n then {READ} else (length(piece) + 1) // 2 end) as s1,
  right(piece, case when length(piece) = n then {READ} else length(piece) // 2 end) as s2 from piece),
tried as (select *, unnest(range(length(s2) + 1)) as p from mate where length(s1) >= 20),
tries as (select *, unnest(range(16, 25)) as len from tried),
seeded as materialized (select id, arg_min(p, c * 1e9 + p * 1e4 - len) as s from (
  select id, p, len, levenshtein(right(s1, 20), s2[p + 1 : p + len]) as c from tries where p + len <= length(s2)) where c <= 4 group by 1),
asked as materialized (select mate.*, s, s + 20 as n, greatest(4, ceil((s + 20) * 10 / 100))::int as k from mate join seeded using (id)),
found as materialized (select *, levenshtein(right(s1, n), left(s2, n)) <= k as direct from asked),
wide as (select id, s1, s2, n, k, p, unnest(range(greatest(n - k, 0), n + k + 1)) as len
  from (select *, unnest(range(length(s2) + 1)) as p from found where not direct)),
more as (select distinct id from wide where p + len <= length(s2) and levenshtein(right(s1, n), s2[p + 1 : p + len]) <= k),
merged as materialized (select mate.*, f.s, f.n, coalesce(f.direct or more.id is not null, false) as merged
  from mate left join found f using (id) left join more on more.id = mate.id),
pairs as materialized (select record_index, id, case when merged then left(s1, greatest(length(s1) - n, 0)) || s2 else s1 || s2 end as seq,
  s::int as seed_start, case when merged then n else 0 end::int as overlap, merged from merged)"""


@query(MERGE_SQL + " select record_index, id, seq, repeat('?', length(seq)) as qual, seed_start, overlap, merged from pairs")
def merge_pairs(spark, sf_dir):
    """Mates of READ bases, made from the whole of every read."""
    return merge.merge_pairs(merge.pair_up(*mates(reads(spark, sf_dir)), same_id=True), whole=True)


@query(MERGE_SQL + " select count(*) as pairs, count(seed_start) as seeded, count(*) filter (merged) as merged from pairs")
def merge_counts(spark, sf_dir):
    return merge.merge_counts(merge_pairs(spark, sf_dir))


@query()
def consensus_distances(spark, sf_dir):
    """Every read is a centre."""
    centers = reads(spark, sf_dir).select("record_index", F.col("seq").alias("center"))
    return sine.distance_histogram(sine.consensus_distances(centers, element(spark, sf_dir)))


@query()
def consensus_mean(spark, sf_dir):
    """The mean of the same distances."""
    centers = reads(spark, sf_dir).select("record_index", F.col("seq").alias("center"))
    return sine.mean_distance(sine.consensus_distances(centers, element(spark, sf_dir)))


# -- order, chunks, samples, files


@query(" select record_index, id from bc order by md5(id), id limit 10000")
def sample_sines(spark, sf_dir):
    return sine.sample(barcoded(spark, sf_dir).select("record_index", "id"))


@query(" select record_index as doc, row_number() over (order by record_index) - 1 as record_index, (row_number() over (order by record_index) - 1) // 25 as part from reads")
def chunk_assign(spark, sf_dir):
    r = reads(spark, sf_dir).select(F.col("record_index").alias("doc"))
    return chunk.chunked(chunk.with_record_index(r, "doc"), 25)


@query(" select id, seq, repeat('?', length(seq)) as qual from reads where seq <> ''")
def fastq_roundtrip(spark, sf_dir):
    """Reads written as FASTQ and read back."""
    r = reads(spark, sf_dir).filter("seq <> ''").withColumn("qual", fake_quality(F.col("seq")))
    path = fastx.write(r, fastx.scratch(spark, "reads"), "fastq")
    return fastx.read(spark, path, "fastq").select("id", "seq", "qual")


@query(" select id, seq from reads where seq <> ''")
def fasta_roundtrip(spark, sf_dir):
    r = reads(spark, sf_dir).filter("seq <> ''")
    path = fastx.write(r, fastx.scratch(spark, "reads"), "fasta", compression="bzip2")
    return fastx.read(spark, path, "fasta").select("id", "seq")


@query(" select id, seq, repeat('?', length(seq)) as qual from reads where seq <> ''")
def committed_roundtrip(spark, sf_dir):
    """Reads written by the sink that commits, as Zstandard frames, and read back by ranges that enter between them."""
    r = reads(spark, sf_dir).filter("seq <> ''").withColumn("qual", fake_quality(F.col("seq")))
    path = fastx.write_files(r, fastx.scratch(spark, "reads"), "fastq", "zst")
    return fastx.read(spark, path, "fastq", ("id", "seq", "qual"), rangeBytes="1000000")
