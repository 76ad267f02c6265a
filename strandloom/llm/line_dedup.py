"""Line dedup: hash normalised lines, count documents per hash, drop frequent lines, reassemble by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.text import SPACES, ascii_lower, key128, text_of
from strandloom.session import checkpointed

#: A table of frequent line hashes is broadcast up to so many rows of 24 bytes (12 MB); beyond, it is joined by shuffle.
BROADCAST_ROWS = 500_000


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, counts: bool = True) -> DataFrame:
    """Every row of docs with its columns, text rebuilt without frequent lines, and with `counts` __n_lines, __n_dropped.

    A line's key is the line stripped of white space with A-Z lower-cased. A key of at least min_chars code points
    that at least min_docs distinct doc_ids hold loses all its lines except those in the largest such doc_id.
    A null or empty text is one empty line and stays empty (null stays null); rows with a null doc_id count for no
    key and lose every line that is dropped elsewhere; repeated rows count once and are all kept; any other column
    of docs passes through unchanged, whatever its name, but for columns named as the two counts where these are asked
    for: they are replaced. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.struct("*").alias("__row"),
        F.col("doc_id").alias("__id"),
        F.xxhash64("text").alias("__th"),
    )
    lines = lambda text: F.split(text_of(text), "\n", -1)
    line = rows.select("__id", "__th", F.posexplode(lines(F.col("__row.text"))).alias("__pos", "__line"))
    key = ascii_lower(F.btrim(F.col("__line"), F.lit(SPACES)))
    keyed = line.select("__id", "__th", "__pos", key.alias("__key")).filter(F.char_length("__key") >= min_chars)
    h1, h2 = key128(F.col("__key"))
    hashed = keyed.select("__id", "__th", "__pos", h1.alias("__h1"), h2.alias("__h2"))
    frequent = checkpointed(
        hashed.groupBy("__h1", "__h2")
        .agg(F.countDistinct("__id").alias("__n"), F.max("__id").alias("__keep"))
        .filter(F.col("__n") >= min_docs)
        .select("__h1", "__h2", "__keep")
    )
    if frequent.count() <= BROADCAST_ROWS:
        frequent = F.broadcast(frequent)
    dropped = (
        hashed.join(frequent, ["__h1", "__h2"])
        .filter(~F.col("__id").eqNullSafe(F.col("__keep")))
        .groupBy(F.col("__id").alias("__did"), F.col("__th").alias("__dth"))
        .agg(F.collect_set("__pos").alias("__drop"))
    )
    joined = rows.join(dropped, F.col("__id").eqNullSafe(F.col("__did")) & (F.col("__th") == F.col("__dth")), "left")
    none = F.array().cast("array<int>")
    joined = joined.select("__row", "__drop", lines(F.col("__row.text")).alias("__lines"))  # a text is shuffled once
    kept = joined.select(
        "__row",
        "__lines",
        F.array_except(
            F.sequence(F.lit(0), F.size("__lines") - 1), F.coalesce(F.col("__drop"), none)
        ).alias("__kept"),
    )
    text = F.array_join(F.transform("__kept", lambda i: F.col("__lines")[i]), "\n")
    n_lines, n_kept = F.size("__lines").cast("long"), F.size("__kept").cast("long")
    added = {"__n_lines": n_lines, "__n_dropped": n_lines - n_kept} if counts else {}
    return kept.select(
        *[
            F.when(F.col("__row.text").isNull(), F.lit(None)).otherwise(text).alias("text")
            if c == "text"
            else F.col("__row").getField(c).alias(c)
            for c in docs.columns
            if c not in added
        ],
        *[n.alias(name) for name, n in added.items()],
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2(text_of(F.col("text")), 256).alias("kept_sha256"),
    )


OP4_SQL = r"""
with l as (
  select doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents)),
f as (select k, max(doc_id) as keep from l where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
m as (select l.doc_id, l.pos, l.line, (f.k is not null and l.doc_id <> f.keep) as gone from l left join f using (k))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from m group by doc_id
"""
