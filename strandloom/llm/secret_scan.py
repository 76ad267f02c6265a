"""Secret scan over a trigram inverted index, with built-in functions only.

Each rule's regex gives a Boolean trigram query: an OR of branches, each an AND of trigrams that every match of the
branch must hold. The index has postings for the trigrams that some query asks for. Branches whose postings meet in a
document make it a candidate of the rule, and the regex is run on candidates only. A rule of which some branch has no
mandatory trigram runs on every document.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce
from re import _constants as K
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.text import key128, text_of
from strandloom.session import checkpointed, stored


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # whose length counts
    least: int = 1  # code points
    base: bool = False


#: The first three are the contract's; the rest are what the method adds.
RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),  # runs of [0-9a-f]+ that are long enough
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]
#: Sets of characters up to this size, and so many alternatives in all, are spelled out; what is larger is a gap.
SPELL, BRANCHES = 8, 128
#: Matches whose places are summed up in one array at a time.
FOLD = 200
#: Candidates are broadcast up to so many rows; beyond, they are joined by shuffle.
BROADCAST_ROWS = 300_000


def _spellings(tree) -> list[tuple]:
    """Ways to match a parsed regex: tuples of characters, with None for a stretch that isn't spelled out."""
    ways: list[tuple] = [()]
    for op, value in tree:
        if op is K.LITERAL:
            more = [(chr(value),)]
        elif op is K.IN:
            few = value if len(value) <= SPELL and all(o is K.LITERAL for o, _ in value) else []
            more = [(chr(c),) for _, c in few] or [(None,)]
        elif op is K.SUBPATTERN:
            more = _spellings(value[-1])
        elif op is K.BRANCH:
            more = [w for branch in value[1] for w in _spellings(branch)]
        elif op is K.MAX_REPEAT or op is K.MIN_REPEAT:
            least, most, inner = value
            once = _spellings(inner)
            if most == 1:
                more = once if least else [(), *once]
            else:
                more = [(*w, None) for w in once] if least else [(None,)]
        else:
            more = [(None,)]
        ways = [a + b for a, b in itertools.product(ways, more)]
        if len(ways) > BRANCHES:
            return [(None,)]
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The branches of the regex, each as its mandatory trigrams in lower case; None if a branch has none."""
    branches = set()
    for way in _spellings(_parser.parse(pattern)):
        runs = "".join("\0" if c is None else c.lower() for c in way).split("\0")
        branches.add(frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2)))
    if frozenset() in branches:
        return None
    return sorted((b for b in branches if not any(o < b for o in branches)), key=sorted)


def _rows(spark, rows: list[tuple], *names: str) -> DataFrame:
    """A small fixed table."""
    made = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows]
    return spark.range(1).select(F.explode(F.array(*made)).alias("r")).select("r.*")


def postings(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, k1, k2): which rows of keyed (k1, k2, text) hold which of the trigrams, in either case."""
    low = keyed.select("k1", "k2", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("k1", "k2", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(k1, k2, kinds): the rules whose trigram query a row satisfies."""
    terms = []
    for kind, branches in queries.items():
        for n, branch in enumerate(branches):
            terms += [(kind, n, t, 1 << i, (1 << len(branch)) - 1) for i, t in enumerate(sorted(branch))]
    query = F.broadcast(_rows(index.sparkSession, terms, "kind", "branch", "trigram", "bit", "all"))  # fixed by the rules
    return (
        index.join(query, "trigram")
        .groupBy("k1", "k2", "kind", "branch", "all")
        .agg(F.bit_or("bit").alias("met"))
        .filter("met = all")
        .groupBy("k1", "k2")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _running(parts: Column, start: Column) -> Column:
    """(start, end, counts) of each of a few matches, the first of which begins after `start`."""

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["before"]
        end = begin + x["size"]
        found = F.array(F.struct(begin.alias("start"), end.alias("end"), x["counts"].alias("counts")))
        return F.struct(end.alias("at"), F.concat(state["out"], found).alias("out"))

    none = F.array().cast("array<struct<start:int,end:int,counts:int>>")
    return F.aggregate(parts, F.struct(start.alias("at"), none.alias("out")), step)["out"]


def _spans(text: Column, rule: Rule, nth: int) -> Column:
    """The rule's matches as an array of (start, nth, end) in code points: running sums over what split() leaves between.

    A fold that grows an array copies it at each step, so sums run within blocks of FOLD matches and over the blocks.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    parts = _bound(
        whole,
        lambda w: F.arrays_zip(
            F.transform(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(w)), F.char_length).alias("before"),
            F.transform(w, F.char_length).alias("size"),
            F.transform(counted, F.char_length).alias("counts"),
        ),
    )
    blocks = _bound(
        parts,
        lambda p: F.transform(
            F.sequence(F.lit(0), F.greatest(F.floor((F.size(p) - 1) / FOLD), F.lit(0)).cast("int")),
            lambda b: F.slice(p, b * FOLD + 1, F.lit(FOLD)),
        ),
    )

    def total(state: Column, block: Column) -> Column:
        size = F.aggregate(block, F.lit(0), lambda n, x: n + x["before"] + x["size"])
        return F.struct((state["at"] + size).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    found = _bound(blocks, lambda bs: F.flatten(F.zip_with(bs, F.aggregate(bs, zero, total)["out"], _running)))
    return F.transform(
        F.filter(found, lambda x: x["counts"] >= rule.least),
        lambda x: F.struct(x["start"].alias("start"), F.lit(nth).alias("nth"), x["end"].alias("end")),
    )


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id and spans, an array of (start, nth, end) in order; nth is the rule's place in rules.

    Matches are leftmost and non-overlapping for each rule; those whose counted group is too short are dropped without
    another try. A null or empty text has no spans; null doc_ids and repeated rows pass through; other columns take no
    part; an empty table gives an empty table; whole texts are searched, however long.
    """
    text = text_of(F.col("text"))
    k1, k2 = key128(F.col("doc_id"), text)
    keyed = docs.select("doc_id", text.alias("text"), k1.alias("k1"), k2.alias("k2"))
    asked = {r.kind: trigram_query(r.pattern) for r in rules}
    queries = {k: q for k, q in asked.items() if q}
    index = stored(postings(keyed, sorted({t for q in queries.values() for b in q for t in b})), "postings")
    found = checkpointed(candidates(index, queries))
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    none = F.array().cast("array<struct<start:int,nth:int,end:int>>")
    joined = keyed.join(found, ["k1", "k2"], "left")
    by_rule = [
        _spans(F.col("text"), r, n)
        if r.kind not in queries
        else F.when(F.array_contains("kinds", r.kind), _spans(F.col("text"), r, n)).otherwise(none)
        for n, r in enumerate(rules)
    ]
    return joined.select("doc_id", F.array_sort(F.flatten(F.array(*by_rule))).alias("spans"))


def written(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["nth"] + 1), s["start"], s["end"])), ","
    )


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    kinds, n_base = [r.kind for r in RULES], sum(r.base for r in RULES)
    count = lambda n: F.size(F.filter("spans", lambda s: s["nth"] == n)).cast("long")
    return found.select(
        "doc_id",
        *[count(n).alias(f"n_{kinds[n]}") for n in range(n_base)],
        F.sha2(written(F.filter("spans", lambda s: s["nth"] < n_base), kinds), 256).alias("base_sha256"),
        written(F.col("spans"), kinds).alias("spans"),
    )


def _sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    parts = " union all ".join(
        f"select doc_id, {n} as nth, {quoted(r.kind)} as kind, {r.least} as least, "
        f"string_split_regex(t, {quoted(r.pattern)}) as between, regexp_extract_all(t, {quoted(r.pattern)}) as whole, "
        f"regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) as counted from d"
        for n, r in enumerate(RULES)
    )
    n_base = sum(r.base for r in RULES)
    counts = ", ".join(f"count(*) filter (nth = {n}) as n_{RULES[n].kind}" for n in range(n_base))
    listed = "string_agg(kind || ':' || s || ':' || e, ',' order by s, nth)"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
p as ({parts}),
x as (select doc_id, nth, kind, least, unnest(range(1, len(whole) + 1)) as i, between, whole, counted from p),
y as (select doc_id, nth, kind, length(counted[i]) as n, least, length(whole[i]) as size,
        sum(length(between[i]) + length(whole[i])) over (partition by doc_id, nth order by i) as e from x),
z as (select doc_id, nth, kind, (e - size)::bigint as s, e::bigint as e from y where n >= least),
g as (select doc_id, {counts}, sha256(coalesce({listed} filter (nth < {n_base}), '')) as base_sha256,
        {listed} as spans from z group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{RULES[n].kind}, 0) as n_{RULES[n].kind}" for n in range(n_base))},
  coalesce(base_sha256, sha256('')) as base_sha256, coalesce(spans, '') as spans from d left join g using (doc_id)
"""


OP6_SQL = _sql()
