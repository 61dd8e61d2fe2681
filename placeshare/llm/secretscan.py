"""Secrets in texts, by a trigram inverted index, in DataFrame operations only.

Each rule is a regular expression, and ``trigrams.query_of`` derives from it which trigrams a text must
hold: a Boolean query. The index has a posting (trigram, key of a text) for each trigram that a rule
asks for and each text that holds it. Postings are intersected and united text by text, for all rules at
once, and what satisfies a rule's query is its candidate. Only there the rule itself is tried; rules without
mandatory trigrams scan all texts. A text's key is a 64-bit hash: texts that share one by chance share
their postings, which makes more candidates but loses none.

The index is small against the texts: a few trigrams a text at most. Postings are put together before
they are shuffled. Candidates meet the texts in a join that the planner broadcasts if it measures
them as small, and else shuffles, with hot keys (copies of one text) split by adaptive execution.

Matches of a rule are leftmost and do not overlap; those whose group is too short are dropped. Places are
code points, ends are exclusive. All repeats are of one class of signs or bounded, so long texts neither
recurse nor take quadratic time.

Null texts count as empty: they have no spans. Repeated rows each give a row, an empty table gives an empty
result, and other columns are ignored whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeshare.llm.common import stored
from placeshare.llm.trigrams import ANY, And, query_of, trigrams_of

BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches whose ``group`` has fewer than ``least`` code points are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: fixed values: the formats that are recognised; the first three are counted
NAMES = "|".join(map(any_case, ("password", "passwd", "secret", "token", "api_?key")))
RULES = (
    Rule("assign", rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z0-9\x20]{0,40}PRIVATE KEY-----"),
    Rule("bearer", rf"{any_case('bearer')}\x20[A-Za-z0-9+/_.=-]{{20,1000}}"),
    Rule("hosting", r"gh[oprsu]_[A-Za-z0-9]{36,255}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,255}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,255}"),
    Rule("login", r"://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{1,64}@"),
)


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The postings of ``trigrams``: ``trigram``, ``text_key`` for each text that holds it once lower-cased."""
    held = _let(F.lower("text"), lambda low: F.filter(F.array(*map(F.lit, trigrams)), lambda g: F.contains(low, g)))
    return docs.where("text is not null").select(_key(F.col("text")).alias("text_key"), F.explode(held).alias("trigram"))


def _satisfied(query, held: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(held, query)
    parts = [_satisfied(p, held) for p in sorted(query.parts, key=repr)]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if isinstance(query, And) else out | p
    return out


def candidates(index: DataFrame, queries: dict) -> DataFrame:
    """``text_key``, ``kinds``: of each text in the index, the queries that its postings satisfy, if any."""
    held = index.groupBy("text_key").agg(F.collect_set("trigram").alias("held"))
    kinds = F.array_compact(F.array(*(F.when(_satisfied(q, F.col("held")), kind) for kind, q in queries.items())))
    return held.select("text_key", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _before(sizes: Column) -> Column:
    """For each of an array's numbers, the sum of those before it: block by block, so that work stays linear."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: F.slice(sizes, b * BLOCK + 1, BLOCK))
    add = lambda numbers, start: F.aggregate(numbers, start, lambda s, n: s + n)

    def running(block, start):
        begin = F.struct(start.alias("sum"), F.expr("cast(array() as array<int>)").alias("all"))
        return F.aggregate(block, begin, lambda s, n: F.struct(
            (s["sum"] + n).alias("sum"), F.concat(s["all"], F.array(s["sum"])).alias("all")), lambda s: s["all"])

    return _let(blocks, lambda bs: _let(F.transform(bs, lambda b: add(b, F.lit(0))), lambda totals: F.flatten(
        F.transform(bs, lambda b, i: running(b, add(F.slice(totals, 1, i), F.lit(0)))))))


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """The places of a rule's matches: an array of structs ``start``, ``rank``, ``kind``, ``end``."""
    whole = lambda group: F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group))
    span = "array<struct<start:int,rank:int,kind:string,end:int>>"

    def placed(matches):
        # the text is gap, match, gap, match, ..., gap
        sizes = F.flatten(F.zip_with(
            F.transform(F.split(text, rule.pattern, -1), F.length), F.transform(matches, F.length),
            lambda gap, match: F.array(gap, F.coalesce(match, F.lit(0)))))
        kept = F.transform(whole(rule.group), lambda g: F.length(g) >= rule.least)

        def cut(before):
            each = F.transform(matches, lambda m, i: F.struct(
                before[i * 2 + 1].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"),
                (before[i * 2 + 1] + F.length(m)).alias("end")))
            return each if not rule.least else _let(kept, lambda k: F.filter(each, lambda _, i: k[i]))

        return _let(_before(sizes), cut)

    found = F.when(text.rlike(rule.pattern), _let(whole(0), placed))
    return F.coalesce(found, F.array()).cast(span)


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id`` and ``spans`` of every row: all places by start, then in the order of rules."""
    queries = {r.kind: query_of(r.pattern) for r in rules}
    asked = {kind: q for kind, q in queries.items() if q != ANY}
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if asked:
        trigrams = sorted(set().union(*map(trigrams_of, asked.values())))
        index = stored(trigram_index(docs.select("text"), trigrams), "postings")
        found = candidates(index, asked).withColumnRenamed("text_key", "k")
        texts = texts.withColumn("text_key", _key(F.col("text"))).join(found, F.expr("text_key = k"), "left")
    none = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)")
    each = [
        spans(F.col("text"), rule, i) if rule.kind not in asked
        else F.when(F.array_contains("kinds", rule.kind), spans(F.col("text"), rule, i)).otherwise(none)
        for i, rule in enumerate(rules)
    ]
    return texts.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))


def listed(found: Column) -> Column:
    """Spans as kind:start:end, separated by commas."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
