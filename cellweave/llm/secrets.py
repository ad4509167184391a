"""Secret scans through a trigram index, with DataFrame operations only.

Every rule's pattern is turned into a Boolean query over trigrams that any match must
hold: all groups, and of each group one alternative with all its trigrams. The index
has the postings ``(trigram, key)`` of the trigrams the rules ask for, over case-folded
texts; ``key`` is a hash of the whole text, so copies share their postings and a
collision can only add a candidate. Postings are intersected by counting, and a rule
is run on its candidates alone. A rule whose pattern has no mandatory trigram is run
on every text.

Defined cases: a null text is an empty one; repeated rows and ids are kept, each with
its spans; spans are offsets in code points, end exclusive; an empty table gives an
empty result. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as ops  # the parse tree of the standard library
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import lower_ascii
from cellweave.session import materialize, materialize_with


@dataclass(frozen=True)
class Rule:
    """A pattern that Java and Python read alike; matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The three kinds that every scan reports.
BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
)

# Public formats of further credentials.
MORE_RULES = (
    Rule("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge-token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat-token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web-token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

RULES = BASE_RULES + MORE_RULES

#: Candidate texts up to this many are broadcast; beyond it the join shuffles.
BROADCAST_CANDIDATES = 300_000

#: Alternatives one group of a query may have.
MAX_ALTERNATIVES = 64


def _trigrams(text: str) -> frozenset[str]:
    text = text.lower()
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _texts(tree) -> set[str] | None:
    """All texts a part of a pattern matches, if they are few and known."""
    found = {""}
    for op, arg in tree:
        if op is ops.LITERAL:
            part = {chr(arg)}
        elif op is ops.IN and all(o is ops.LITERAL for o, _ in arg):
            part = {chr(c) for _, c in arg}
        elif op is ops.SUBPATTERN:
            part = _texts(arg[3])
        elif op is ops.BRANCH:
            sets = [_texts(t) for t in arg[1]]
            part = None if any(s is None for s in sets) else set().union(*sets)
        elif op is ops.MAX_REPEAT and arg[1] == 1:
            part = _texts(arg[2])
            part = part if arg[0] or part is None else part | {""}
        else:
            return None
        if part is None or len(found) * len(part) > MAX_ALTERNATIVES:
            return None
        found = {a + b for a in found for b in part}
    return found


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Groups that must all hold; a group holds if one of its alternatives has all its trigrams."""
    groups: list[list[frozenset[str]]] = []
    run = {""}

    def flush() -> None:
        nonlocal run
        sets = {_trigrams(s) for s in run}
        if all(sets):  # one that holds all of another adds nothing
            groups.append(sorted((s for s in sets if not any(t < s for t in sets)), key=sorted))
        run = {""}

    for node in parser.parse(pattern):
        part = _texts([node])
        if part is None or len(run) * len(part) > MAX_ALTERNATIVES:
            flush()
        if part is not None:
            run = {a + b for a in run for b in part}
    flush()
    return groups


def _postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """``(trigram, key)``: the number of every wanted trigram, with each text that holds it."""
    folded = docs.select(F.xxhash64("text").alias("key"), lower_ascii(F.col("text")).alias("folded"))
    held = F.array(*(F.when(F.contains("folded", F.lit(t)), F.lit(i)) for i, t in enumerate(wanted)))
    return folded.select("key", F.explode(F.array_compact(held)).alias("trigram")).distinct()


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, int]:
    """``(key, rules)``: the texts that may match, with the numbers of the rules to run; and how many."""
    spark = docs.sparkSession
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    wanted = sorted({t for q in queries.values() for g in q for a in g for t in a})
    number = {t: i for i, t in enumerate(wanted)}
    terms = spark.createDataFrame(
        [
            (number[t], rule, len(query), group, alternative, len(trigrams))
            for rule, query in queries.items()
            for group, alternatives in enumerate(query)
            for alternative, trigrams in enumerate(alternatives)
            for t in sorted(trigrams)
        ],
        "trigram int, rule int, groups int, part int, alternative int, need int",
    )
    index = materialize(_postings(docs, wanted), "trigrams")
    held = (
        index.join(F.broadcast(terms), "trigram")
        .groupBy("key", "rule", "groups", "part", "alternative", "need")
        .agg(F.count("*").alias("n"))
        .filter("n = need")
        .groupBy("key", "rule", "groups")
        .agg(F.count_distinct("part").alias("n"))
        .filter("n = groups")
        .groupBy("key")
        .agg(F.collect_set("rule").alias("rules"))
    )
    found, totals = materialize_with(held, "candidates", n=F.count(F.lit(1)))
    return found, totals["n"]


def _spans(rule: Rule, order: int) -> Column:
    """The spans of a rule in ``text``: matches and the gaps between them, added up in turn."""
    pattern = rule.pattern.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(
        f"""transform(filter(aggregate(
              sequence(0, size(split(text, '{pattern}', -1)) - 1),
              named_struct(
                'at', 0,
                'gaps', transform(split(text, '{pattern}', -1), x -> length(x)),
                'found', transform(regexp_extract_all(text, '{pattern}', 0), x -> length(x)),
                'tested', transform(regexp_extract_all(text, '{pattern}', {rule.group}), x -> length(x)),
                'out', cast(array() AS array<struct<s: int, e: int, n: int>>)),
              (a, i) -> if(i >= size(a.found), a, named_struct(
                'at', a.at + a.gaps[i] + a.found[i],
                'gaps', a.gaps, 'found', a.found, 'tested', a.tested,
                'out', array_append(a.out, named_struct(
                  's', a.at + a.gaps[i], 'e', a.at + a.gaps[i] + a.found[i], 'n', a.tested[i])))),
              a -> a.out), x -> x.n >= {rule.least}),
            x -> named_struct('s', x.s, 'ord', {order}, 'e', x.e))"""
    )


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The kept columns with ``found``: an array of ``(s, ord, e)`` by start, then rule."""
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    found, n = candidates(texts, rules)
    found = found.withColumnRenamed("key", "found_key").withColumnRenamed("rules", "found_rules")
    if n <= BROADCAST_CANDIDATES:
        found = F.broadcast(found)
    read = docs.select(*(F.col(c).alias(f"kept_{c}") for c in keep), F.coalesce(F.col(text), F.lit("")).alias("text"))
    joined = read.join(found, F.xxhash64(read.text) == found.found_key, "left")
    nothing = F.expr("cast(array() AS array<struct<s: int, ord: int, e: int>>)")
    parts = []
    for i, rule in enumerate(rules):
        run = F.array_contains("found_rules", i) if trigram_query(rule.pattern) else F.lit(True)
        run = run & F.rlike("text", F.lit(rule.pattern))
        parts.append(F.when(run, _spans(rule, i)).otherwise(nothing))
    return joined.select(
        *(F.col(f"kept_{c}").alias(c) for c in keep), F.array_sort(F.concat(*parts)).alias("found")
    )


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x.ord), x.s.cast("string"), x.e.cast("string"))), ","
    )


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: matches of the three base kinds, a digest of their spans, and all spans as text."""
    found = scan(docs, text, (doc_id,))

    def count(i: int) -> Column:
        return F.size(F.filter("found", lambda x: x.ord == i)).cast("long")

    base = F.filter("found", lambda x: x.ord < len(BASE_RULES))
    return found.select(
        F.col(doc_id).alias("doc_id"),
        *(count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)),
        F.sha2(_listed(base, RULES), 256).alias("base_sha256"),
        _listed(F.col("found"), RULES).alias("spans"),
    )


def redacted(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The documents with every secret replaced by ``mark``; spans that overlap become one. Null texts stay null."""
    others = [c for c in docs.columns if c != text]
    found = scan(docs.withColumn("__text", F.col(text)), text, (*others, "__text"))
    clean = F.expr(
        f"""aggregate(found, named_struct('out', '', 'at', 0),
              (a, x) -> named_struct(
                'out', if(x.s < a.at, a.out, concat(a.out, substring(__text, a.at + 1, x.s - a.at), '{mark}')),
                'at', greatest(a.at, x.e)),
              a -> concat(a.out, substring(__text, a.at + 1)))"""
    )
    new = F.when(F.size("found") == 0, F.col("__text")).otherwise(clean)
    return found.select(*(new.alias(c) if c == text else F.col(c) for c in docs.columns))
