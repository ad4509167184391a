"""License scans by a positional index of rare words, with DataFrame operations only.

Document frequencies of the license words are taken over the whole corpus. Each
template enters the index with its rarest words and their places. A file's words are
looked up in the index; a word at place p that a template has at place t proposes that
the template starts at p - t. A start counts with the share of template words that
stand where the template has them, and adds the template's label if that share is high
enough and the mandatory key phrase is complete.

The base phrases are found through the same rare words: the rarest word of a phrase
proposes a start and the other words are verified.

Defined cases: a null text is an empty one (no words, no labels, null places);
repeated rows and ids are kept; an empty table gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import lower_ascii

# Phrases every scan reports, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: str


# Words of public license notices and the phrase each must hold.
TEMPLATES = (
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("mit", "released under the mit license", "mit license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "permission is hereby granted free of charge",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistribution and use in source and binary forms",
    ),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
)

#: Rarest words of a template that enter the index.
RARE_WORDS = 3

#: Share of a template's words that must stand in place.
MIN_SHARE = 0.7

NO_WORD = "[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+"


def with_words(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns and ``words``: lower-cased runs of letters, digits and all other than ASCII characters."""
    pieces = docs.select(*keep, lower_ascii(F.coalesce(F.col(text), F.lit(""))).alias("__lower")).withColumn(
        "__pieces", F.expr(f"split(__lower, '{NO_WORD}', -1)")
    )
    return pieces.select(*keep, F.expr("filter(__pieces, x -> x <> '')").alias("words"))


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


def document_frequencies(docs: DataFrame, vocabulary: set[str], text: str = "text") -> dict[str, int]:
    """Documents that hold each word of a fixed vocabulary."""
    held = with_words(docs, text, ()).select(
        F.explode(F.expr(f"array_distinct(filter(words, x -> x IN ({_quoted(vocabulary)})))")).alias("w")
    )
    counts = {r.w: r.n for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: counts.get(w, 0) for w in vocabulary}


def rarest(words: list[str], frequency: dict[str, int], n: int) -> list[str]:
    """The ``n`` distinct words of highest inverse document frequency, ties by the word."""
    return sorted(set(words), key=lambda w: (frequency[w], w))[:n]


def _at(start: str, words: list[str], first: int = 0) -> list[str]:
    """SQL conditions: the words stand from ``start + first`` on."""
    return [f"coalesce(get(words, {start} + {first + k}) = '{w}', false)" for k, w in enumerate(words)]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: words, places of base phrases, base labels, all labels, best template share."""
    phrases = [(p.split(), label) for p, label in PHRASES.items()]
    templates = [(t, t.text.split(), t.phrase.split()) for t in TEMPLATES]
    vocabulary = {w for ws, _ in phrases for w in ws} | {w for _, ws, _ in templates for w in ws}
    frequency = document_frequencies(docs, vocabulary, text)
    anchors = [rarest(ws, frequency, 1)[0] for ws, _ in phrases]
    index = [rarest(ws, frequency, RARE_WORDS) for _, ws, _ in templates]

    looked_up = set(anchors).union(*index)
    read = with_words(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", ("doc_id",))
    rare = read.withColumn(
        "rare",
        F.expr(
            "filter(transform(words, (w, i) -> named_struct('w', w, 'p', i)),"
            f" x -> x.w IN ({_quoted(looked_up)}))"
        ),
    )
    places = []
    for k, ((words, _), anchor) in enumerate(zip(phrases, anchors)):
        shift = words.index(anchor)
        places.append(
            F.expr(
                f"filter(transform(filter(rare, x -> x.w = '{anchor}'), x -> x.p - {shift}),"
                f" s -> s >= 0 AND {' AND '.join(_at('s', words))})"
            ).alias(f"base_{k}")
        )
    best = []
    for k, ((_, words, phrase), keys) in enumerate(zip(templates, index)):
        postings = ", ".join(f"named_struct('w', '{w}', 't', {t})" for t, w in enumerate(words) if w in keys)
        share = " + ".join(f"int({c})" for c in _at("s", words))
        offset = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        complete = " AND ".join(_at("s", phrase, offset))
        starts = (
            f"array_distinct(flatten(transform(filter(rare, x -> x.w IN ({_quoted(keys)})),"
            f" x -> transform(filter(array({postings}), t -> t.w = x.w), t -> x.p - t.t))))"
        )
        best.append(
            F.expr(
                f"transform({starts}, s -> named_struct('share', ({share}) / {len(words)}D, 'complete', {complete}))"
            ).alias(f"starts_{k}")
        )
    found = rare.select("doc_id", F.size("words").cast("long").alias("n_words"), *places, *best)

    all_places = F.concat(*(F.col(f"base_{k}") for k in range(len(phrases))))
    base = F.array_compact(F.array(*(F.when(F.size(f"base_{k}") > 0, F.lit(x)) for k, (_, x) in enumerate(phrases))))
    added = F.array_compact(
        F.array(
            *(
                F.when(F.exists(f"starts_{k}", lambda s: s.complete & (s.share >= MIN_SHARE)), F.lit(t.label))
                for k, (t, _, _) in enumerate(templates)
            )
        )
    )
    score: Column = F.greatest(
        *(F.coalesce(F.array_max(F.transform(f"starts_{k}", lambda s: s.share)), F.lit(0.0)) for k in range(len(templates)))
    )

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(all_places).cast("long").alias("n_base"),
        F.array_min(all_places).cast("long").alias("first_word"),
        F.array_max(all_places).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, added)).alias("labels"),
        score.alias("score"),
    )
