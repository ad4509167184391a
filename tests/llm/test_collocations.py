"""Collocation mining against plain counting on small tables."""

import random
import re
from collections import Counter, defaultdict

import pytest

from cellweave.llm import collocations

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least, inside=80):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f[lang][tuple(ws[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= inside * counts[p[i : i + k]]:
                        gone.add(p[i : i + k])
        for p, a in cand.items():
            if p not in gone:
                cuts = [(2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                out.append((lang, " ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score))
    return sorted(out)


def cases():
    rng = random.Random(11)
    words = ["a", "b", "the", "The", "of\x01", "x\x00y", "É", "漢字", "|", "a\x0b", "w1", "w2", "w3"]
    passage = "one two three four five six seven eight nine ten"
    rows = [(None, "en"), ("", None), ("   \t", "en"), ("...", "xx"), ("solo", "a\tb"), ("x " * 5000, "en"), (passage + ". " + passage, "de")]
    rows += [(f"{rng.choice(words)} {passage} {rng.choice(words)}", rng.choice(["en", "en us", ""])) for _ in range(30)]
    rows += [("ring a ring a ring a ring", "de")] * 5
    for _ in range(150):
        rows.append((rng.choice([" ", ", ", "\t", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(1, 14))), rng.choice(["en", None, "a\tb", "\tq", "b\\t", "two words"])))
    return rows


@pytest.mark.parametrize("block, heavy", [(1 << 20, None), (200, None), (1 << 20, 0.0)])
def test_by_brute_force(spark, monkeypatch, block, heavy):
    """Blocks of any size and spread heads give the same counts."""
    if heavy is not None:
        # any heads may be spread
        monkeypatch.setattr(collocations, "shuffle_plan", lambda texts: ({"en\tone", "en\\sus\ttwo", "und\ta", "en\tx"}, {"en\tone two", "en\\sus\ttwo three", "\\tq\tthe the", "en\tx x"}, 7 * collocations.PART_BYTES))
    rows = cases()
    docs = spark.createDataFrame([(i, t, g, "clash") for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, words string")
    got = collocations.collocations(docs.repartition(5), least=4, block=block).collect()
    assert sorted((r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == brute(rows, 4)


def test_paths_are_passages(spark):
    passage = " ".join(f"p{i}" for i in range(300))
    rows = [(f"{passage} q{k}", "en") for k in range(6)] + [("o o o o o o o", "en")] * 3 + [("r s t u r s t u r s t u r s t u", "de")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string")
    found = collocations.paths(collocations.phrase_counts(docs, least=5)).collect()
    long = max(found, key=lambda r: len(r.words))
    assert " ".join(long.words) == passage and set(long.nodes) == {6} and set(long.edges) == {6} and len(long.edges) == 297
    assert sum(len(r.edges) for r in found) == 297 + 1 + 4


def test_ranks_and_empty(spark):
    rows = [("alpha beta gamma", "en")] * 5 + [("delta eps", "en")] * 5 + [("b c. b d", "fr")] * 4
    found = collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), least=4)
    got = [tuple(r) for r in collocations.ranked(found, 1).orderBy("lang").collect()]
    assert got == [("en", 1, "alpha beta gamma", 5, 5, 5, 25, 1000000), ("fr", 1, "b c", 4, 8, 4, 16, 666666)]
    none = spark.createDataFrame([], "text string, lang string")
    assert collocations.ranked(collocations.collocations(none)).count() == 0
