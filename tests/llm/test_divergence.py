"""The divergence audit against plain dictionaries."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n int, term string, value string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least=10, top=10):
    rows = [(text or "", lang or "", source or "") for _, text, lang, source, *_ in rows]
    counts, documents = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        counts[lang, source].update(found)
        counts[lang, None].update(found)
        documents[lang].update(set(found))
    kept = {lang: {t for t, n in documents[lang].items() if n >= least} for _, lang, _ in rows}
    p = {}
    for (lang, source), own in counts.items():
        size, v = sum(n for t, n in own.items() if t in kept[lang]), len(kept[lang])
        p[lang, source] = {t: 1 + 10**9 * (own[t] + 2) // (size + 2 * v) for t in kept[lang]}
    f = lambda x, y: (x - y) ** 2 // (x + y)
    out = set()
    for lang, source in {(lang, source) for _, lang, source in rows}:
        own = p[lang, source]
        pairs = [(-sum(f(own[t], p[lang, other][t]) for t in own), other.encode()) for at, other in {(at, s) for _, at, s in rows} if at == lang and other != source]
        terms = [(-f(own[t], p[lang, None][t]), t.encode()) for t in own if counts[lang, source][t] and own[t] > p[lang, None][t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1)}
    return out


def made(n=600, seed=3):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "delta", "Émile", "straße", "日本語", "eins", "zwei", "l", "ß", "İx", "x1y2z", "don't", *[f"w{chr(97 + k)}{chr(97 + j)}" for k in range(12) for j in range(20)]]
    rows = []
    for i in range(n):
        source = rng.choice(["big"] * 6 + ["s1", "s2", "Zoo", "ä", None, "only"])
        text = " ".join(rng.choice(words[: rng.randint(3, len(words))]) for _ in range(rng.randint(0, 30)))
        rows.append((i, rng.choice([text, text, text, None if i % 9 == 0 else text]), rng.choice(["en", "en", "de", None]), source, 1, "x", "y"))
    rows += [(5, "", "xx", "a", None, None, None), (None, "12 34 -", "xx", "b", None, None, None), (5, None, "xx", None, None, None, None)]  # a language without kept terms
    return rows


@pytest.mark.parametrize("held, window", [(divergence.HELD, divergence.WINDOW), (40, 3)])
def test_report_against_plain_one(spark, monkeypatch, held, window):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "WINDOW", window)
    rows = made()
    got = divergence.report(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_ties_are_refined_by_bytes(spark, monkeypatch):
    """One source has many terms of one value, with long common beginnings, ends in the middle of others, and code points of several bytes."""
    monkeypatch.setattr(divergence, "WINDOW", 2)
    terms = [f"common{'a' * k}" for k in range(30)] + [f"common{x}{y}" for x in "zéß" for y in "abcé日"]
    rows = [(i, " ".join(terms), "en", "odd", 1, "", "") for i in range(10)] + [(i, "plain words here", "en", "rest", 1, "", "") for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for top in (7, 31):
        got = divergence.report(docs, top=top)
        assert {tuple(r) for r in got.collect()} == plain(rows, top=top)
    audit = divergence.Audit(docs)
    assert audit.standing_out(7).where(F.col("source") == "odd").count() <= 7 + 2


def test_shares_are_exact(spark):
    cases = [(2, 4), (1, 3), (7, 7), (123456789012, 987654321098), (3_000_000_000_000_001, 9_000_000_000_000_000), (2, 9_000_000_000_000_000)]
    got = spark.createDataFrame(cases, "c long, n long").select(divergence.share(F.col("c"), F.col("n")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * c // n for c, n in cases]


def test_empty_table(spark):
    assert divergence.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_radix_selection_of_values(spark):
    rng = random.Random(6)
    rows = [("l", f"s{rng.randint(0, 3)}", f"t{i:05d}", rng.choice([rng.randint(0, 2**31), rng.randint(0, 50), 7])) for i in range(3000)]
    frame = spark.createDataFrame(rows, "lang string, source string, item string, value long")
    got = divergence.select_first(frame, 4, 25).collect()
    for source in {r[1] for r in rows}:
        want = sorted(((-v, i) for _, s, i, v in rows if s == source))[:25]
        assert sorted((-r.value, r.item) for r in got if r.source == source)[:25] == want
