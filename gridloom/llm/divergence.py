r"""How sources of a language differ: divergence of term shares between sources, and the terms that stand out in each.

Terms are runs of ASCII letters and of code points beyond ASCII, A-Z lowered.
They are counted per task by language and source before anything moves; a
language keeps the terms that enough of its documents hold.  A group (a source
of a language) gives each kept term a share in fixed point, p = 1 +
floor(SCALE (count + 2) / (N + 2 V)), so a term that a group lacks has the same
p as any other it lacks: the group's baseline.

Divergence of two sources sums f(p, q) = floor((p - q)^2 / (p + q)) over all
kept terms, sparsely: V times f of the baselines; for the terms of one source a
correction that depends on its count and the other's baseline alone, summed
over the histogram of its shares; and a second correction for the terms that
both have, found term by term.  Nothing is summed for terms that neither has.

The terms that stand out are ranked by radix selection: histograms over the
bits of their values, BITS at a time from the highest, find each group's value
at the last rank; of the terms with just that value, if they are more than
WINDOW, histograms over their UTF-8 bytes, STEP at a time, find those that come
first.  What is left, a rank's worth and at most WINDOW ties, is sorted.

All arithmetic is in integers.  Tables that grow with the corpus are joined and
shuffled by (language, term); those with a row per source are broadcast if
their counted rows allow it.  The result of a language has a row for each two
of its sources, so a task may hold what belongs to one source, its histogram
and the other sources' baselines.

Defined cases: null texts, languages and sources count as ''; groups without
terms take part in pairs, with value 0 if their language keeps no term; rows
that repeat are documents each; other columns don't matter; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small
from .memory import lean, text_batches

#: A term is kept with so many documents of its language; shares are in parts of SCALE; ranks of the part `term`.
LEAST, SCALE, TOP = 10, 10**9, 10
#: Counts that a task holds before it hands them on.
HELD = 500_000
#: Radix selection: bits and bytes looked at together; ties that are sorted without further passes.
BITS, STEP, WINDOW = 11, 2, 1000
#: A value is under 2**VALUE_BITS, as f(p, q) is under p + q.
VALUE_BITS = 33
#: What isn't a term's byte ends one; A-Z become a-z (code points beyond ASCII have bytes from 0x80 on).
TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))

SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
found AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
),
kept AS (SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT doc) >= {LEAST}),
counts AS (SELECT f.lang, f.source, f.term, count(*) AS n FROM found f JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT g.lang, g.source, (SELECT count(*) FROM kept k WHERE k.lang = g.lang) AS v, coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0) AS n FROM groups g),
shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.n + 2 * s.v) AS p
  FROM sizes s JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
),
of_lang AS (
  SELECT k.lang, k.term, 1 + ({SCALE}::HUGEINT * (sum(c.n) + 2)) // (any_value(t.n) + 2 * any_value(t.v)) AS q
  FROM kept k JOIN counts c USING (lang, term) JOIN (SELECT lang, sum(n) AS n, max(v) AS v FROM sizes GROUP BY lang) t ON t.lang = k.lang GROUP BY k.lang, k.term
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce((
    SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM shares x JOIN shares y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source
  ), 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
),
terms AS (SELECT s.lang, s.source, s.term AS item, (s.p - q) * (s.p - q) // (s.p + q) AS value FROM shares s JOIN of_lang USING (lang, term) WHERE s.n > 0 AND s.p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) FROM terms
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in UTF-8."""
    return (text or "").encode().translate(TABLE).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it), per task; term is null in a row that only says that the group occurs."""

    def rows(counts: dict[tuple[str, str], tuple[Counter, Counter]]):
        for (lang, source), (n, docs) in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([source], pa.string()), pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([0], pa.int64())], names)
            found = list(n)
            for k in range(0, len(found), 100_000):
                some = found[k : k + 100_000]
                same = lambda x: pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(some), np.int32)), pa.array([x], pa.string())).cast(pa.string())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())], names)

    def run(batches):
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for text, lang, source in zip(batch["text"], batch["lang"].to_pylist(), batch["source"].to_pylist()):
                n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                found = terms(text.as_py())
                n.update(found)
                docs.update(set(found))
                held += len(n) - before
                if held >= HELD:
                    yield from rows(counts)
                    counts, held = {}, 0
        yield from rows(counts)

    names = ["lang", "source", "term", "n", "docs"]
    text_batches(docs.sparkSession)
    read = docs.select("text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    return read.mapInArrow(lean(run), "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * count / total) for count <= total, three digits at a time, so that no product leaves 64 bits."""
    value, rest = F.lit(0).cast("long"), count
    for _ in range(3):
        value, rest = value * 1000 + F.call_function("div", rest * 1000, total), (rest * 1000) % total
    return value + 1


def distance(p: Column, q: Column) -> Column:
    """f of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Audit:
    """The tables behind a report: entries (a row per kept term and source that has it), groups (a row per source) and langs."""

    def __init__(self, docs: DataFrame, least: int = LEAST):
        counted = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        held = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.collect_list(F.struct("source", "n")).alias("of"))
        # a row per kept term, with its counts by source; one row per language, without a term, has all its sources
        self.kept = cut(held.where(F.col("term").isNull() | (F.col("docs") >= least)).drop("docs"))
        exploded = self.kept.select("lang", "term", "all", F.explode("of").alias("x")).select("lang", "term", "all", "x.source", "x.n")
        sizes = exploded.groupBy("lang", "source").agg(F.sum("n").alias("size"))
        v = self.kept.groupBy("lang").agg(F.count("term").alias("v"), F.sum("all").alias("lang_size"))
        self.n_langs = v.count()
        groups = sizes.join(small(v, self.n_langs), "lang")
        base = share(F.lit(2).cast("long"), F.col("size") + 2 * F.col("v"))
        self.groups = cut(groups.withColumn("base", F.when(F.col("v") > 0, base).otherwise(1)))
        self.n_groups = self.groups.count()
        entries = exploded.where(F.col("term").isNotNull()).join(small(self.groups, self.n_groups), ["lang", "source"])
        p = share(F.col("n") + 2, F.col("size") + 2 * F.col("v"))
        q = share(F.col("all") + 2, F.col("lang_size") + 2 * F.col("v"))
        self.entries = entries.select("lang", "source", "term", p.alias("p"), q.alias("q"), "base")

    # divergence of sources

    def one_sided(self) -> DataFrame:
        """lang, source, item, part: over the terms of source, what they add to the divergence from item if item lacks them all."""
        histogram = self.entries.groupBy("lang", "source", "p").count().groupBy("lang", "source").agg(F.collect_list(F.struct("p", "count")).alias("shares"))
        others = self.groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "base"))).alias("others"))
        rows = self.groups.select("lang", "source", "base", "v").join(histogram, ["lang", "source"], "left").join(small(others, self.n_langs), "lang")

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    item, base = [x["source"] for x in row["others"]], np.array([x["base"] for x in row["others"]], np.int64)
                    own, part = np.int64(row["base"]), np.zeros(len(item), np.int64)
                    for x in row["shares"] or ():
                        part += x["count"] * (f(np.int64(x["p"]), base) - f(own, base))
                    whole = part + row["v"] * f(own, base)
                    other = np.array([x != row["source"] for x in item])
                    item = pa.array(item, pa.string()).filter(pa.array(other))
                    same = lambda x: pa.array([x] * len(item), pa.string())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(row["lang"]), same(row["source"]), item, pa.array(whole[other])], ["lang", "source", "item", "part"])
                    yield pa.RecordBatch.from_arrays([same(row["lang"]), item, same(row["source"]), pa.array(part[other])], ["lang", "source", "item", "part"])

        return rows.mapInArrow(run, "lang string, source string, item string, part long")

    def two_sided(self) -> DataFrame:
        """lang, source, item, part: over the terms that both have, what is added to that; source < item."""
        by_term = self.entries.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "base"))).alias("of")).where(F.size("of") > 1)
        names = ["lang", "source", "item", "part"]

        def rows(sums: dict[str, Counter]):
            for lang, pairs in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*[(lang, a, b, n) for (a, b), n in pairs.items()]), [pa.string()] * 3 + [pa.int64()])], names)

        def run(batches):
            sums: dict[str, Counter] = {}
            for batch in batches:
                lang, lists = batch["lang"].to_pylist(), batch["of"]
                ends, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
                number = flat.field("source").dictionary_encode()
                code, known = number.indices.to_numpy(), number.dictionary.to_pylist()
                p, base = flat.field("p").to_numpy(), flat.field("base").to_numpy()
                start = np.concatenate([[0], np.cumsum(ends)])
                of_lang = {x: k for k, x in enumerate(dict.fromkeys(lang))}
                lang_code = np.repeat(np.array([of_lang[x] for x in lang]), ends)
                place = np.arange(len(p)) - np.repeat(start[:-1], ends)
                n_after = np.repeat(ends, ends) - place - 1
                for gap in range(1, int(ends.max(initial=0))):  # each entry with the one `gap` places on in its term's list
                    i = np.flatnonzero(n_after >= gap)
                    j = i + gap
                    more = f(p[i], p[j]) - f(p[i], base[j]) - f(base[i], p[j]) + f(base[i], base[j])
                    key, of = np.unique((lang_code[i] * len(known) + code[i]) * len(known) + code[j], return_inverse=True)
                    total = np.zeros(len(key), np.int64)
                    np.add.at(total, of, more)
                    langs = list(of_lang)
                    for x, n in zip(key.tolist(), total.tolist()):
                        x, b = divmod(x, len(known))
                        x, a = divmod(x, len(known))
                        sums.setdefault(langs[x], Counter())[known[a], known[b]] += n
                if sum(map(len, sums.values())) >= HELD:
                    yield from rows(sums)
                    sums = {}
            yield from rows(sums)

        return by_term.select("lang", "of").mapInArrow(run, "lang string, source string, item string, part long")

    def pairs(self) -> DataFrame:
        """lang, source, item, value of each two sources of a language, either way round."""
        both = cut(self.two_sided().groupBy("lang", "source", "item").agg(F.sum("part").alias("part")))
        turned = both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "part")
        return self.one_sided().unionByName(both).unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("part").alias("value"))

    # terms that stand out

    def standing_out(self, top: int = TOP) -> DataFrame:
        """lang, source, item, value of the terms of the first `top` ranks of each source, and of those that tie with the last for want of passes."""
        made = self.entries.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
        return select_first(cut(made), self.n_groups, top)

    def report(self, top: int = TOP) -> DataFrame:
        def ranks(rows: DataFrame, part: str) -> DataFrame:
            order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")  # strings are ordered by their UTF-8 bytes
            return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

        return ranks(self.pairs(), "pair").unionByName(ranks(self.standing_out(top), "term").where(F.col("rank") <= top))


def narrowed(rows: DataFrame, at: DataFrame, digit: Column, last: bool) -> DataFrame:
    """One pass of a radix selection: of each group in `at` (with `need`, how many ranks are open), the digit at which they run out.

    Returns lang, source, digit, need (ranks still open at that digit) and ties
    (rows at it); digits count from the highest, or with last=False from the lowest.
    """
    histogram = rows.groupBy("lang", "source", digit.alias("digit")).count()
    order = Window.partitionBy("lang", "source").orderBy(F.desc("digit") if last else F.asc("digit")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("count").over(order), F.lit(0))
    found = histogram.withColumn("before", before).join(at.select("lang", "source", "need"), ["lang", "source"])
    # the digit where the ranks run out, or the last one of a group with fewer rows than ranks
    return found.where(F.col("before") < F.col("need")).groupBy("lang", "source").agg(F.max_by(F.struct("digit", (F.col("need") - F.col("before")).alias("need"), F.col("count").alias("ties")), "before").alias("x")).select("lang", "source", "x.*")


def select_first(rows: DataFrame, n_groups: int, top: int) -> DataFrame:
    """The rows (lang, source, item, value >= 0) of the `top` highest values of each group, equal values by the least item, and at most WINDOW ties more."""
    keys = ["lang", "source"]
    value, item = F.col("value"), F.encode(F.col("item"), "UTF-8")
    at = rows.select(*keys).distinct().withColumns({"need": F.lit(top).cast("long"), "threshold": F.lit(0).cast("long")})
    for low in range(VALUE_BITS - BITS, -1, -BITS):
        inside = rows.join(small(at.select(*keys, "threshold"), n_groups), keys).where(F.shiftright(value, low + BITS) == F.shiftright("threshold", low + BITS))
        found = narrowed(inside, at, F.shiftright(value, low).bitwiseAND((1 << BITS) - 1), last=True)
        moved = at.drop("need", "ties").join(found, keys)
        at = cut(moved.select(*keys, "need", "ties", (F.col("threshold") + F.shiftleft("digit", low)).alias("threshold")))
    above = rows.join(small(at.select(*keys, "threshold"), n_groups), keys)
    ties = above.where(value == F.col("threshold"))
    at, step, settled = at.withColumns({"prefix": F.lit(b""), "ended": F.lit(False)}), 0, []
    while True:
        # groups whose ties are few, or all needed, need no further pass
        few = (F.col("ties") <= WINDOW) | (F.col("ties") <= F.col("need"))
        settled.append(at.where(few).select(*keys, "threshold", "prefix", "ended"))
        at = at.where(~few)
        if at.isEmpty():
            break
        inside = ties.drop("threshold").join(small(at.select(*keys, "prefix"), n_groups), keys).where(F.substring(item, 1, STEP * step) == F.col("prefix"))
        digit = F.substring(item, STEP * step + 1, STEP)  # shorter at an item's end, which comes first
        found = narrowed(inside, at, digit, last=False)
        step += 1
        ended = F.length("digit") < STEP  # there is one such item
        at = cut(at.drop("need", "ties", "ended").join(found, keys).select(*keys, "threshold", "need", F.when(ended, F.lit(1)).otherwise(F.col("ties")).alias("ties"), F.concat("prefix", "digit").alias("prefix"), ended.alias("ended")))
    last = reduce(DataFrame.unionByName, settled)
    chosen = rows.join(small(last, n_groups), keys)
    first = F.when(F.col("ended"), item).otherwise(F.substring(item, 1, F.length("prefix")))
    return chosen.where((value > F.col("threshold")) | (value == F.col("threshold")) & (first <= F.col("prefix"))).select(*keys, "item", "value")


def report(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank."""
    return Audit(docs, least).report(top)
