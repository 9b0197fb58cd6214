r"""Personal data by weak supervision, with DataFrame functions only.

Regular expressions of four kinds (email, ip, card, phone) give the base spans.
Looser expressions give further candidates: identity numbers, local telephone
numbers, hardware addresses, names of people and streets.  On every candidate
labelers vote for, against, or not at all: the strict expressions, gazetteers
(top-level domains, card prefixes, area and country codes, first names, street
words), checksums and ranges, words in its context, base spans elsewhere in the
document, and the look of a placeholder.  Expectation-maximisation over the
counts of vote patterns (at most KINDS * 3**6 rows, the only thing the driver
gets) estimates how often each labeler is right on each class, and with it each
pattern's probability; these train the final span classifier, additive log-odds
of shape and context features fitted on their counts.  The classifier alone
decides: candidates to which it gives SURE or more are added as spans, whatever
their votes were; base spans always stay.

Spans come from the pieces that a split leaves and the matches it drops, so no
Python ever sees a text; the text is read once, its candidates checkpointed and
taken row by row, so time grows with a text's length and its spans' number.

Defined cases: null and empty texts have no spans and the digest of ""; texts
are searched whole; a null doc_id stays null; there is one row per row; rows
that repeat and rows with one doc_id are each searched by themselves; a looser
candidate that meets a base span is none, and of two that meet the earlier
kind's is kept; other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Fixed patterns.  Groups repeat possessively, or a few times at most: Java takes other repeated groups by recursion, which long texts overflow.  A match of the base patterns begins where the run it begins with does, or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
#: Looser candidates: national identity numbers, local telephone numbers, host addresses of six groups, names, streets.
IDS = r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
NUMBERS = r"(?<![0-9A-Za-z.+)(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])"
ADDRESSES = r"(?<![0-9A-Za-z:.-])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Za-z:-])"
#: Gazetteers.
DOMAINS = "com org net edu gov mil int info biz name io co de fr es it uk us ca au nl eu ch at be se no dk pl pt br mx jp cn in".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 354 358 380 420 421".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9])|35|62)"
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Señor Señora".split()
FIRST_NAMES = (
    "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa "
    "Anthony Margaret Mark Sandra Paul Ashley Steven Emily Andrew Donna Joshua Michelle Kevin Carol Brian Amanda George Melissa Edward Laura Peter Anna Hans Klaus Ursula Monika "
    "Jürgen Petra Pierre Marie Jean Nathalie Michel Isabelle José María Carlos Carmen Juan Ana Luis Elena"
).split()
STREETS = "Street Avenue Road Lane Drive Boulevard Court Terrace Square".split()
NOT_NAMES = "Street Avenue Road Lane Drive University College Company Institute Hospital Airport River Lake Mountain Award Prize Theorem Effect Day Week Act".split()
CAPITAL = r"\p{Lu}\p{Ll}+"
NAMES = rf"(?<![\p{{L}}-])(?=\p{{Lu}})(?:(?:{'|'.join(TITLES)})\.?\x20(?:{CAPITAL}\x20)?|(?:{'|'.join(FIRST_NAMES)})\x20(?:\p{{Lu}}\.\x20)?){CAPITAL}(?![\p{{L}}-])"
STREET = rf"(?<![0-9\p{{L}}.,-])[1-9][0-9]{{0,4}}\x20(?:{CAPITAL}\x20){{1,3}}(?:{'|'.join(STREETS)})(?![\p{{L}}-])"
ADDED = ("id", "number", "address", "name", "street")
KINDS = (*BASE, *ADDED)
#: Words before a span that speak for it, by kind, and against any.
FOR = {
    "email": "email e-mail mail contact write reach address correo courriel",
    "ip": "ip host server address login client addr from",
    "card": "card visa mastercard amex credit debit payment pay karte tarjeta carte",
    "phone": "phone tel telephone call mobile cell fax whatsapp telefon handy",
    "id": "ssn social security identity passport taxpayer id",
    "number": "phone tel telephone call mobile cell fax telefon",
    "address": "mac hardware ethernet device address",
    "name": "name signed dear contact patient employee customer regards sincerely born called resident",
    "street": "address lives living home residence street ship deliver located reside resident",
}
AGAINST = "version isbn order invoice build figure section chapter page issue serial part model ticket theorem museum award university novel example"
#: Candidates with such a probability, at least, are added; rounds of expectation-maximisation.
SURE, ROUNDS = 0.9, 30
CONTEXT = 32
#: Matches of a text that are placed together; a text of very many is placed block by block.
BLOCK = 512


SPANS = "array<struct<kind:string,start:bigint,end:bigint,what:string,before:string>>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<gap, what>>: the matches of a pattern, and what lies between each and the one before."""
    what = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(what)), what, lambda g, m: F.struct(g.alias("gap"), m.alias("what")))


def spans(found: Column, kind: str) -> Column:
    """array<struct<kind, start, end, what, before>> of matches, in code points; before: the CONTEXT code points before each."""
    none = F.array().cast(SPANS)
    size = lambda x: F.length(x).cast("long")
    tail = lambda *x: F.right(F.concat(*x), F.lit(CONTEXT))

    def step(state, x):
        start, before = state["at"] + size(x["gap"]), tail(state["tail"], x["gap"])
        end = start + size(x["what"])
        one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["what"].alias("what"), F.lower(before).alias("before"))
        return F.struct(end.alias("at"), tail(before, x["what"]).alias("tail"), F.concat(state["spans"], F.array(one)).alias("spans"))

    def place(found, at):
        return F.aggregate(found, F.struct(at["at"].alias("at"), at["tail"].alias("tail"), none.alias("spans")), step, lambda s: s["spans"])

    def over(state, found):
        """Where the next block begins, and what stands before it."""
        ends = F.aggregate(found, F.struct(state["at"].alias("at"), state["tail"].alias("tail")), lambda s, x: F.struct((s["at"] + size(x["gap"]) + size(x["what"])).alias("at"), tail(s["tail"], x["gap"], x["what"]).alias("tail")))
        return F.struct(ends["at"].alias("at"), ends["tail"].alias("tail"), F.concat(state["all"], F.array(F.struct(state["at"].alias("at"), state["tail"].alias("tail")))).alias("all"))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("tail"))
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), F.lit(BLOCK)), lambda i: F.slice(found, i, F.lit(BLOCK)))
    starts = F.aggregate(blocks, F.struct(first["at"].alias("at"), first["tail"].alias("tail"), F.array().cast("array<struct<at:bigint,tail:string>>").alias("all")), over, lambda s: s["all"])
    return F.flatten(F.zip_with(blocks, starts, place))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Does a string of digits pass the checksum?"""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, F.expr("0") + d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def in_ip_range(what: Column) -> Column:
    """Parts are at most 255; leading zeros don't count."""
    return F.forall(F.split(what, r"\."), lambda p: F.regexp_like(p, F.lit(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$")))


def valid(span: Column) -> Column:
    """Is a match of a base pattern a base span?"""
    kind, what = span["kind"], span["what"]
    n = F.length(digits(what))
    card = n.between(14, 19) & luhn(digits(what))
    return F.when(kind == "email", F.lit(True)).when(kind == "ip", in_ip_range(what)).when(kind == "card", card).when(kind == "phone", n.between(10, 15)).otherwise(F.lit(False))


def candidates(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, all (matches of the base patterns, with `base` where they are base spans, and looser ones), for each document."""
    text = F.col("text")
    if_any = lambda test, pattern: F.when(test, matches(text, pattern)).otherwise(F.array().cast("array<struct<gap:string,what:string>>"))
    like = lambda pattern: F.regexp_like(text, F.lit(pattern))
    found = {
        "email": if_any(F.contains(text, F.lit("@")), EMAIL),
        "ip": if_any(like(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), IP),
        "card": if_any(like(r"[0-9](?:[\x20-]?[0-9]){13}"), CARD),
        "phone": if_any(like(r"\+[0-9]"), PHONE),
        "id": if_any(like(r"[0-9]-[0-9]{2}-[0-9]"), IDS),
        "number": if_any(like(r"[0-9][.-][0-9]{4}"), NUMBERS),
        "address": if_any(like(r":[0-9A-Fa-f]{2}:[0-9A-Fa-f]{2}:"), ADDRESSES),
        "name": if_any(like(rf"(?:{CAPITAL}|\.)\x20{CAPITAL}"), NAMES),
        "street": if_any(like(rf"[0-9]\x20{CAPITAL}\x20{CAPITAL}"), STREET),
    }
    with_base = lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "what", "before")], valid(s).alias("base"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *[found[k].alias(k) for k in KINDS])  # by itself, so that a pattern is looked for once
    rows = rows.select("row", "doc_id", F.concat(*[F.when(F.size(k) > 0, spans(F.col(k), k)).otherwise(F.array().cast(SPANS)) for k in KINDS]).alias("all"))
    return rows.select("row", "doc_id", F.transform("all", with_base).alias("all"))


def meeting(which: Column) -> Column:
    """Does a span meet another of its row for which `which` holds?  Either one that begins before it and ends within or after it, or one that begins within it."""
    order = Window.partitionBy("row").orderBy("start")
    last_end = F.max(F.when(which, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    next_start = F.min(F.when(which, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    return F.coalesce(last_end > F.col("start"), F.lit(False)) | F.coalesce(next_start < F.col("end"), F.lit(False))


def described(found: DataFrame) -> DataFrame:
    """row, kind, start, end, what, before, base, company of each candidate; looser ones that meet a base span are none."""
    each = found.filter(F.size("all") > 0).select("row", F.inline("all"))
    n_base = F.sum(F.col("base").cast("int")).over(Window.partitionBy("row"))
    each = each.withColumns({"meets": meeting(F.col("base")), "company": n_base > F.col("base").cast("int")})
    return each.filter(~(F.col("kind").isin(*ADDED) & F.col("meets"))).drop("meets")


def words_of(names: str) -> str:
    return r"(?:^|[^a-z])(?:" + "|".join(names.split()) + r")(?:[^a-z]|$)"


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def gazetteer(s: Column) -> Column:
    """The vote of top-level domains, card prefixes, country and area codes, number ranges, first names and street words."""
    kind, what, number = s["kind"], s["what"], digits(s["what"])
    domain = F.substring_index(F.lower(what), ".", -1)
    area = F.regexp_like(number, F.lit("^[2-9][0-9]{2}[2-9]"))
    words = F.split(what, "\\x20")
    among = lambda names: F.arrays_overlap(words, F.array(*[F.lit(c) for c in names]))
    return (
        F.when(kind == "email", vote(domain.isin(*DOMAINS), F.regexp_like(domain, F.lit("[0-9]"))))
        .when(kind == "card", vote(F.regexp_like(number, F.lit(ISSUERS)), F.regexp_like(number, F.lit("^0"))))
        .when(kind == "phone", vote(F.exists(F.array(*[F.lit(c) for c in CALLING]), lambda c: number.startswith(c)), number.startswith("0")))
        .when(kind == "number", vote(area, ~area))
        .when(kind == "id", vote(~F.regexp_like(number, F.lit("^(?:000|666|9)")), F.regexp_like(number, F.lit("^(?:000|666)"))))
        .when(kind == "name", F.when(among(NOT_NAMES), -1).when(among(FIRST_NAMES), 1).otherwise(0))
        .when(kind == "street", vote(F.substring_index(what, " ", -1).isin(*STREETS[:6]), F.regexp_like(what, F.lit(r"^(?:19|20)[0-9]{2}\x20"))))
        .otherwise(0)
    )


def context(s: Column) -> Column:
    """The vote of the words just before."""
    near = F.lit(False)
    for k, names in FOR.items():
        near = near | ((s["kind"] == k) & F.regexp_like(s["before"], F.lit(words_of(names))))
    return vote(near, F.regexp_like(s["before"], F.lit(words_of(AGAINST))))


def placeholder(s: Column) -> Column:
    """The vote against digits that repeat or follow each other."""
    return F.when(F.regexp_like(digits(s["what"]), F.lit(r"([0-9])\1{5}|0123456|1234567|2345678|3456789|9876543")), -1).otherwise(0)


def votes(s: Column) -> list[Column]:
    """For (1), against (-1) or neither (0), by: expression, gazetteer, checksum or range, context, base spans elsewhere in the document, the look of a placeholder."""
    kind, what, number = s["kind"], s["what"], digits(s["what"])
    titled = F.regexp_like(what, F.lit(rf"^(?:{'|'.join(TITLES)})\.?\x20"))
    strict = F.when(s["base"], 1).when(kind.isin(*BASE), -1).otherwise(F.when((kind == "name") & titled, 1).otherwise(0))  # a loose expression alone says nothing
    check = (
        F.when(kind == "card", vote(luhn(number), ~luhn(number)))
        .when(kind == "ip", vote(in_ip_range(what) & ~F.regexp_like(what, F.lit(r"^0+\.")), ~in_ip_range(what)))
        .when(kind == "phone", vote(F.length(number).between(10, 15), ~F.length(number).between(7, 15)))
        .when(kind == "id", vote(F.lit(False), F.regexp_like(what, F.lit("^000|-00-|-0000$"))))
        .otherwise(0)
    )
    company = F.when(s["company"], 1).otherwise(0)
    return [strict, gazetteer(s), check, context(s), company, placeholder(s)]


def reliabilities(counts: list[tuple[str, tuple[int, ...], int]]) -> dict[tuple[str, tuple[int, ...]], float]:
    """Probability of each (kind, votes) to be personal data, by expectation-maximisation over how labelers vote on either class."""
    if not counts:
        return {}
    n_labelers = len(counts[0][1])
    # begin with the majority; a kind has its own prior, a labeler the same habits for all kinds
    p = {(k, v): 1 / (1 + math.exp(-1.5 * sum(v))) for k, v, _ in counts}
    for _ in range(ROUNDS):
        habit = [[{x: 1.0 for x in (-1, 0, 1)} for _ in (0, 1)] for _ in range(n_labelers)]
        for j in range(n_labelers):  # as prior counts: rather right than wrong
            habit[j][1][1] += 4.0
            habit[j][0][-1] += 4.0
        prior = {k: [1.0, 1.0] for k, _, _ in counts}
        for k, v, n in counts:
            q = p[k, v]
            prior[k][1] += n * q
            prior[k][0] += n * (1 - q)
            for j, x in enumerate(v):
                habit[j][1][x] += n * q
                habit[j][0][x] += n * (1 - q)
        for k, v, _ in counts:
            odds = math.log(prior[k][1] / prior[k][0])
            for j, x in enumerate(v):
                yes, no = habit[j][1], habit[j][0]
                odds += math.log(yes[x] / sum(yes.values())) - math.log(no[x] / sum(no.values()))
            p[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return p


def features(s: Column) -> dict[str, Column]:
    """Shape and context features of the final classifier, each a category of a bounded number of values.

    The signs of a span are a set out of those that its kind's expression allows (seven for an email, five for a phone), so
    `signs` has fewer than 2**8 values whatever the corpus holds.
    """
    length = s["end"] - s["start"]
    signs = F.array_sort(F.array_distinct(F.split(F.regexp_replace(s["what"], r"[\p{L}0-9]", ""), "")))
    return {
        "kind": s["kind"],
        "digits": F.least(F.length(digits(s["what"])), F.lit(20)).cast("string"),
        "length": F.floor(F.least(length, F.lit(48)) / 4).cast("string"),
        "signs": F.array_join(signs, ""),
        "company": F.concat_ws("/", s["kind"], s["company"].cast("string")),
        "known": F.concat_ws("/", s["kind"], gazetteer(s).cast("string")),
        "spoken": F.concat_ws("/", s["kind"], context(s).cast("string")),
        "invented": placeholder(s).cast("string"),
    }


def find(docs: DataFrame, sure_from: float = SURE) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end, base>> by start and kind, for each document."""
    found = cut(candidates(docs))
    each = cut(described(found))
    span = F.struct(*[c for c in each.columns if c != "row"])
    v = votes(span)
    f = features(span)
    # bounded: kinds times vote patterns times feature values of a few characters, counted before they move
    patterns = each.select("kind", *[c.alias(f"v{i}") for i, c in enumerate(v)], *[c.alias(f"f_{n}") for n, c in f.items()])
    counted = cut(patterns.groupBy(*patterns.columns).count())
    named = [f"v{i}" for i in range(len(v))]
    by_votes = [(r["kind"], tuple(r[n] for n in named), r["n"]) for r in counted.groupBy("kind", *named).agg(F.sum("count").alias("n")).collect()]
    sure = reliabilities(by_votes)
    log_odds: dict[str, dict[str, float]] = {}
    if sure:
        known = counted.sparkSession.createDataFrame([(k, *x, p) for (k, x), p in sure.items()], ", ".join(["kind string", *[f"{n} int" for n in named], "p double"]))
        weighted = counted.join(F.broadcast(known), ["kind", *named])
        for name in f:
            column = F.col(f"f_{name}")
            sums = weighted.groupBy(column.alias("x")).agg(F.sum(F.col("count") * F.col("p")).alias("yes"), F.sum(F.col("count") * (1 - F.col("p"))).alias("no"))
            rows = [(r["x"], r["yes"], r["no"]) for r in sums.collect()]
            yes, no = sum(r[1] for r in rows) + len(rows), sum(r[2] for r in rows) + len(rows)
            log_odds[name] = {x: math.log((a + 1) / yes) - math.log((b + 1) / no) for x, a, b in rows}
    total_yes = sum(n * sure[k, x] for k, x, n in by_votes)
    total_no = sum(n * (1 - sure[k, x]) for k, x, n in by_votes)
    bias = math.log((total_yes + 1) / (total_no + 1))

    odds = F.lit(bias)
    for name, column in f.items():
        if log_odds.get(name):
            known = F.create_map(*[F.lit(x) for pair in sorted(log_odds[name].items()) for x in pair])
            odds = odds + F.coalesce(F.try_element_at(known, column), F.lit(0.0))
    # a dropped match of a base pattern stays dropped; of the looser candidates those that the classifier trusts, of those that meet the earlier kind's
    more = each.filter(F.col("kind").isin(*ADDED)).filter(1 / (1 + F.exp(-odds)) >= sure_from).select("row", "kind", "start", "end", "base")
    meets = [(F.col("kind").isin(*ADDED[k + 1 :]) & meeting(F.col("kind") == kind)) for k, kind in enumerate(ADDED[:-1])]
    more = more.withColumn("meets", functools.reduce(lambda x, y: x | y, meets)).filter(~F.col("meets")).drop("meets")
    kept = each.filter("base").select(*more.columns).unionByName(more)
    nth = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    sortable = F.array_sort(F.collect_list(F.struct("start", nth.alias("nth"), "end", "kind", "base")))
    spans_of = kept.groupBy(F.col("row").alias("of")).agg(F.transform(sortable, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))).alias("spans"))
    rows = found.select("row", "doc_id").join(spans_of, F.col("row") == F.col("of"), "left")
    return rows.select("doc_id", F.coalesce("spans", F.array().cast("array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    joined = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda test, name: F.size(F.filter("spans", test)).cast("long").alias(name)
    of_kind = lambda k: lambda s: s["kind"] == k
    return find(docs).select(
        "doc_id",
        *[count(of_kind(k), f"n_{k}") for k in BASE],
        F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count(lambda s: ~s["base"], "n_added"),
    )
