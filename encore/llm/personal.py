"""Personal data in texts by weak supervision, in DataFrame expressions only.

1. Base spans: e-mail addresses, IP numbers, payment cards and phone numbers by their patterns, leftmost and without
   overlap for each kind; matches that fail a kind's check are dropped.
2. Candidates: the base spans, and looser matches, such as numbers that a base match has swallowed, grouped digits and
   addresses with `at` and `dot` spelled out.
3. Six labelers vote yes (1), no (0) or abstain (null) on each candidate: a strict pattern, a checksum or range, a
   gazetteer (domain endings, card issuers, reserved networks, country codes), words before it that speak for the
   kind, words before it that speak against, and free-standing bounds.
4. Votes are counted by pattern, at most 3^6 for each kind, and expectation-maximisation over the counts estimates how
   often the kind is real and how often each labeler is right on real and on other candidates.
5. The posteriors of all candidates train the final classifier, naive Bayes over votes and shapes of a span. Looser
   candidates that it takes with at least even odds, and that overlap no base span, are added, leftmost first.

Positions are code points, ends exclusive. Defined cases: a null text is empty; texts without candidates have no spans;
repeated rows are treated alike; a null doc_id is kept; extra columns are ignored. Patterns repeat possessively, so very
long runs neither overflow the stack nor take quadratic time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.sources.stage import staged

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, with what keeps them linear; \G is where the match before ended. Cards are whole runs
#: of digits of the right number.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns of candidates.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[({]at[\])}]\x20?|\x20at\x20)[A-Za-z0-9-]++"
             r"(?:(?:\x20?[\[({]dot[\])}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:[\x20]?\.[\x20]?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9.])(?:[0-9]{4}[.\x20-][0-9]{4}[.\x20-][0-9]{4}[.\x20-][0-9]{2,7}|[0-9]{14,19})(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])",
}
#: Strict patterns, gazetteers and context words of the labelers.
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}$",
    "ip": r"^[1-9][0-9]{0,2}(\.(0|[1-9][0-9]{0,2})){3}$",
    "card": r"^([0-9]{15,16}|[0-9]{4}([\x20-])[0-9]{4}\2[0-9]{4}\2[0-9]{4})$",
    "phone": r"^\+[1-9][0-9]{0,2}[\x20.-]?(\([0-9]{2,4}\)|[0-9]{2,4})([\x20.-][0-9]{2,4}){2,3}$",
}
LISTED = {
    "email": r"(?i)(\.|dot\x20|dot[\])}]\x20?)(com|net|org|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it|nl|co|us)$",
    "ip": r"^(?!0|10\.|127\.|255\.|2(2[4-9]|[3-5][0-9])\.)",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)",
    "phone": r"^(\+(1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\()",
}
FOR = {
    "email": r"(?i)(e-?mail|mail|contact|write|reach|courriel|correo|kontakt)",
    "ip": r"(?i)(\bip\b|host|server|address|login|client|adresse|direcci)",
    "card": r"(?i)(card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta)",
    "phone": r"(?i)(tel|phone|call|fax|mobile|cell|whatsapp|t.l.phone|telefon|tel.fono|anruf)",
}
AGAINST = r"(?i)(version|\bv\.?\s*$|isbn|issn|order|invoice|section|chapter|figure|page|serial|hash|build|release)"
CARD_DIGITS, PHONE_DIGITS = (14, 19), (10, 15)
LABELERS = 6
TURNS = 25
CONTEXT = 40


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum of card numbers."""
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return total + twice

    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0)


def passes(kind: str, value: Column) -> Column:
    """The check of a kind on a matched string."""
    digits = _digits(value)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return F.regexp_replace(value, " ", "").rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(*CARD_DIGITS), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(*PHONE_DIGITS)
    return value.rlike(r"[A-Za-z0-9]$")


def matches(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, row, and for each kind the base and the loose matches, in order); one row for each row of docs.

    A match is (value, gap, before, after): gap is the length of the text since the match before.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    might = {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike(r"[0-9]\.[0-9]"),
             "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")}
    loosely = {"email": text.rlike(r"(?i)at[\])}\x20]"), "phone": text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
               "ip": text.rlike(r"[0-9]\x20?\.\x20?[0-9]"), "card": text.rlike(r"[0-9]{4}[.\x20-]?[0-9]{4}")}
    found = {}
    for name, patterns, when in (("base", PATTERNS, might), ("loose", LOOSE, loosely)):
        for k in KINDS:
            found[f"m_{name}_{k}"] = F.when(when[k], F.regexp_extract_all(text, F.lit(patterns[k]), 0))
            found[f"g_{name}_{k}"] = F.when(when[k], F.split(text, patterns[k], -1))
    # a projection of its own, as the lists are read once for each match
    held = plain.select("doc_id", *[v.alias(k) for k, v in found.items()])

    def own(name):
        gaps = F.col(f"g_{name}")
        return F.transform(f"m_{name}", lambda value, i: F.struct(
            value.alias("value"), F.length(F.get(gaps, i)).alias("gap"),
            F.substring(F.get(gaps, i), -CONTEXT, CONTEXT).alias("before"),
            F.substring(F.get(gaps, i + 1), 1, 1).alias("after")))

    return held.select("doc_id", F.monotonically_increasing_id().alias("row"), *[
        own(f"{name}_{k}").alias(f"{name}_{k}") for name in ("base", "loose") for k in KINDS])


def spans(found: DataFrame) -> DataFrame:
    """(row, kind, base, start, end, value, before, after) of the base matches that pass their check and all loose ones."""
    out = None
    for name in ("base", "loose"):
        for k in KINDS:
            part = found.select("row", F.lit(k).alias("kind"), F.lit(name == "base").alias("base"),
                                F.posexplode(f"{name}_{k}").alias("at", "m"))
            out = part if out is None else out.union(part)
    upto = Window.partitionBy("row", "kind", "base").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("m.value")
    placed = out.withColumn("end", F.sum(F.col("m.gap") + size).over(upto)).select(
        "row", "kind", "base", (F.col("end") - size).alias("start"), "end", "m.value", "m.before", "m.after")
    good = F.lit(False)
    for k in KINDS:
        # the pattern is the whole check of an address; how it ends is only a vote
        check = F.lit(True) if k == "email" else passes(k, F.col("value"))
        good = F.when(F.col("kind") == k, check).otherwise(good)
    return placed.filter(~F.col("base") | good)


def votes(kind: str, value: Column, before: Column, after: Column) -> Column:
    """The votes of all labelers on a span."""
    yes = lambda c: F.when(c, 1).otherwise(0)
    plain = _digits(value) if kind == "card" else value
    free = ~before.rlike(r"[A-Za-z0-9]$") & ~after.rlike(r"^[A-Za-z0-9]")
    return F.array(
        yes(value.rlike(STRICT[kind])), yes(passes(kind, value)), yes(plain.rlike(LISTED[kind])),
        F.when(before.rlike(FOR[kind]), 1), F.when(before.rlike(AGAINST), 0), yes(free))


def labelled(every: DataFrame) -> DataFrame:
    """(row, kind, start, end, base, votes, features) of every candidate; loose ones only where no base span lies."""
    order = Window.partitionBy("row").orderBy("start", F.desc("base"))
    before = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    behind = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    apart = every.withColumns({"base_end": before, "base_start": behind}).filter(
        F.col("base") | ((F.coalesce("base_end", F.lit(0)) <= F.col("start"))
                         & (F.coalesce("base_start", F.col("end")) >= F.col("end"))))
    by_kind = F.lit(None)
    for k in KINDS:
        by_kind = F.when(F.col("kind") == k, votes(k, F.col("value"), F.col("before"), F.col("after"))).otherwise(by_kind)
    shape = F.regexp_replace("value", "[A-Za-z]+", "a")
    shape = F.regexp_replace(F.regexp_replace(shape, "[0-9]+", "9"), "(a9|9a)[a9]*", "x")
    voted = F.transform("votes", lambda v, i: F.concat(
        F.lit("vote "), i.cast("string"), F.lit(" "), F.coalesce(v.cast("string"), F.lit("-"))))
    return apart.withColumn("votes", by_kind).select(
        "row", "kind", "start", "end", "base", "votes", F.concat(voted, F.array(
            F.concat(F.lit("length "), F.least(F.length("value"), F.lit(40)).cast("string")),
            F.concat(F.lit("shape "), F.substring(shape, 1, 6)))).alias("features"))


def _likelihood(votes: Column, model: Column) -> Column:
    """Log-odds of a vote pattern under (prior, hit, slip): hit and slip are the chances of a yes on real and other."""
    def one(l):
        v, hit, slip = F.get(votes, l), F.get(model["hit"], l), F.get(model["slip"], l)
        return F.when(v == 1, F.log(hit / slip)).when(v == 0, F.log((1 - hit) / (1 - slip))).otherwise(F.lit(0.0))

    prior = F.log(model["prior"] / (1 - model["prior"]))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LABELERS - 1)), prior, lambda a, l: a + one(l))


def posterior(votes: Column, model: Column) -> Column:
    return 1 / (1 + F.exp(-_likelihood(votes, model)))


def reliabilities(marked: DataFrame, turns: int = TURNS) -> DataFrame:
    """(kind, model): model has the prior and each labeler's chances, by expectation-maximisation over vote patterns.

    Counts of one are added on both sides, so no chance becomes 0 or 1.
    """
    counted = marked.groupBy("kind", "votes").agg(F.count("*").cast("double").alias("n"))
    table = counted.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns"))

    def turn(model, _):
        judged = F.transform("patterns", lambda x: F.struct(
            x["votes"].alias("votes"), x["n"].alias("n"), posterior(x["votes"], model).alias("p")))
        total = lambda f: F.aggregate(judged, F.lit(0.0), lambda a, x: a + f(x))

        def chance(l, real):
            part = lambda x: x["n"] * (x["p"] if real else 1 - x["p"])
            voted = total(lambda x: F.when(F.get(x["votes"], l).isNotNull(), part(x)).otherwise(F.lit(0.0)))
            yes = total(lambda x: F.when(F.get(x["votes"], l) == 1, part(x)).otherwise(F.lit(0.0)))
            return (yes + 1) / (voted + 2)

        every = F.sequence(F.lit(0), F.lit(LABELERS - 1))
        prior = (total(lambda x: x["n"] * x["p"]) + 1) / (total(lambda x: x["n"]) + 2)
        return F.struct(prior.alias("prior"), F.transform(every, lambda l: chance(l, True)).alias("hit"),
                        F.transform(every, lambda l: chance(l, False)).alias("slip"))

    start = F.struct(F.lit(0.5).alias("prior"), F.array_repeat(F.lit(0.8), LABELERS).alias("hit"),
                     F.array_repeat(F.lit(0.2), LABELERS).alias("slip"))
    return table.select("kind", F.aggregate(F.sequence(F.lit(1), F.lit(turns)), start, turn).alias("model"))


def classifier(judged: DataFrame) -> DataFrame:
    """(kind, bias, weights): naive Bayes log-odds, trained on candidates with their chance p of being real."""
    sums = judged.groupBy("kind").agg(F.sum("p").alias("real"), F.sum(1 - F.col("p")).alias("other"))
    each = judged.select("kind", "p", F.explode("features").alias("feature")).groupBy("kind", "feature").agg(
        F.sum("p").alias("in_real"), F.sum(1 - F.col("p")).alias("in_other"))
    weight = F.log(((F.col("in_real") + 1) / (F.col("real") + 2)) / ((F.col("in_other") + 1) / (F.col("other") + 2)))
    return each.join(sums, "kind").groupBy("kind").agg(
        F.first(F.log((F.col("real") + 1) / (F.col("other") + 1))).alias("bias"),
        F.map_from_entries(F.collect_list(F.struct("feature", weight))).alias("weights"))


def added_spans(marked: DataFrame) -> DataFrame:
    """(row, kind, start, end) of the looser candidates that the trained classifier takes."""
    judged = marked.join(reliabilities(marked), "kind").withColumn("p", posterior(F.col("votes"), F.col("model")))
    judged = staged(judged.drop("model"), "judged-candidates")
    odds = F.aggregate("features", F.col("bias"), lambda a, f: a + F.coalesce(F.try_element_at("weights", f), F.lit(0.0)))
    taken = judged.filter("not base").join(classifier(judged), "kind").filter(odds >= 0)
    # of those that overlap, the first stays
    order = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    return taken.withColumn("before", F.max("end").over(order)).filter(
        "before is null or before <= start").select("row", "kind", "start", "end")


def private_spans(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), one row for each row of docs.

    The counts and the hash are those of the base spans; spans lists all as kind:start:end.
    """
    found = staged(matches(docs, id_col, text_col), "matches")
    marked = staged(labelled(staged(spans(found), "spans")), "labelled")
    every = marked.filter("base").select("row", "kind", "start", "end", "base").unionByName(
        added_spans(marked).withColumn("base", F.lit(False)))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    own = every.withColumn("span", F.struct("start", rank.alias("rank"), "end", "kind"))
    of_row = own.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("base"), F.col("span")))).alias("base"),
        F.array_sort(F.collect_list("span")).alias("all"),
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS],
        F.count_if(~F.col("base")).alias("n_added"))

    def said(column):
        each = F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.coalesce(F.array_join(each, ","), F.lit(""))

    out = found.select("row", "doc_id").join(of_row, "row", "left")
    return out.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS],
        F.sha2(said("base").cast("binary"), 256).alias("base_sha256"), said("all").alias("spans"),
        F.coalesce("n_added", F.lit(0)).alias("n_added"))
