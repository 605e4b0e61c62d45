"""Personal data by weak supervision, with DataFrame functions only.

Fixed patterns give the base spans (e-mail, IP address, card and phone numbers); these always stay.  Looser
patterns propose more spans: spelled-out e-mail addresses, card numbers with a wrong check digit, phone numbers
without a country code, bare runs of digits, IPv6 addresses.  Labelers vote on every span, base or proposed, for (1), against (-1)
or not at all (0): a gazetteer (top-level domains, address ranges, issuers, country codes), the words before it, a gazetteer of
given names before it, its digits.  Strict form and free borders follow from how spans are proposed; they are conditions, not votes.  Spans are
counted by kind, votes and whether they are base, a table of at most 8 * 3**4 rows.  On it expectation-maximisation estimates how reliable each
labeler is for each kind: base spans are real, so that a labeler they never meet, such as a wrong check digit, speaks against a
proposal; of the proposals, most are numbers of other sorts, the share of real ones is estimated along.  The posteriors train
the final span classifier, a logistic model of the votes that is applied as a column expression.  Proposed spans that it accepts and that
overlap no base span are added.

Defined results: null and empty texts have no spans (the hash of the empty text, an empty list); very long texts are searched
whole; repeated rows are rows of their own; an empty table gives no rows; extra columns, clashing names among them, are not
read.  A proposed span that begins inside another accepted one is left out; of those that begin together the first kind stays.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("gazetteer", "context", "names", "digits")

# Patterns start only where a run of their first characters starts or the previous match ends, and give no
# character back: the same matches as the plain patterns, in time proportional to the text.
BASE_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE_POSSIBLE = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
LOOSE_PATTERNS = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?[(\[]at[)\]] ?[a-z0-9-]++(?: ?(?:[(\[]dot[)\]]|\.) ?[a-z0-9-]++)++",
    "ip": r"(?i)(?<![0-9a-f:])[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}(?![0-9a-f:])",
    "phone": r"(?<![0-9+.-])(?:\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{9,11})(?![0-9])",
}
LOOSE_POSSIBLE = {"email": r"(?i)[(\[]at[)\]]", "ip": r":[0-9a-fA-F]{1,4}:", "phone": r"[0-9]{3}[ .-]?[0-9]{4}"}
STRICT = {
    "email": r"(?i)^[a-z0-9][a-z0-9._%+-]*(?:@| ?[(\[]at[)\]] ?)[a-z0-9-]+(?: ?(?:\.|[(\[]dot[)\]]) ?[a-z0-9-]+)* ?(?:\.|[(\[]dot[)\]]) ?[a-z]{2,}$",
    "ip": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$|^[0-9a-fA-F:]+$",
    "card": r"^[0-9]{13,16}$|^[0-9]{4}(?:[ -][0-9]{4}){3}$|^[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}$",
    "phone": r"^\+[0-9]{1,3}[ .-]?\(?[0-9]+\)?(?:[ .-]?[0-9]+)+$|^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$|^[0-9]{9,11}$",
}
# Generic top-level domains; calling codes by zone; issuer prefixes; given names in the languages at hand.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|name|pro|coop|museum|aero|jobs|mobi|travel|tel|cat|asia|io|dev|app|online|shop|store|site|tech|cloud|blog"
CALLING = (
    r"1|7|2[07]|21[1-368]|22[0-9]|23[0-9]|24[0-9]|25[0-8]|26[0-9]|29[0179]|3[0-469]|35[0-9]|37[0-8]|38[0-35-79]|4[013-9]|42[013]|5[1-8]|50[0-9]|59[0-9]|"
    r"6[0-6]|67[02-9]|68[0-35-9]|69[0-2]|8[1246]|85[02356]|88[06]|9[0-58]|96[0-8]|97[0-7]|99[2-68]"
)
NAMES = (
    "james|mary|john|robert|linda|michael|william|david|susan|richard|joseph|thomas|sarah|charles|karen|daniel|anna|peter|hans|klaus|jürgen|"
    "wolfgang|ursula|monika|petra|sabine|stefan|andreas|markus|heike|jean|pierre|marie|michel|jacques|françois|isabelle|nathalie|sophie|claire|"
    "luc|antonio|josé|manuel|francisco|carmen|maría|ana|luis|javier|carlos|pilar|lucía|elena|pablo"
)
GAZETTEER = {
    "email": rf"(?i)(?:\.|dot[)\]] ?)(?:{DOMAINS}|[a-z]{{2}})$",
    # first octets handed out for unicast, and the block of global IPv6 addresses
    "ip": r"^0*(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.|^[23][0-9a-fA-F]{3}:",
    "card": r"^(?:4|5[0-8]|2[2-7]|3[04-9]|6011|62|6[3-7]|35)",
    "phone": rf"^\+(?:{CALLING})(?:[^0-9]|[0-9])|^\(?[2-9][0-9]{{2}}",
}
FOR = {
    "email": r"(?i)e-?mail|contact|write|mailto|courriel|écri|correo|escrib|schreib|kontakt",
    "ip": r"(?i)\bip\b|address|host|server|adresse|dirección|client|login|ping",
    "card": r"(?i)card|visa|master|amex|credit|debit|carte|karte|kredit|tarjeta|crédito|pay|zahl",
    "phone": r"(?i)phone|\btel\b|call|fax|mobil|cell|dial|ruf|appel|téléph|llam|teléf|móvil",
}
AGAINST = r"(?i)version|\bv\.?$|isbn|issn|invoice|order|serial|\bsku\b|release|section|chapter|\bdoi\b|price|rechnung|bestell|facture|commande|factura|pedido|kapitel|capítulo"


def located(df: DataFrame, name: str, pattern: str, possible: str) -> DataFrame:
    """Adds ``name``: array of (start, end, match) of the leftmost matches of a pattern, in code points.

    Matches and the gaps between them are cut out with the same pattern; their lengths add up to the
    positions.  Sums run over blocks of 256 matches, so a text with very many matches stays cheap.  Each helper
    column is used twice, which keeps Catalyst from evaluating it again inside a lambda.
    """
    some = F.col("text").rlike(possible)
    none = F.array().cast("array<string>")
    df = df.withColumns(
        {
            "_hits": F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none),
            "_gaps": F.when(some, F.split("text", pattern, -1)).otherwise(none),
        }
    )
    gaps = F.slice("_gaps", 1, F.size("_hits"))
    df = df.withColumn("_steps", F.when(F.size("_gaps") > 1, F.zip_with(gaps, "_hits", lambda g, h: F.length(g) + F.length(h))).otherwise(F.array().cast("array<int>")))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    sums = F.transform(F.sequence(F.lit(0), F.expr("(size(_steps) - 1) div 256").cast("int")), lambda b: total(F.slice("_steps", b * 256 + 1, F.lit(256))))
    before = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    df = df.withColumn("_before", F.when(F.size("_steps") > 0, before).otherwise(F.array(F.lit(0))))

    def span(hit: Column, i: Column) -> Column:
        block = F.floor(i / 256).cast("int")
        end = F.element_at("_before", block + 1) + total(F.slice("_steps", block * 256 + 1, i % 256 + 1))
        return F.struct((end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("match"))

    spans = F.when((F.size("_before") > 0) & (F.size("_steps") >= 0), F.transform("_hits", span))
    return df.withColumn(name, spans).drop("_hits", "_gaps", "_steps", "_before")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """Whether the digits of a match pass the Luhn check."""
    digits = F.split(F.reverse(_digits(match)), "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 1, (d.cast("int") * 2) - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return n.between(12, 19) & _luhn(match)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, span: Column, text: Column) -> Column:
    match, n = span["match"], F.length(_digits(span["match"]))
    context = F.substring(text, F.greatest(span["start"] - 39, F.lit(1)), F.least(span["start"], F.lit(40)))
    good = {
        "email": match.rlike("(?i)^[^@(\\[]*[a-z]"),
        "ip": ~match.rlike(r"^(?:0|10|127|192\.168)\."),
        "card": _luhn(match) & n.between(12, 19),
        "phone": n.between(10, 13) & match.rlike("[^0-9]"),
    }[kind]
    listed = match.rlike(GAZETTEER[kind])
    return F.array(
        _vote(listed, ~listed),
        _vote(context.rlike(FOR[kind]), context.rlike(AGAINST)),
        _vote(context.rlike(rf"(?iu)\b(?:{NAMES})\b"), F.lit(False)),
        _vote(good, ~good),
    )


def _well_formed(kind: str, span: Column, text: Column) -> Column:
    """What a proposal must be whatever the votes: of strict form, with neither letter nor digit at its borders."""
    neighbours = F.concat(F.when(span["start"] > 0, F.substring(text, span["start"], F.lit(1))).otherwise(""), F.substring(text, span["end"] + 1, F.lit(1)))
    return span["match"].rlike(STRICT[kind]) & ~neighbours.rlike("[A-Za-z0-9]")


def voted_spans(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans``: array of (start, kind, end, base, formed, votes) of every text, kind as a number."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    for kind in KINDS:
        rows = located(rows, f"base_{kind}", BASE_PATTERNS[kind], BASE_POSSIBLE[kind])
    for kind, pattern in LOOSE_PATTERNS.items():
        rows = located(rows, f"loose_{kind}", pattern, LOOSE_POSSIBLE[kind])
    return rows.select("doc_id", F.concat(*(part for k in range(len(KINDS)) for part in _told(k))).alias("spans"))


def _told(k: int) -> list[Column]:
    """The base and the proposed spans of one kind with their votes; of card numbers, a wrong check digit proposes."""
    kind = KINDS[k]

    def told(span: Column, base: Column) -> Column:
        return F.struct(
            span["start"].alias("start"), F.lit(k).alias("kind"), span["end"].alias("end"), base.alias("base"),
            _well_formed(kind, span, F.col("text")).alias("formed"), _votes(kind, span, F.col("text")).alias("votes"),
        )

    found = F.col(f"base_{kind}")
    if kind == "card":
        found = F.filter(found, lambda s: F.length(_digits(s["match"])).between(12, 19))
        return [F.transform(found, lambda s: told(s, _luhn(s["match"])))]
    base = F.transform(F.filter(found, lambda s: _valid(kind, s["match"])), lambda s: told(s, F.lit(True)))
    return [base, F.transform(F.col(f"loose_{kind}"), lambda s: told(s, F.lit(False)))]


def reliabilities(patterns: list[tuple[tuple[int, ...], bool, float]], rounds: int = 60) -> tuple[list[list[float]], float, list[float]]:
    """Expectation-maximisation over (votes, base, count): per labeler P(+1 | real) and P(-1 | not), the share of real proposals, and posteriors.

    Base spans are real.  Starts from labelers that are right in 8 of 10 votes and from half of the proposals being real.  One prior vote
    for each outcome keeps rates inside (0, 1); no labeler that speaks against is taken for one that speaks for.
    """
    width = len(patterns[0][0]) if patterns else 0
    rate, prior, posterior = [[0.8, 0.8] for _ in range(width)], 0.5, []
    for _ in range(rounds):
        posterior = []
        for votes, base, _n in patterns:
            real, other = math.log(prior), math.log(1 - prior)
            for v, (up, down) in zip(votes, rate):
                if v:
                    real += math.log(up if v > 0 else 1 - up)
                    other += math.log(down if v < 0 else 1 - down)
            posterior.append(1.0 if base else 1 / (1 + math.exp(min(500, max(-500, other - real)))))
        offered = [(p, n) for p, (_, base, n) in zip(posterior, patterns) if not base]
        prior = (sum(p * n for p, n in offered) + 1) / (sum(n for _, n in offered) + 2)
        for j in range(width):
            cast = [(p, n, votes[j]) for p, (votes, _, n) in zip(posterior, patterns) if votes[j]]
            up = (sum(p * n for p, n, v in cast if v > 0) + 4) / (sum(p * n for p, n, v in cast) + 5)
            down = (sum((1 - p) * n for p, n, v in cast if v < 0) + 4) / (sum((1 - p) * n for p, n, v in cast) + 5)
            rate[j] = [up, max(down, 1 - up, 0.01)]
    return rate, prior, posterior


def span_classifier(patterns: list[tuple[tuple[int, ...], float]], posterior: list[float], steps: int = 50, ridge: float = 1e-3) -> list[float]:
    """Logistic weights (intercept first) of the votes, fitted to posteriors of (votes, count) by Newton steps on the counted table."""
    total = sum(n for _, n in patterns)
    rows = [((1, *votes), n / total, p) for (votes, n), p in zip(patterns, posterior)]
    width = len(rows[0][0])
    weight = [0.0] * width
    for _ in range(steps):
        slope, bend = [ridge * w for w in weight], [[ridge * (i == j) for j in range(width)] for i in range(width)]
        for x, n, p in rows:
            q = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(weight, x))))))
            for i in range(width):
                slope[i] += n * (q - p) * x[i]
                for j in range(width):
                    bend[i][j] += n * max(q * (1 - q), 1e-4) * x[i] * x[j]
        step = _solved(bend, slope)
        weight = [w - s for w, s in zip(weight, step)]
        if max(map(abs, step)) < 1e-9:
            break
    return weight


def _solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """The solution of a few linear equations."""
    rows = [[*m, r] for m, r in zip(matrix, right)]
    for i in range(len(rows)):
        k = max(range(i, len(rows)), key=lambda j: abs(rows[j][i]))
        rows[i], rows[k] = rows[k], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for j in range(len(rows)):
            if j != i:
                rows[j] = [x - rows[j][i] * y for x, y in zip(rows[j], rows[i])]
    return [r[-1] for r in rows]


def learnt(rows: DataFrame) -> dict[int, list[float]]:
    """Weights of the span classifier of each kind, from the counts of ``spans`` by votes.

    It learns from the proposals and as many base spans at most, so that what all proposals share counts for nothing.
    """
    counted = rows.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.base").count().collect()  # at most 8 * 3**4 rows
    models = {}
    for k in range(len(KINDS)):
        patterns = sorted((tuple(r["votes"]), r["base"], float(r["count"])) for r in counted if r["kind"] == k)
        offered = sum(n for _, base, n in patterns if not base)
        if offered:
            known = sum(n for _, base, n in patterns if base)
            posterior = reliabilities(patterns)[2]
            models[k] = span_classifier([(votes, n * min(1.0, offered / known) if base else n) for votes, base, n in patterns], posterior)
    return models


def detect(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, ``base`` and ``added`` (arrays of (start, kind, end)) of every row of ``docs``."""
    rows = settle(voted_spans(docs).withColumn("row_id", F.monotonically_increasing_id()))
    logit = F.lit(-1.0)
    models = learnt(rows)

    def accepted(span: Column) -> Column:
        value = logit
        for k, weight in models.items():
            own = F.lit(weight[0])
            for j, w in enumerate(weight[1:]):
                own = own + F.lit(w) * span["votes"][j]
            value = F.when(span["kind"] == k, own).otherwise(value)
        return value >= math.log(threshold / (1 - threshold))

    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    rows = rows.withColumn("base", F.array_sort(F.transform(F.filter("spans", lambda s: s["base"]), plain)))
    rows = rows.withColumn("more", F.transform(F.filter("spans", lambda s: ~s["base"] & s["formed"] & accepted(s)), plain)).drop("spans")
    added = _without_overlaps(rows.where(F.size("more") > 0))
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    return rows.join(added, "row_id", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def _without_overlaps(rows: DataFrame) -> DataFrame:
    """``row_id`` and ``added``: those of ``more`` that overlap no base span and do not begin inside another one of them.

    Spans stand in rows, in windows by text, so the work grows with their number times its logarithm.
    """
    tagged = [rows.select("row_id", F.lit(name == "base").alias("base"), F.inline(name)) for name in ("base", "more")]
    spans = tagged[0].unionByName(tagged[1])
    of_text = Window.partitionBy("row_id").orderBy("start")
    reached = F.max(F.when(F.col("base"), F.col("end"))).over(of_text.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    coming = F.min(F.when(F.col("base"), F.col("start"))).over(of_text.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    free = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("coming") >= F.col("end"), F.lit(True))
    spans = spans.withColumns({"reached": reached, "coming": coming}).where(~F.col("base") & free)
    before = Window.partitionBy("row_id").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("earlier", F.coalesce(F.max("end").over(before), F.lit(0))).where("earlier <= start")
    return spans.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))


def _listed(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def op7_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(detect(table(spark, sf_dir, "documents")))
