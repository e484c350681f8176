"""Personal data: regex, gazetteer and context labelers vote on spans, expectation-maximisation weighs them, a span classifier decides."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.llm.common import KEY, attach, stage, view


@dataclass(frozen=True)
class Kind:
    """``pattern`` finds spans, ``digits`` bounds their digits, ``valid`` must match what was found. Quantifiers that can never give
    back a character are possessive, so that a run of any length needs neither stack nor a second look."""

    name: str
    pattern: str
    valid: str = ""
    digits: tuple[int, int] | None = None
    luhn: bool = False


# A start inside a run is no new start, unless the last match ended there.
_LOCAL = r"[A-Za-z0-9._%+-]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
BASE = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", valid=rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", digits=(14, 19), luhn=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", digits=(10, 15)),
)
# Spans that only the method adds.
MORE = (
    Kind("mailbox", r"(?i)(?<![\w.+-])[A-Za-z0-9._+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z0-9-]{1,63}){1,8}"),
    Kind("local_phone", r"(?<![0-9A-Za-z+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"),
    Kind("national_id", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    Kind("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    Kind("ipv6", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
)
KINDS = BASE + MORE

# --- What the labelers know. Fixed values; a pattern per kind, none where a labeler has no opinion.
FORMAT = {
    "email": r"^[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9][A-Za-z0-9-]{0,61}\.)+[A-Za-z]{2,24}$",
    "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^(?:[0-9]{14,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5})$",
    "phone": r"^\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,4}){2,4}$",
    "mailbox": r"(?i)^[a-z0-9][a-z0-9._+-]*\x20?[\[(]at[\])]\x20?[a-z0-9-]+(?:(?:\x20?[\[(]dot[\])]\x20?|\.)[a-z0-9-]+)*(?:\x20?[\[(]dot[\])]\x20?|\.)[a-z]{2,24}$",
    "local_phone": r"^(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}([\x20.-]))[2-9][0-9]{2}(?:\1|-)[0-9]{4}$",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?$",
    "ipv6": r"^[0-9A-Fa-f:]+$",
}
LISTED = {  # endings, issuers, calling codes and countries in wide use
    "email": r"(?i)\.(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|it|nl|ch|at|be|pl|se|eu|us|ca|au|jp|cn|in|br|mx|ru)$",
    "ip": r"^(?!0|10\.|127\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|22[4-9]\.|2[3-5][0-9]\.)[0-9]",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[0-9]|37[0-9]|38[0-9]|42[0-9]|97[0-9])",
    "mailbox": r"(?i)(?:com|org|net|edu|gov|io|info|de|fr|es|uk|it|nl|ch|at|eu)$",
    "local_phone": r"^\(?[2-9][0-8][0-9]",
    "national_id": r"^[0-8]",
    "iban": r"^(?:AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK)",
    "ipv6": r"^[23]",
}
NAMES = (
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah "
    "karen charles lisa daniel nancy anna peter maria hans klaus petra monika stefan andreas sabine jean marie pierre michel nathalie "
    "isabelle philippe sophie jose antonio manuel carmen francisco laura javier ana carlos lucia juan pablo elena"
)
BEFORE = {
    "email": "e-?mail|mail|contact|write|reach|kontakt|correo|courriel|adresse|address",
    "ip": "ip|host|server|client|login|visitor|from|address|adresse|direcci[oó]n",
    "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|payment|pay",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|telefon|t[eé]l[eé]phone|tel[eé]fono|anruf|appel",
    "mailbox": "e-?mail|mail|contact|write|reach|kontakt|correo|courriel",
    "local_phone": "phone|tel|telephone|call|mobile|cell|fax|telefon|t[eé]l[eé]phone|tel[eé]fono",
    "national_id": "ssn|social|security|taxpayer|insurance|id",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ipv6": "ip|ipv6|host|server|client|address",
}
AFTER = "ext|extension|or|call|expires|exp|valid|cvv|cvc|mobile|home|work|office|for details|anytime"
AGAINST = "version|release|section|chapter|isbn|issn|build|figure|table|page|order|invoice|part|serial|sku|doi|rev|kapitel|chapitre|cap[ií]tulo"
PLACEHOLDER = (
    r"(?i)@(?:[a-z0-9-]+\.)*example\.(?:com|org|net)$|@(?:test|localhost)\b|^(?:192\.0\.2|198\.51\.100|203\.0\.113)\.|^(?:127\.0\.0\.1|0\.0\.0\.0|1\.2\.3\.4|8\.8\.8\.8)$"
    r"|555[\x20.-]?01[0-9]{2}$|^([0-9])(?:[\x20-]?\1)+$|^4111|^123-45-6789$|\(dot\)example"
)
LABELERS = ("format", "listed", "name", "before", "after", "against", "edges", "placeholder")
# Characters kept around a span.
LEFT, RIGHT = 48, 32
# A labeler's votes given either class start from these counts: against, none, for.
PSEUDO = {1: (1.0, 2.0, 2.0), 0: (2.0, 2.0, 1.0)}
ROUNDS, STILL = 30, 1e-6
# Span features are hashed to so many weights; a weight is drawn to 0 by SHRINK spans. Spans from THRESHOLD on are added.
BUCKETS, SHRINK, THRESHOLD = 4096, 4.0, 0.5


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Luhn's checksum of a string of digits."""
    reverse = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(reverse, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


_SPAN = "array<struct<kind_no:int,i:int,gap:bigint,hit:string,before:string,after:string>>"


def _found(kind: Kind, number: int) -> Column:
    """The matches of a kind in ``text``: the length of the gap before each, the match, and what stands on either side."""
    gaps = F.split("text", kind.pattern, -1)
    rows = F.transform(
        F.arrays_zip(
            F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0)).alias("hit"),
            gaps.alias("gap"), F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(1))).alias("then"),
        ),
        lambda x, i: F.struct(
            F.lit(number).alias("kind_no"), i.alias("i"), F.length(x["gap"]).cast("long").alias("gap"), x["hit"].alias("hit"),
            F.right(x["gap"], F.lit(LEFT)).alias("before"), F.left(x["then"], F.lit(RIGHT)).alias("after"),
        ),
    )
    return F.coalesce(F.when(F.col("text").rlike(kind.pattern), F.filter(rows, lambda x: x["hit"].isNotNull())), F.array().cast(_SPAN))


def _valid() -> Column:
    """Whether a match counts: kinds with a further condition drop those that fail it."""
    checks = F.lit(True)
    digits = _digits(F.col("hit"))
    for number, kind in enumerate(KINDS):
        good = F.lit(True)
        if kind.valid:
            good = good & F.col("hit").rlike(kind.valid)
        if kind.digits:
            n = F.length(digits)
            good = good & n.between(*kind.digits)
            if kind.luhn:
                good = good & F.when(n.between(*kind.digits), passes_luhn(digits)).otherwise(False)
        checks = F.when(F.col("kind_no") == number, good).otherwise(checks)
    return checks


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, kind_no, start, end, hit, before, after``: valid base spans, and candidates of the
    other kinds that overlap none of them. Code points, end exclusive. Repeated rows give theirs once."""
    rows = view(docs)
    hits = rows.select(*KEY, F.explode(F.concat(*(_found(k, i) for i, k in enumerate(KINDS)))).alias("x")).select(*KEY, "x.*").distinct()
    order = Window.partitionBy(*KEY, "kind_no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = hits.withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(order)).withColumn("start", F.col("end") - F.length("hit"))
    valid = placed.where(_valid())
    # base spans come first among those of one start; the last end before and the first start after tell of an overlap
    base = F.col("kind_no") < len(BASE)
    by_start = Window.partitionBy(*KEY).orderBy("start", "kind_no")
    last = F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    following = F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    marked = valid.withColumn("free", (F.coalesce(last, F.lit(0)) <= F.col("start")) & (F.coalesce(following, F.col("end")) >= F.col("end")))
    return marked.where(base | F.col("free")).select(*KEY, "kind_no", "start", "end", "hit", "before", "after")


def _by_kind(patterns: dict[str, str], text: Column, yes: int, no: int) -> Column:
    chosen = F.lit(0)
    for number, kind in enumerate(KINDS):
        if kind.name in patterns:
            chosen = F.when(F.col("kind_no") == number, F.when(text.rlike(patterns[kind.name]), yes).otherwise(no)).otherwise(chosen)
    return chosen


def votes() -> list[Column]:
    """One vote per labeler: 1 for personal data, -1 against, 0 for no opinion."""
    word = lambda words: rf"(?iu)(?<!\w)(?:{words})(?!\w)"
    hit, before, after = F.col("hit"), F.col("before"), F.col("after")
    named = word(NAMES.replace(" ", "|"))
    return [
        _by_kind(FORMAT, hit, 1, -1),
        _by_kind(LISTED, hit, 1, -1),
        F.when(before.rlike(named) | F.regexp_replace(hit, "[^A-Za-z]", " ").rlike(named), 1).otherwise(0),
        _by_kind({k: word(w) for k, w in BEFORE.items()}, before, 1, 0),
        F.when(after.rlike(word(AFTER)), 1).otherwise(0),
        F.when(before.rlike(word(AGAINST)), -1).otherwise(0),
        F.when(before.rlike(r"(?U)[\w.@/-]$") | after.rlike(r"(?U)^(?:[\w@/]|[.-]\w)"), -1).otherwise(1),
        F.when(hit.rlike(PLACEHOLDER), -1).otherwise(0),
    ]


def features() -> Column:
    """The buckets of a span's features: its shape, length, ends and neighbours, each with its kind."""
    hit = F.col("hit")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.left(hit, F.lit(64)), "[0-9]+", "9"), r"[A-Z]+", "A"), r"[a-z]+", "a")
    values = [
        shape, F.least(F.length(hit), F.lit(40)).cast("string"), F.left(hit, F.lit(2)), F.regexp_extract(hit, r"[.\x20-]?[^.\x20-]*$", 0),
        F.lower(F.regexp_extract("before", r"(?U)(\w+)\W*$", 1)), F.lower(F.regexp_extract("after", r"(?U)^\W*(\w+)", 1)),
        F.concat(F.right("before", F.lit(1)), F.lit("|"), F.left("after", F.lit(1))),
    ]
    return F.array(*(F.pmod(F.xxhash64("kind_no", F.lit(i), v), F.lit(BUCKETS)).cast("int") for i, v in enumerate(values)))


def labelled(docs: DataFrame) -> DataFrame:
    """The spans with ``votes`` and ``features``, staged; their texts go."""
    seen = spans(docs)
    return stage(seen.select(*KEY, "kind_no", "start", "end", F.array(*(v.cast("int") for v in votes())).alias("votes"), features().alias("features")), "labelled")


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _posterior(parameters: dict[tuple[int, int], float]) -> Column:
    """The chance that a span with these ``votes`` is personal data. ``parameters``: log odds by (labeler, vote), and by
    (number of labelers, kind) for the share of each kind. They are passed as arrays, so the code stays the same from round to round."""
    n = len(LABELERS)
    weights = F.lit([parameters[j, v] for j in range(n) for v in (-1, 0, 1)])
    prior = F.element_at(F.lit([parameters[n, k] for k in range(len(KINDS))]), F.col("kind_no") + 1)
    odds = F.aggregate(
        F.sequence(F.lit(0), F.lit(n - 1)), prior, lambda s, j: s + F.element_at(weights, j * 3 + F.get("votes", j) + 2)
    )
    return 1 / (1 + F.exp(-odds))


def reliabilities(spans_: DataFrame) -> dict[tuple[int, int], float]:
    """Expectation-maximisation over the staged spans: the weight of each labeler's votes, as ``_posterior`` reads them.

    The rounds run over the distinct patterns of votes, at most ``len(KINDS) * 3 ** len(LABELERS)`` rows whatever the corpus; each round
    collects three sums per labeler and one per kind. The first round takes the majority for the truth.
    """
    n = len(LABELERS)
    patterns = stage(spans_.groupBy("kind_no", "votes").agg(F.count(F.lit(1)).cast("double").alias("n")), "patterns")
    parameters = {(j, v): float(v) for j in range(n) for v in (-1, 0, 1)} | {(n, k): 0.0 for k in range(len(KINDS))}
    for _ in range(ROUNDS):
        judged = patterns.withColumn("p", _posterior(parameters)).select(
            "n", "p", F.posexplode(F.concat("votes", F.array("kind_no"))).alias("j", "v")
        )
        sums = judged.groupBy("j", "v").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")).collect()
        of = {(r.j, r.v): (r.yes, r.no) for r in sums}
        old, parameters = parameters, {}
        for j in range(n):
            counts = {v: (of.get((j, v), (0, 0))[0] + PSEUDO[1][v + 1], of.get((j, v), (0, 0))[1] + PSEUDO[0][v + 1]) for v in (-1, 0, 1)}
            yes, no = (sum(c[y] for c in counts.values()) for y in (0, 1))
            parameters |= {(j, v): math.log(c[0] / yes) - math.log(c[1] / no) for v, c in counts.items()}
        for k in range(len(KINDS)):
            yes, no = of.get((n, k), (0, 0))
            parameters[n, k] = math.log((yes + 1) / (no + 1))
        if max(abs(parameters[x] - old[x]) for x in old) < STILL:
            break
    return parameters


def classifier(spans_: DataFrame, parameters: dict[tuple[int, int], float]) -> DataFrame:
    """``bucket, weight``: how far a feature moves the odds away from those of all spans, learnt from the posteriors of all spans. At most BUCKETS rows."""
    judged = spans_.select(_posterior(parameters).alias("p"), "features")
    whole = judged.agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).first()
    yes, no = float(whole.yes or 0) + 1, float(whole.no or 0) + 1
    share = yes / (yes + no)
    sums = judged.select("p", F.explode("features").alias("bucket")).groupBy("bucket").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    odds = F.log((F.col("yes") + SHRINK * share) / (F.col("no") + SHRINK * (1 - share)))
    return stage(sums.select("bucket", (odds - _logit(share)).alias("weight")), "weights")


def judged_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, kind_no, start, end, posterior, score``: the labelers' verdict, and the classifier's."""
    seen = labelled(docs)
    parameters = reliabilities(seen)
    weights = classifier(seen, parameters)
    prior = F.element_at(F.lit([parameters[len(LABELERS), k] for k in range(len(KINDS))]), F.col("kind_no") + 1)
    key = (*KEY, "kind_no", "start", "end")
    rows = seen.select(*key, _posterior(parameters).alias("posterior"), prior.alias("prior"), F.explode("features").alias("bucket"))
    scored = rows.join(F.broadcast(weights), "bucket", "left").groupBy(*key, "posterior", "prior").agg(F.sum("weight").alias("moved"))
    return scored.select(*key, "posterior", (1 / (1 + F.exp(-(F.col("prior") + F.coalesce("moved", F.lit(0.0)))))).alias("score"))


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, spans per base kind, ``base_sha256`` of the base spans, all ``spans``, and ``n_added``.

    Base spans always stay; the classifier adds spans of the other kinds. A null text is empty. Repeated rows get the same result
    each; rows of one id with other texts get their own. An empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
    """
    base = len(BASE)
    kept = judged_spans(docs).where((F.col("kind_no") < base) | (F.col("score") >= THRESHOLD))
    name = F.element_at(F.array(*(F.lit(k.name) for k in KINDS)), F.col("kind_no") + 1)
    listed = F.sort_array(F.collect_list(F.struct("start", "kind_no", F.concat_ws(":", name, "start", "end").alias("said"))))
    per_doc = kept.groupBy(*KEY).agg(
        *(F.count_if(F.col("kind_no") == i).alias(f"n_{k.name}") for i, k in enumerate(BASE)),
        F.count_if(F.col("kind_no") >= base).alias("n_added"), listed.alias("all"),
    )
    joined = lambda items: F.array_join(F.transform(items, lambda x: x["said"]), ",")
    counts = [*(f"n_{k.name}" for k in BASE), "n_added"]
    per_doc = per_doc.select(*KEY, *counts, joined(F.filter("all", lambda x: x["kind_no"] < base)).alias("base"), joined(F.col("all")).alias("spans"))
    rows = attach(view(docs).select(*KEY), stage(per_doc, "spans"), KEY, row_bytes=200)
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select(
        "doc_id", *(count(c) for c in counts[:-1]), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), count("n_added"),
    )
