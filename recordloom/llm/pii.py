"""Personal data by weak supervision, with DataFrame functions only.

Strict patterns give the base spans, which always stay. Looser patterns give further candidates. For
every candidate, labelers vote for, against, or not at all: the strict pattern with its checks, a
gazetteer (issuer prefixes, reserved networks, top-level domains, area codes), the words before, the
characters around, and the variety of its digits. Spark counts how often each pattern of votes occurs;
expectation-maximisation over these counts (their number has a fixed bound) estimates how reliable each
labeler is, and a logistic classifier is trained on the resulting soft labels. It becomes a Spark
expression that decides which candidates are added to the base spans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import free_name, own_columns

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns. Quantifiers that nothing follows, or that cannot overlap with what follows, are
#: possessive, and a run that fails as a whole is not tried again from its middle, so that a long run costs no
#: more than its length.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # runs of fewer than twelve digits could neither be valid nor be candidates, and a shorter part of a run has fewer still
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a row's text must hold before its pattern is tried.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
#: Looser forms: spelled-out addresses, long form of network addresses, digit groups, national numbers.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]{1,64}+(?:\x20?(?:\.|[(\[](?:dot|DOT)[)\]])\x20?[A-Za-z0-9-]{1,64}+){1,6}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
LOOSE_HINT = {"email": r"[(\[](?:at|AT)[)\]]", "ip": r":[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{4}[\x20-][0-9]{4}", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}
#: Fixed word lists: words before personal data, and before numbers that are none.
FOR_WORDS = "mail|e-mail|email|contact|write to|reach|call|phone|tel|mobile|fax|whatsapp|card|visa|mastercard|amex|credit|payment|ip|address|server|host|client|login from|correo|courriel|telefon|karte|tarjeta|carte"
AGAINST_WORDS = "version|release|isbn|issn|order|invoice|ticket|serial|section|chapter|article|rfc|page|token|hash|commit|build|sku|model|ref"
DOMAINS = "com|org|net|edu|gov|mil|int|info|io|co|eu|us|uk|de|fr|es|it|nl|ch|at|be|ca|mx|br|jp|cn|in|au|ru|pl|se|no|dk"
LABELERS = ("strict", "gazetteer", "before", "around", "variety")
#: What share of a labeler's votes is taken to be right at first, and how many votes that belief counts for.
BELIEF = {"strict": 0.95, "gazetteer": 0.75, "before": 0.8, "around": 0.75, "variety": 0.7}
BELIEF_VOTES = 40
#: Characters of context before and after a candidate.
BEFORE, AFTER = 24, 1
#: An added span has at least this probability.
THRESHOLD = 0.95

#: Matches whose places are summed up at once.
PART = 256

_SPAN = "array<struct<start: int, end: int, found: string>>"
_CANDIDATES = f"array<struct<kind: string, start: int, end: int, base: boolean, {', '.join(f'{k}: int' for k in LABELERS)}>>"


def _matches(text: Column, pattern: str, hint: str) -> Column:
    """Leftmost matches that do not overlap, as (start, end, found) in characters, end exclusive."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size"), m.alias("found")))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["gap"]
        span = F.struct(begin.alias("start"), (begin + x["size"]).alias("end"), x["found"].alias("found"))
        return F.struct((begin + x["size"]).alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    def part(pairs: Column, at: Column, k: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast(_SPAN).alias("out"))
        return F.aggregate(F.slice(pairs, k * PART + 1, F.lit(PART)), start, step, lambda a: a["out"])

    def placed(pairs: Column) -> Column:
        """Places are sums of what is before: first over parts of PART matches, then inside each, so that no array grows with all."""
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / PART).cast("int")), lambda k: F.aggregate(F.slice(pairs, k * PART + 1, F.lit(PART)), F.lit(0), lambda n, x: n + x["gap"] + x["size"]))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(sums, zero, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        return F.when(F.size(pairs) > 0, F.flatten(F.transform(starts, lambda at, k: part(pairs, at, k))))

    spans = F.get(F.transform(F.array(pairs), placed), F.lit(0))  # the matches are found once
    hinted = text.contains(hint) if hint == "@" else text.rlike(hint)
    return F.coalesce(F.when(hinted, spans), F.array().cast(_SPAN))


def _let(value: Column, make) -> Column:
    """An expression over a value that is worked out once for each row, however often it is used in lambdas."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _mask(spans: Column) -> Column:
    """Bytes that are 1 inside spans, which are in order and apart, and 0 between. Bytes are reached by their place, characters of a string are counted."""

    def piece(x: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get(spans, k - 1)["end"]).otherwise(F.lit(0))
        return F.concat(F.repeat(F.lit("0"), x["start"] - before), F.repeat(F.lit("1"), x["end"] - x["start"]))

    return F.array_join(F.transform(spans, piece), "").cast("binary")


def _base_of(kind: str):
    return lambda x: x["base"] & (x["kind"] == kind)


def _touches(mask: Column, span: Column) -> Column:
    """Whether a span has a place that the mask holds."""
    return F.substring(mask, span["start"] + 1, span["end"] - span["start"]).cast("string").contains("1")


def _wide(text: Column) -> Column:
    """Four bytes for each character."""
    return F.encode(text, "UTF-32")


def _part(wide: Column, start: Column, size: Column) -> Column:
    """Characters of a text by their places, in time that does not grow with the place. A byte-order mark in front keeps the text's own ones."""
    return F.decode(F.concat(F.unhex(F.lit("0000FEFF")), F.substring(wide, start * 4 + 1, size * 4)), "UTF-32")


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check; null for none."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int") * F.when(F.pmod(F.length(digits) - i, F.lit(2)) == 1, 2).otherwise(1)
        return total + F.when(digit > 9, digit - 9).otherwise(digit)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    """The checks of a base match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(x, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    digits = _digits(found)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))


def _plausible(kind: str, found: Column) -> Column:
    """Of strict matches that fail the checks, those long enough to be a slip rather than another number."""
    least = {"email": 0, "ip": 0, "card": 12, "phone": 7}[kind]
    return F.length(_digits(found)) >= least if least else F.lit(True)


def _votes(kind: str, wide: Column, span: Column) -> dict[str, Column]:
    """1 for, -1 against, 0 none, for each labeler; ``wide`` is the text in four bytes a character."""
    found, digits = span["found"], _digits(span["found"])
    begin = F.greatest(span["start"] - BEFORE, F.lit(0))
    before = F.lower(_part(wide, begin, span["start"] - begin))
    left = F.when(span["start"] > 0, 1).otherwise(0)
    beside = F.concat(_part(wide, span["start"] - left, left), _part(wide, span["end"], F.lit(AFTER)))
    if kind == "email":
        gazetteer = F.when(F.lower(found).rlike(rf"(?:\.|dot[)\]])\x20?(?:{DOMAINS})$"), 1).otherwise(0)
    elif kind == "ip":
        gazetteer = F.when(found.rlike(r"^(?:[1-9]\d?|1\d\d|2[01]\d|22[0-3])\.|:"), 1).otherwise(-1)
    elif kind == "card":
        gazetteer = F.when(digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"), 1).otherwise(-1)
    else:
        gazetteer = F.when(digits.rlike(r"^1?[2-9]\d\d[2-9]"), 1).when(digits.rlike("^0{3}"), -1).otherwise(0)
    variety = F.lit(0) if kind == "email" else F.when(digits.rlike(r"^(\d)\1*$"), -1).when(F.size(F.array_distinct(F.split(digits, ""))) >= 4, 1).otherwise(0)
    return {
        "strict": F.when(span["base"], 1).when(span["failed"], -1).otherwise(0),
        "gazetteer": gazetteer,
        "before": F.when(before.rlike(rf"\b(?:{FOR_WORDS})\b"), 1).when(before.rlike(rf"\b(?:{AGAINST_WORDS})\b"), -1).otherwise(0),
        "around": F.when(beside.rlike(r"[\p{L}0-9_#/=]"), -1).otherwise(0),
        "variety": variety,
    }


def with_candidates(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """Adds an array of candidates in order of kind and start: kind, start, end, base and the labelers' votes."""
    raw = {f"{name}_{k}_{w}": (k, w) for k in KINDS for w in ("base", "loose")}
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = docs.withColumns({c: _matches(body, BASE[k] if w == "base" else LOOSE[k], HINT[k] if w == "base" else LOOSE_HINT[k]) for c, (k, w) in raw.items()})

    def marked(kind: str) -> Column:
        """Strict matches, checked, and loose ones that touch none of them."""
        strict, loose = F.col(f"{name}_{kind}_base"), F.col(f"{name}_{kind}_loose")
        checked = F.transform(strict, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found"), _valid(kind, x["found"]).alias("base")))
        first = F.transform(checked, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found"), x["base"].alias("base"), (~x["base"]).alias("failed")))
        apart = _let(_mask(strict), lambda mask: F.filter(loose, lambda x: ~_touches(mask, x)))
        fresh = F.when((F.size(loose) > 0) & (F.size(strict) > 0), apart).otherwise(loose)
        second = F.transform(fresh, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found"), F.lit(False).alias("base"), F.lit(False).alias("failed")))
        return F.concat(F.filter(first, lambda x: x["base"] | _plausible(kind, x["found"])), second)

    def voted(kind: str) -> Column:
        def candidates(wide: Column) -> Column:
            def candidate(x: Column) -> Column:
                votes = [v.cast("int").alias(k) for k, v in _votes(kind, wide, x).items()]
                return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"), *votes)

            return F.transform(F.col(f"{name}_{kind}"), candidate)

        return F.when(F.size(f"{name}_{kind}") > 0, _let(_wide(body), candidates)).otherwise(F.array().cast(_CANDIDATES))

    own = [f"{name}_{k}" for k in KINDS]
    docs = docs.withColumns({c: marked(k) for c, k in zip(own, KINDS)}).drop(*raw)
    docs = docs.withColumns({c: voted(k) for c, k in zip(own, KINDS)})
    return docs.withColumn(name, F.concat(*own)).drop(*own)


@dataclass
class SpanClassifier:
    """A bias for each kind and a weight for each labeler's vote for and vote against."""

    bias: dict[str, float]
    weight: dict[tuple[str, int], float]
    reliability: dict[str, float]

    def probability(self, span: Column) -> Column:
        kind = F.lit(0.0)
        for k, b in sorted(self.bias.items()):
            kind = F.when(span["kind"] == k, F.lit(b)).otherwise(kind)
        for (labeler, vote), w in sorted(self.weight.items()):
            kind = kind + F.when(span[labeler] == vote, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-kind))


def estimate(counts: dict[tuple, int], rounds: int = 60) -> tuple[dict[tuple, float], dict[str, float]]:
    """EM over (kind, votes...) patterns: the probability that each pattern is personal data, and each
    labeler's share of right votes among its votes. Abstaining says nothing."""
    right = dict(BELIEF)
    kinds = sorted({p[0] for p in counts})
    prior = dict.fromkeys(kinds, 0.5)
    soft: dict[tuple, float] = {}
    for _ in range(rounds if counts else 0):
        for pattern in counts:
            odds = math.log(prior[pattern[0]] / (1 - prior[pattern[0]]))
            for labeler, vote in zip(LABELERS, pattern[1:]):
                odds += vote * math.log(right[labeler] / (1 - right[labeler]))
            soft[pattern] = 1 / (1 + math.exp(-odds))
        for k, labeler in enumerate(LABELERS, 1):
            # a labeler of few votes stays near what is believed of it, and all stay better than chance
            good, all_ = BELIEF_VOTES * BELIEF[labeler], float(BELIEF_VOTES)
            for pattern, n in counts.items():
                if pattern[k]:
                    good += n * (soft[pattern] if pattern[k] > 0 else 1 - soft[pattern])
                    all_ += n
            right[labeler] = min(max(good / all_, 0.55), 0.97)
        for kind in kinds:
            mine = {p: n for p, n in counts.items() if p[0] == kind}
            prior[kind] = min(max((1 + sum(n * soft[p] for p, n in mine.items())) / (2 + sum(mine.values())), 0.05), 0.95)
    return soft, right


def fit(counts: dict[tuple, int], rounds: int = 300, rate: float = 0.5) -> SpanClassifier:
    """EM, then logistic regression on its soft labels."""
    soft, right = estimate(counts)
    bias = {p[0]: 0.0 for p in counts}
    weight = {(labeler, vote): 0.0 for labeler in LABELERS for vote in (1, -1)}
    total = sum(counts.values())
    for _ in range(rounds):
        step_bias, step = dict.fromkeys(bias, 0.0), dict.fromkeys(weight, 0.0)
        for pattern, n in counts.items():
            votes = [(labeler, v) for labeler, v in zip(LABELERS, pattern[1:]) if v]
            z = bias[pattern[0]] + sum(weight[v] for v in votes)
            pull = n / total * (soft[pattern] - 1 / (1 + math.exp(-z)))
            step_bias[pattern[0]] += pull
            for v in votes:
                step[v] += pull
        bias = {k: b + 4 * rate * step_bias[k] for k, b in bias.items()}
        weight = {k: w + 4 * rate * (step[k] - 1e-4 * w) for k, w in weight.items()}
    return SpanClassifier(bias, weight, right)


def train(docs: DataFrame, text: str = "text") -> SpanClassifier:
    """A classifier from the votes on all candidates of all rows; the driver gets a count per pattern of votes."""
    # the outer form: the other one makes Spark work out the candidates twice, once to see that there are any
    found = with_candidates(docs.select(F.col(text).alias("text")), "candidates").select(F.inline_outer("candidates")).filter("kind is not null")
    # at most four kinds times three votes for each labeler
    counts = found.groupBy("kind", *LABELERS).count().collect()
    return fit({tuple(r[:-1]): r[-1] for r in counts})


def find_spans(docs: DataFrame, model: SpanClassifier | None = None, text: str = "text", threshold: float = THRESHOLD, name: str = "spans") -> DataFrame:
    """The columns of ``docs`` with ``spans`` added: array of (kind, start, end, base), by kind, then start.

    All valid base matches are there, and candidates the classifier takes that touch no base span. Places
    count characters, end exclusive. A null text is empty and has no spans; so has an empty table. A
    model is trained on ``docs`` where none is given. The added column replaces one of the same name.
    """
    model = model or train(docs, text)
    docs = docs.drop(name)
    own = free_name(docs, "candidates")
    found = with_candidates(docs, own, text)
    # base spans of one kind are apart, those of different kinds may not be
    masks = F.array(*[_mask(F.filter(own, _base_of(k))) for k in KINDS])
    sure = lambda x: x["base"] | (model.probability(x) >= threshold)
    picked = _let(masks, lambda held: F.filter(own, lambda x: sure(x) & (x["base"] | ~F.exists(held, lambda mask: _touches(mask, x)))))
    taken = F.when(F.exists(own, lambda x: ~x["base"]), picked).otherwise(F.col(own))
    slim = F.transform(taken, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base")))
    number = F.transform(slim, lambda x: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("kind_number"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base")))
    ordered = F.transform(F.array_sort(number), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base")))
    return found.withColumn(name, ordered).drop(own)


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: SpanClassifier | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with every span of personal data replaced by its kind in brackets, columns unchanged.

    Spans that overlap are replaced as one. Null texts stay null.
    """
    name = free_name(docs, "spans")
    found = find_spans(docs, model, text, name=name)
    body = F.col(text).cast("string")
    places = F.array_sort(F.transform(name, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def masked(wide: Column) -> Column:
        def whole(held: Column) -> Column:
            """``held`` are the spans with what is covered before each."""
            size = F.size(held)
            covered = F.greatest(F.get(held, size - 1)["at"], F.get(held, size - 1)["end"])
            first = F.filter(held, lambda x: x["start"] >= x["at"])
            marks = F.transform(first, lambda x: F.concat(_part(wide, x["at"], x["start"] - x["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
            return F.concat(F.array_join(marks, ""), _part(wide, covered, F.length(body) - covered))

        return _let(_after(places), whole)

    return found.withColumn(text, F.when(F.size(name) > 0, _let(_wide(body), masked)).otherwise(body)).select(*own_columns(docs))


def _after(places: Column) -> Column:
    """Spans in order of start, each with ``at``: the end of all before it, 0 for the first. Found in parts of PART spans, so that no
    array grows with all."""

    def placed(spans: Column) -> Column:
        parts = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / PART).cast("int"))
        highest = F.transform(parts, lambda k: F.array_max(F.transform(F.slice(spans, k * PART + 1, F.lit(PART)), lambda x: x["end"])))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(highest, zero, lambda a, n: F.struct(F.greatest(a["at"], n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

        def part(at: Column, k: Column) -> Column:
            def inside(own: Column) -> Column:
                ends = F.transform(own, lambda x: x["end"])
                return F.transform(own, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.greatest(at, F.array_max(F.slice(ends, F.lit(1), i))).alias("at")))

            return _let(F.slice(spans, k * PART + 1, F.lit(PART)), inside)

        return F.flatten(F.transform(starts, part))

    return _let(places, placed)


def personal_data(docs: DataFrame, model: SpanClassifier | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone of base spans, base_sha256, spans, n_added."""
    found = find_spans(docs.select("doc_id", "text"), model).drop("text")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["base"])
    added = F.size(F.filter("spans", lambda x: ~x["base"])).cast("bigint")
    return found.select("doc_id", *map(count, KINDS), F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"), added.alias("n_added"))
