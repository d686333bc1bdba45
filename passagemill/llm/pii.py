"""Personal data by weak supervision: labelers vote on spans, their reliabilities are estimated, a classifier decides."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions import text as tx
from passagemill.llm.rows import packed, spans, unpacked
from passagemill.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 40

_LOCAL = "[A-Za-z0-9._%+-]"
# Matches of the contract's patterns; possessive, and tried only where a run begins, so long runs stay linear.
# Runs of fewer than twelve digits are no candidates for a card: numbers are frequent, and each match has its price.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Spans beyond the base patterns that labelers may vote for.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{1,63}+(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)"
    r"[A-Za-z0-9-]{2,63}+(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20)(?:com|org|net|edu|info|de|fr|es|io)(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
GUARD = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?+[0-9]){11}", "phone": r"\+[0-9]"}
LOOSE_GUARD = {"email": r"[\[( ]at[\]) ][^\n]{1,70}[\[( ]dot[\]) ]", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}

# Gazetteers of labelers.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu")
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "36", "35")
CALLING = ("1", "33", "34", "39", "41", "43", "44", "49", "351", "61", "81", "86", "91")
CUES = {
    "email": "e-?mail|contact|write|schreib|correo|courriel|kontakt",
    "ip": "\\bip\\b|host|server|address|adresse|dirección|client",
    "card": "card|visa|mastercard|amex|credit|karte|tarjeta|carte",
    "phone": "phone|call|\\btel|mobile|fax|telefon|teléfono|téléphone|reach",
}
COUNTER = {
    "email": "example of|pattern",
    "ip": "version|\\bv\\b|release|section|chapter",
    "card": "order|isbn|invoice|serial|account|issue|ean",
    "phone": "version|order|invoice|score|result",
}
LABELERS = ("pattern", "gazetteer", "context", "shape", "border")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string's Luhn sum is a multiple of ten."""
    figures = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(
        F.filter(figures, lambda d: d.isNotNull()),
        lambda d, i: F.when(i % 2 == 0, d).when(d >= 5, 2 * d - 9).otherwise(2 * d),
    )
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    """The contract's test of a base match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return hit.rlike(rf"^{part}(?:\.{part}){{3}}$")
    n = F.length(_digits(hit))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(13, 19), luhn(_digits(hit))).otherwise(False)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, loose: bool, hit: Column, before: Column, after: Column, ok: Column) -> Column:
    """One vote per labeler: 1 for personal data, -1 against, 0 without an opinion."""
    digits = _digits(hit)
    never = F.lit(False)
    pattern = F.lit(0) if loose else _vote(ok, ~ok)
    if kind == "email":
        known = F.lower(F.substring_index(F.regexp_replace(hit, r"[\x20\[\]()]", "."), ".", -1)).isin(*DOMAINS)
        gazetteer = _vote(known, never)
        shape = _vote(hit.rlike("^[^@]{2,64}@") | F.lit(loose), hit.rlike("^[^@]{65}"))
    elif kind == "ip":
        first = F.substring_index(hit, ".", 1)
        gazetteer = _vote(never, first.isin("0", "127", "255"))
        shape = _vote(hit.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), hit.rlike(r"(?:^|\.)0[0-9]"))
    elif kind == "card":
        gazetteer = _vote(F.coalesce(*[F.when(digits.startswith(p), True) for p in ISSUERS], never), F.length(digits) < 13)
        shape = _vote(F.length(digits).isin(15, 16), ~F.length(digits).between(13, 19))
    else:
        gazetteer = _vote(F.coalesce(*[F.when(digits.startswith(p), True) for p in CALLING], never) | F.lit(loose), never)
        shape = _vote(F.length(digits).between(10, 13), ~F.length(digits).between(9, 15))
    context = _vote(before.rlike(f"(?i){CUES[kind]}"), before.rlike(f"(?i){COUNTER[kind]}"))
    border = _vote(
        before.rlike(r"(?:^|[\s(<\[\"':;,=])$") & after.rlike(r"^(?:$|[\s)>\]\"':;,.!?])"), before.rlike("[0-9A-Za-z]$")
    )
    return F.array(pattern, gazetteer, context, shape, border)


def _candidates(text: Column) -> Column:
    """All spans that labelers vote on: ``kind, start, end, base`` and the votes. Kinds in order, then by start."""

    def of(kind: str, pattern: str, guard: str, loose: bool) -> Column:
        def entry(s: Column) -> Column:
            ok = F.lit(False) if loose else valid(kind, s["hit"])
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                ok.alias("base"),
                _votes(kind, loose, s["hit"], s["before"], s["after"], ok).alias("votes"),
            )

        found = F.transform(F.filter(spans(text, pattern, CONTEXT), lambda s: _worth(kind, loose, s["hit"])), entry)
        return F.when(text.rlike(guard), found).otherwise(F.array().cast(CANDIDATES))

    parts = [of(k, BASE[k], GUARD[k], False) for k in KINDS] + [of(k, LOOSE[k], LOOSE_GUARD[k], True) for k in LOOSE]
    return F.when(text.rlike("[0-9@]|[\\[( ]dot[\\]) ]"), F.concat(*parts)).otherwise(F.array().cast(CANDIDATES))


CANDIDATES = "array<struct<kind:int,start:bigint,end:bigint,base:boolean,votes:array<int>>>"


def _worth(kind: str, loose: bool, hit: Column) -> Column:
    """Matches too short to be of their kind are no candidates; none of them could be a base span."""
    return F.length(_digits(hit)) >= 7 if kind == "phone" and not loose else F.lit(True)


@dataclass(frozen=True)
class VoteCounts:
    kind: int
    votes: tuple[int, ...]
    count: int


def candidates(docs: DataFrame, kept: list[str]) -> DataFrame:
    """``row``, the columns ``kept`` of ``docs``, and ``found``, the spans that labelers vote on; written once to the shared folder."""
    row = F.struct(*[F.col("row").getField(c).alias(c) for c in kept])
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return cut_lineage(packed(docs).select("row", _candidates(text).alias("found")).select(row.alias("row"), "found"))


def vote_counts(found: DataFrame) -> list[VoteCounts]:
    """How often each combination of kind and votes occurs among the ``found`` of all texts.

    At most 4 kinds times 3**5 combinations exist, so the table is small at any input size.
    """
    seen = found.select(F.explode("found").alias("c"))
    grouped = seen.groupBy("c.kind", "c.votes").count().orderBy("kind", "votes")
    return [VoteCounts(r["kind"], tuple(r["votes"]), r["count"]) for r in grouped.collect()]


@dataclass(frozen=True)
class Reliabilities:
    """Prior per kind and, per kind and labeler, how likely each vote is for spans that are and are not personal data."""

    prior: dict[int, float]
    given: dict[tuple[int, int, bool], dict[int, float]]

    def posterior(self, kind: int, votes: tuple[int, ...]) -> float:
        yes, no = math.log(self.prior[kind]), math.log(1 - self.prior[kind])
        for j, vote in enumerate(votes):
            yes += math.log(self.given[kind, j, True][vote])
            no += math.log(self.given[kind, j, False][vote])
        return 1 / (1 + math.exp(min(700.0, no - yes)))


def estimate(counts: list[VoteCounts], rounds: int = 25, smoothing: float = 1.0) -> Reliabilities:
    """Expectation-maximisation with labelers independent given the truth, from a majority vote as the start."""
    belief = {c: min(0.95, max(0.05, 0.5 + sum(c.votes) / (2 * len(LABELERS)))) for c in counts}
    model = Reliabilities({}, {})
    for _ in range(rounds):
        prior, given = {}, {}
        for kind in range(len(KINDS)):
            own = [c for c in counts if c.kind == kind]
            total = sum(c.count for c in own)
            positive = sum(c.count * belief[c] for c in own)
            prior[kind] = (positive + smoothing) / (total + 2 * smoothing)
            for j in range(len(LABELERS)):
                for truth, mass in ((True, positive), (False, total - positive)):
                    # A labeler is taken to be better than chance until the votes say otherwise.
                    lean = {1: 2.0, 0: 1.0, -1: 0.5} if truth else {1: 0.5, 0: 1.0, -1: 2.0}
                    given[kind, j, truth] = {
                        vote: (
                            sum(c.count * (belief[c] if truth else 1 - belief[c]) for c in own if c.votes[j] == vote)
                            + smoothing * lean[vote]
                        )
                        / (mass + smoothing * sum(lean.values()))
                        for vote in (1, 0, -1)
                    }
        model = Reliabilities(prior, given)
        belief = {c: model.posterior(c.kind, c.votes) for c in counts}
    return model


def _features(kind: int, votes: tuple[int, ...]) -> list[float]:
    chosen = [1.0 if k == kind else 0.0 for k in range(len(KINDS))]
    return chosen + [float(v == 1) for v in votes] + [float(v == -1) for v in votes]


def train(counts: list[VoteCounts], model: Reliabilities, steps: int = 400, rate: float = 0.5, shrink: float = 1e-3) -> list[float]:
    """Weights of a logistic span classifier on kinds and votes, fitted to the estimated posteriors."""
    weights = [0.0] * (len(KINDS) + 2 * len(LABELERS))
    rows = [(_features(c.kind, c.votes), model.posterior(c.kind, c.votes), math.sqrt(c.count)) for c in counts]
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(steps):
        slope = [shrink * w for w in weights]
        for x, goal, n in rows:
            z = sum(a * b for a, b in zip(weights, x))
            miss = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - goal) * n / total
            for i, a in enumerate(x):
                if a:
                    slope[i] += miss * a
        weights = [w - rate * s for w, s in zip(weights, slope)]
    return weights


def _probability(candidate: Column, weights: list[float]) -> Column:
    votes = candidate["votes"]
    z = F.get(F.array(*[F.lit(w) for w in weights[: len(KINDS)]]), candidate["kind"])
    for j in range(len(LABELERS)):
        z = z + F.when(F.get(votes, j) == 1, weights[len(KINDS) + j]).when(
            F.get(votes, j) == -1, weights[len(KINDS) + len(LABELERS) + j]
        ).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def find_pii(docs: DataFrame, threshold: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``carry`` (one at least), with ``pii``, the spans of personal data of every whole text, in kind order, then by start.

    An entry is ``kind, start, end, base, probability``; positions are code points, the end is
    exclusive. Base spans always stay; others stay where the classifier gives ``threshold`` or more
    and no base span of their kind overlaps them. Null and empty texts have none. Rows are read on their
    own, so repeated rows get the same spans; long texts are read whole; an empty table stays empty; a column of
    the table named ``pii`` gives way to the result.

    Texts are read once: what labelers vote on is written to the shared folder beside the columns that are kept, so name
    those that are needed. Votes are counted over all texts (one small aggregate), their reliabilities and the classifier
    come from those counts, and the decision is narrow.
    """
    kept = list(docs.columns if carry is None else carry)
    found = candidates(docs, kept)
    counts = vote_counts(found)
    weights = train(counts, estimate(counts)) if counts else [0.0] * (len(KINDS) + 2 * len(LABELERS))
    named = F.array(*[F.lit(k) for k in KINDS])

    def decided(found: Column) -> Column:
        scored = F.transform(
            found,
            lambda c: F.struct(
                c["kind"].alias("order"),
                c["start"].alias("start"),
                c["end"].alias("end"),
                F.get(named, c["kind"]).alias("kind"),
                c["base"].alias("base"),
                _probability(c, weights).alias("probability"),
            ),
        )

        def apart(scored: Column, sure: Column) -> Column:
            more = F.filter(
                F.filter(scored, lambda c: ~c["base"] & (c["probability"] >= threshold)),
                lambda c: ~F.exists(sure, lambda b: (b["order"] == c["order"]) & (b["start"] < c["end"]) & (c["start"] < b["end"])),
            )
            return F.array_sort(F.concat(sure, more))

        return tx.let(scored, lambda all_spans: tx.let(F.filter(all_spans, lambda c: c["base"]), lambda sure: apart(all_spans, sure)))

    out = found.select("row", decided(F.col("found")).alias("pii"))
    return out.select(*unpacked(kept, ["pii"]))


def listed(found: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
