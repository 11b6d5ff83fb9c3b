"""Personal data in whole texts: fixed patterns, and further spans by weak supervision.

The base patterns of four kinds are found leftmost and non-overlapping; matches that fail their
check (digits, Luhn sum, parts) are dropped. Candidates beside them are proposed by form (local
phone numbers, cards and addresses with unusual separators), by a gazetteer (words that end in a
spelled-out mail ending) and by context (a run of numbers after "call" or "fax"). Labelers vote on
every match, base or not: the strict check, the written form, a gazetteer (mail endings, card
issuers, country codes, address blocks), the words before it, and its borders; 0 is no opinion.

The votes of all documents are counted by pattern. Expectation-maximisation estimates, by kind, how
often each labeler is right when it has an opinion, and from that the probability of every pattern.
Base spans are held as data and matches with a failed check as none; the rest, the open candidates,
are what it decides. A logistic span classifier is trained on the probabilities, with the shape of
the span (digits, separators, what follows) beside the votes; open candidates weigh as much as the
held ones. A candidate is added where the classifier says so and no base span overlaps it; base
spans always stay.

Everything that touches rows is a column expression. Only the counts by pattern, a table bounded by
the number of possible votes and shapes, reach the driver. Patterns are possessive, bounded or
anchored at the start of a run, so the longest texts are read once, without backtracking over them
or using stack.

Null texts are empty and have no spans; offsets count code points, the end is exclusive. Equal
rows get equal spans; other columns stay as they are; without candidates nothing is trained.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.quality import let

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. A match can only begin at a run's first character or where the last match
#: ended, which spares looking at every later start in the run; the language is the plain one's.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What must be in a text before a kind's pattern is tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

#: Fixed values of the gazetteers and context labelers.
MAIL_ENDINGS = ["com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "eu", "uk"]
CARD_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|30|36|38|6011|65)"
COUNTRY_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CLUES = {
    "email": r"(?i)(?:mail|contact|write|address|adresse|correo|kontakt)[^a-z]*$",
    "ip": r"(?i)(?:\bip|host|server|address|adresse|login)[^a-z]*$",
    "card": r"(?i)(?:card|visa|credit|carte|karte|tarjeta|account|iban)[^a-z]*$",
    "phone": r"(?i)(?:phone|call|tel|mobile|fax|ring|telefon|appel|llama)[^a-z]*$",
}
DOUBTS = r"(?i)(?:version|release|isbn|issn|order|invoice|page|token|key|hash|sha|id)[^a-z]*$"
LABELERS = ("check", "form", "gazetteer", "context", "border")
CONTEXT_CHARS = 40

_NAME = r"[A-Za-z0-9-]++"
_FILLER = r"(?i:\x20(?:me|us|on|at|no|nr|number|is)[.:]?)?"
_DIALLED = (r"(?i:call|phone|telephone|tel|mobile|fax|ring|telefon|appel|llama)[.:]?"
            rf"{_FILLER}{_FILLER}\x20{{0,2}}#?")
#: Candidates only, by kind, with what must be in a text first.
PROPOSED = {
    "email": (
        rf"(?<!{_LOCAL}){_LOCAL}++(?:\x20?[(\[]at[)\]]\x20?{_NAME}"
        rf"(?:(?:\.|\x20?[(\[]dot[)\]]\x20?){_NAME}){{1,6}}+"
        rf"|\x20at\x20{_NAME}(?:\x20dot\x20(?!(?:{'|'.join(MAIL_ENDINGS)})\b){_NAME}){{0,4}}+"
        rf"\x20dot\x20(?:{'|'.join(MAIL_ENDINGS)})\b)",
        r"[(\[]at[)\]]|\x20at\x20[A-Za-z0-9-]+\x20dot\x20"),
    "ip": (r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20?[(\[]dot[)\]]\x20?)[0-9]{1,3}){3}(?![0-9])",
           r"[0-9](?:[(\[]\.|\x20?[(\[]dot)"),
    "card": (r"(?<![0-9])[0-9]{4}(?:(?:[._/]|\x20{2}|\x20-\x20)[0-9]{4}){3}(?![0-9])",
             r"[0-9]{4}(?:[._/]|\x20{2}|\x20-\x20)[0-9]{4}"),
    "phone": (
        r"(?=[(0-9])(?<![0-9])(?:(?<!\+[0-9]{1,3}[\x20.(-]{0,3})\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}"
        rf"[\x20.-][0-9]{{4}}(?![0-9])|(?<=\b{_DIALLED})"
        r"(?![0-9]++\.[0-9]++\.[0-9]++\.[0-9])\(?[0-9]{2,13}+\)?"
        r"(?:[\x20./-]{1,2}+[0-9]{1,8}+){0,6}+(?![\x20./-]?[0-9]))",
        r"[0-9]{2}[\x20./)-]{1,2}[0-9]{2}|[0-9]{7}"),
}

ROUNDS, STEPS, ACCEPT = 30, 25, 0.5
#: Probability held for a match that failed its check; base spans are held at the rest.
DISPROVED = 0.001
#: How often a labeler is right before anything is counted, and the matches this counts as: first
#: for the labeler over all kinds, then for the estimate over all kinds in one kind.
RIGHT, STRENGTH = 0.8, 10.0
#: Weight of the squares in the classifier's training.
RIDGE = 0.001
#: Values of the shape features: number of digits, separators, what follows.
SHAPES = (7, 6, 4)


def _spans(text: Column, pattern: str, body) -> Column:
    """``body(match, start, before, after)`` of each match, in order.

    The pieces between matches give the offsets: both come from the same search.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(matches: Column, gaps: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("end"))
        ends = F.aggregate(
            F.zip_with(matches, F.slice(gaps, 1, F.size(matches)),
                       lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("own"))),
            start,
            lambda a, x: F.struct(F.concat(a["at"], F.array(a["end"] + x["gap"])).alias("at"),
                                  (a["end"] + x["gap"] + x["own"]).alias("end")))
        return let(ends["at"], lambda at: F.transform(
            matches, lambda m, i: body(m, at[i], gaps[i], gaps[i + 1])))

    return let(found, lambda m: let(F.split(text, pattern), lambda g: placed(m, g)))


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits, at most 19, pass the Luhn sum."""
    def value(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i))
    return total % 10 == 0


def passes(kind: str, match: Column) -> Column:
    """The base check of a match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        def small(part: Column) -> Column:
            bare = F.regexp_replace(part, "^0+(?=.)", "")
            return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(999)) <= 255)
        return F.forall(F.split(match, r"\."), small)
    n = F.length(digits_of(match))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(13, 19), luhn(digits_of(match))).otherwise(False)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def proposal_passes(kind: str, match: Column) -> Column:
    """The check of a candidate that no base pattern gives; null where it decides nothing."""
    if kind == "email":
        return F.lit(None).cast("boolean")
    if kind == "ip":
        return passes("ip", F.regexp_replace(match, r"[^0-9]+", "."))
    if kind == "card":
        return luhn(digits_of(match))
    return F.when(~F.length(digits_of(match)).between(7, 13), False)


def votes(kind: str, match: Column, before: Column, after: Column, ok: Column,
          proposed: bool = False) -> list[Column]:
    """The labelers' votes, 1 for personal data, -1 against, 0 for no opinion.

    ``ok`` is the result of the check, null where there is none; ``proposed`` is for candidates
    that no base pattern gives.
    """
    digits = digits_of(match)
    no = F.lit(False)
    if kind == "email":
        ending = F.lower(F.regexp_extract(match, r"([A-Za-z0-9-]*)$", 1))
        form = _vote(ending.rlike("^[a-z]{2,10}$"), ending.rlike("[0-9-]"))
        listed = _vote(ending.isin(MAIL_ENDINGS), no)
    elif kind == "ip":
        form = _vote(~match.rlike(r"(?:^|\.)0[0-9]"), match.rlike(r"(?:^|\.)0[0-9]"))
        first = F.coalesce(F.substring_index(match, ".", 1).try_cast("int"), F.lit(999))
        listed = _vote(first.between(1, 223), (first == 0) | (first > 239))
    elif kind == "card":
        n = F.length(digits)
        form = _vote(n.isin(15, 16) & match.rlike(r"^(?:[0-9]+|(?:[0-9]{4}[\x20-]){3}[0-9]{4})$")
                     if not proposed else n == 16, (n < 13) | (n > 19))
        listed = _vote(digits.rlike(CARD_ISSUERS), ~digits.rlike(CARD_ISSUERS))
    elif proposed:
        # ten digits are an area, an exchange and a line; the first two never begin with 0 or 1
        ten = F.length(digits) == 10
        form = _vote(ten & digits.rlike("^[2-9]..[2-9]"), ten & ~digits.rlike("^(?:0|[2-9]..[2-9])"))
        listed = _vote(digits.rlike("^(?:0[1-9]|[2-9])"), digits.rlike(r"^(?:1[89]|20)[0-9]{2}|^00|^(.)\1+$"))
    else:
        n = F.length(digits)
        form = _vote(n.between(10, 13) & match.rlike(r"[\x20()-]"), (n < 9) | (n > 15))
        listed = _vote(match.rlike(COUNTRY_CODES), no)
    near = F.right(before, F.lit(CONTEXT_CHARS))
    context = _vote(near.rlike(CLUES[kind]), near.rlike(DOUBTS))
    glued = near.rlike(r"[\p{L}\p{N}_.]$") | after.rlike(r"^[\p{L}\p{N}_]")
    return [_vote(ok, F.coalesce(~ok, F.lit(False))), form, listed, context, _vote(~glued, glued)]


def shape(match: Column, after: Column) -> Column:
    """The classifier's own features of a match: one value of each of ``SHAPES``."""
    n = F.length(digits_of(match))
    size = (F.when(n == 0, 0).when(n < 7, 1).when(n < 9, 2).when(n < 11, 3).when(n < 14, 4)
            .when(n < 17, 5).otherwise(6))
    found = [F.contains(match, F.lit(c)) for c in (" ", "-", ".")]
    several = sum((f.cast("int") for f in found), F.lit(0)) > 1
    separator = (F.when(match.rlike(r"[(\[]"), 4).when(several, 5).when(found[0], 1)
                 .when(found[1], 2).when(found[2], 3).otherwise(0))
    follows = (F.when(after == "", 0).when(after.rlike(r"^\s"), 1)
               .when(after.rlike(r"^[\p{L}\p{N}]"), 3).otherwise(2))
    return F.array(size, separator, follows)


def candidates(text: str = "text") -> Column:
    """All matches of a text: array of (kind, s, e, base, votes, shape), by kind, then start."""
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(
                            "array<struct<kind:int,s:int,e:int,base:boolean,votes:array<int>,shape:array<int>>>")

    def matches(kind: str, pattern: str, hint: str, proposed: bool) -> Column:
        def one(m: Column, s: Column, before: Column, after: Column) -> Column:
            check = proposal_passes(kind, m) if proposed else passes(kind, m)
            return let(check, lambda ok: F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), s.alias("s"),
                (s + F.length(m)).alias("e"), (F.lit(not proposed) & ok).alias("base"),
                F.array(*votes(kind, m, before, after, ok, proposed)).alias("votes"),
                shape(m, after).alias("shape")))

        there = F.contains(body, F.lit(hint)) if hint == "@" else body.rlike(hint)
        return F.when(there, _spans(body, pattern, one)).otherwise(none)

    parts = [matches(k, PATTERNS[k], HINTS[k], False) for k in KINDS]
    parts += [matches(k, *PROPOSED[k], True) for k in KINDS]
    some = r"[@0-9]|[(\[]at[)\]]|\x20at\x20[A-Za-z0-9-]+\x20dot\x20"
    return F.when(body.rlike(some), F.sort_array(F.concat(*parts))).otherwise(none)


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities of the labelers and weights of the span classifier."""

    #: by kind: share of personal data among the open candidates
    prior: list[float]
    #: by side (no data, data), kind and labeler: how often an opinion is in favour
    favour: np.ndarray
    #: by kind
    bias: list[float]
    #: by kind, labeler and vote (-1, 0, 1)
    weights: np.ndarray
    #: by shape feature and value
    shapes: list[list[float]]

    def accepts(self, candidate: Column) -> Column:
        """The classifier's verdict on a candidate, as an expression."""
        def looked_up(values, at: Column) -> Column:
            return F.element_at(F.array(*(F.lit(float(v)) for v in values)), at + 1)

        kind = candidate["kind"]
        score = looked_up(self.bias, kind)
        for i in range(len(LABELERS)):
            score = score + looked_up(self.weights[:, i].ravel(), kind * 3 + candidate["votes"][i] + 1)
        for i, values in enumerate(self.shapes):
            score = score + looked_up(values, candidate["shape"][i])
        return score >= math.log(ACCEPT / (1 - ACCEPT))


def reliabilities(kind: np.ndarray, held: np.ndarray, votes: np.ndarray,
                  n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over patterns: the belief of each, the prior of each kind, and ``favour``.

    ``held`` is the fixed belief of a pattern, NaN if open. A labeler without an opinion says
    nothing; one kind's estimate leans on that over all kinds.
    """
    open_ = np.isnan(held)
    belief = np.where(open_, np.clip(0.5 + votes.sum(1) / (2 * len(LABELERS)), 0.05, 0.95), held)
    of_kind = kind[None, :] == np.arange(len(KINDS))[:, None]
    prior = np.full(len(KINDS), 0.5)
    favour = np.empty((2, len(KINDS), len(LABELERS)))
    for _ in range(ROUNDS):
        for side, start in ((0, 1 - RIGHT), (1, RIGHT)):
            weight = of_kind * (n * (belief if side else 1 - belief))
            yes, any_ = weight @ (votes > 0), weight @ (votes != 0)
            overall = (yes.sum(0) + STRENGTH * start) / (any_.sum(0) + STRENGTH)
            favour[side] = (yes + STRENGTH * overall) / (any_ + STRENGTH)
        prior = ((of_kind & open_) @ (n * belief) + 1) / ((of_kind & open_) @ n + 2)
        gain = np.log(favour[1] / favour[0])[kind] * (votes > 0)
        loss = np.log((1 - favour[1]) / (1 - favour[0]))[kind] * (votes < 0)
        odds = np.log(prior / (1 - prior))[kind] + (gain + loss).sum(1)
        belief = np.where(open_, 1 / (1 + np.exp(-np.clip(odds, -30, 30))), held)
    return belief, prior, favour


def fit_model(counts: list[tuple[int, bool, tuple[int, ...], tuple[int, ...], int]]) -> SpanModel | None:
    """EM and the classifier from (kind, base, votes, shape, number of matches).

    The table is bounded by kinds x 2 x 3 ** labelers x shapes.
    """
    if not counts:
        return None
    rows = sorted(counts)
    kind = np.array([r[0] for r in rows])
    base = np.array([r[1] for r in rows])
    votes_, shapes = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    n = np.array([r[4] for r in rows], float)
    held = np.where(base, 1 - DISPROVED, np.where(votes_[:, 0] < 0, DISPROVED, np.nan))
    belief, prior, favour = reliabilities(kind, held, votes_, n)
    # features: kind; kind x labeler x opinion; shape
    one = np.eye(len(KINDS))[kind]
    opinion = np.stack((votes_ < 0, votes_ > 0), 2).reshape(len(rows), -1).astype(float)
    by_kind = (one[:, :, None] * opinion[:, None, :]).reshape(len(rows), -1)
    x = np.hstack([one, by_kind] + [np.eye(m)[shapes[:, i]] for i, m in enumerate(SHAPES)])
    # by kind, the open candidates weigh as much as the held matches
    group = kind * 2 + np.isnan(held)
    weight = n / np.bincount(group, n)[group]
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - belief)) + RIDGE * w
        curve = (x.T * (weight * np.maximum(p * (1 - p), 1e-4))) @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step / max(1.0, np.abs(step).max() / 2)
    k = len(KINDS)
    said = w[k : k + by_kind.shape[1]].reshape(k, len(LABELERS), 2)
    weights = np.stack((said[:, :, 0], np.zeros(said.shape[:2]), said[:, :, 1]), 2)
    cuts = k + by_kind.shape[1] + np.cumsum((0, *SHAPES))
    return SpanModel(prior.tolist(), favour, w[:k].tolist(), weights,
                     [w[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)])


def learn(documents: DataFrame, text: str = "text") -> SpanModel | None:
    """Counts votes and shapes of all matches of all documents and fits the model to the counts."""
    keys = ("kind", "base", "votes", "shape")
    rows = documents.select(F.explode(candidates(text)).alias("c")).select("c.*")
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()
    return fit_model([(r["kind"], r["base"], tuple(r["votes"]), tuple(r["shape"]), r["n"])
                      for r in counted])


def with_spans(documents: DataFrame, model: SpanModel | None, text: str = "text",
               name: str = "_spans") -> DataFrame:
    """``documents`` with the accepted spans (kind, s, e, base) of ``text`` as ``name``."""

    def chosen(all_: Column) -> Column:
        if model is None:
            return F.filter(all_, lambda c: c["base"])
        base = F.filter(all_, lambda c: c["base"])
        return let(base, lambda own: F.filter(all_, lambda c: c["base"] | (
            (c["votes"][0] >= 0) & model.accepts(c)
            & ~F.exists(own, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))))

    slim = F.transform(let(candidates(text), chosen),
                       lambda c: F.struct(c["kind"], c["s"], c["e"], c["base"]))
    return documents.withColumn(name, slim)


def personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, base_sha256 and all spans of every document."""
    found = with_spans(documents.select("doc_id", "text"), learn(documents))
    names = F.array(*map(F.lit, KINDS))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda c: F.concat_ws(
            ":", F.element_at(names, c["kind"] + 1), c["s"].cast("string"), c["e"].cast("string"))),
            ",")

    def base(kind: int | None = None) -> Column:
        return F.filter("_spans", lambda c: c["base"] & (
            F.lit(True) if kind is None else c["kind"] == kind))

    return found.select(
        "doc_id", *[F.size(base(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(joined(base()), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"))


def masked(documents: DataFrame) -> DataFrame:
    """``documents`` with every span replaced by its kind in brackets, such as ``[email]``.

    Overlapping spans of several kinds become one mask, named after the one that starts first.
    """
    columns = documents.columns
    # the row is packed, so that its columns can have any names
    row = F.struct(*columns).alias("row")
    found = with_spans(documents.select("text", row), learn(documents.select("text")))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    body = F.col("text")

    def put(spans: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("end"))

        def step(a: Column, c: Column) -> Column:
            gap = F.substring(body, a["end"] + 1, c["s"] - a["end"])
            mask = F.element_at(names, c["kind"] + 1)
            return F.when(c["s"] < a["end"], F.struct(
                a["out"].alias("out"), F.greatest(a["end"], c["e"]).alias("end"))
            ).otherwise(F.struct(F.concat(a["out"], gap, mask).alias("out"), c["e"].alias("end")))

        done = F.aggregate(spans, start, step)
        return let(done, lambda a: F.concat(a["out"], F.substring(
            body, a["end"] + 1, F.length(body))))

    ordered = F.sort_array(F.transform("_spans", lambda c: F.struct(
        c["s"].alias("s"), (-c["e"]).alias("_e"), c["e"].alias("e"), c["kind"].alias("kind"))))
    text = F.when(F.size("_spans") > 0, put(ordered)).otherwise(body)
    out = found.withColumn("text", text)
    new = {c: F.col("row").getField(c) for c in columns} | {"text": F.col("text")}
    if "n_chars" in columns:
        kind = documents.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.size("_spans") > 0, F.length("text").cast(kind)).otherwise(
            new["n_chars"])
    return out.select(*(value.alias(c) for c, value in new.items()))
