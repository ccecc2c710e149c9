"""Personal data by weak supervision, DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card numbers and phone numbers; what they
find and their checks accept always stays.  Wider patterns propose further spans where no
base span lies: numbers inside a longer run that failed as a whole, other layouts, spelled
out addresses.  On every span labelers vote for, against or not at all: regular expressions
(the base check, the usual layout), gazetteers (domain endings, address ranges, issuers,
calling codes) and context (cue words before it, counter cues, what it touches).  No labeler
is trusted: expectation-maximisation over the vote patterns estimates how often each votes
how on true and on false spans, and with it the chance that a span is true.  A logistic
span classifier is trained on these chances, and proposals it is sure of are added.

Texts are read once, in place.  Spans with their categorical features are written to the
shared folder; what reaches the driver are counts of feature combinations (``CELLS`` bounds
them whatever the corpus), and what comes back are the classifier's weights as literals.
All loops over a row's spans are array functions whose work grows about linearly.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlake.session import cut

#: fixed value: the kinds, in the order of their spans
KINDS = ("email", "ip", "card", "phone")

# The base patterns.  They find what these do, leftmost and non-overlapping:
#   email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card   [0-9]([\x20-]?[0-9])+
#   phone  \+[0-9][\x20().0-9-]+[0-9]
# but possessive, as nothing they take is ever given back, and begun only where a run
# begins or the last match ended, so that a long run is read once and needs no deep stack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: proposals of the method
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?(?:\(at\)|\[at\]) ?|@)[A-Za-z0-9-]++(?:(?: ?(?:\(dot\)|\[dot\]) ?|\.)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{12,19})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: a text without this holds no match
NEEDS = {"email": r"@|\(at\)|\[at\]", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": "[0-9]"}

#: fixed values: the gazetteers and cue words
TLD = "com|org|net|edu|gov|info|biz|io|dev|eu|de|fr|es|it|uk|nl|be|ch|at|pt|pl|us|ca|au|in|jp|br|ma"
CALLING = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|57|61|62|63|64|65|66|81|82|84|86|90|91|92|98|212|213|216|351|352|353|358|380|420|421"
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|35|36|38|6011|62|65)"
NO_HOST = r"^(?:0|10|127|22[4-9]|2[3-5][0-9])\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\."
CUES = {
    "email": "mail|contact|write to|kontakt|correo|courriel|adresse",
    "ip": r"\bip\b|host|server|serveur|servidor|address|adresse|client",
    "card": "card|visa|master|credit|karte|kredit|tarjeta|carte|iban|konto|payment",
    "phone": r"phone|\btel|call|mobil|handy|fax|ruf|appel|llam|contact",
}
COUNTER = r"token|hash|\bsha|commit|version|isbn|order|invoice|serial|\bid\b|licen|\bno\. ?$|\$ ?$|%"

#: longest context before and after a span
BEFORE, AFTER = 32, 16
#: blocks of the running folds
BLOCK = 256

LABELERS = ("strict", "layout", "gazetteer", "cue", "counter", "edge")
#: what is believed of each labeler at first: shares of votes (for, none, against) on true and on false spans
BELIEFS = {
    "strict": ((0.95, 0.04, 0.01), (0.10, 0.30, 0.60)),
    "layout": ((0.70, 0.29, 0.01), (0.40, 0.59, 0.01)),
    "gazetteer": ((0.60, 0.30, 0.10), (0.35, 0.35, 0.30)),
    "cue": ((0.40, 0.59, 0.01), (0.05, 0.94, 0.01)),
    "counter": ((0.01, 0.96, 0.03), (0.01, 0.69, 0.30)),
    "edge": ((0.90, 0.01, 0.09), (0.50, 0.01, 0.49)),
}
#: weight of these beliefs, as a share of a kind's spans; rounds of estimation
STRENGTH, ROUNDS = 0.5, 100
#: penalty of the classifier, and how sure it must be to add a span
L2, SURE = 1e-3, 0.9
#: what a span may touch on either side
TOUCHES = ("open", "word", "sign")
#: bound of the feature combinations
CELLS = len(KINDS) * 3 ** len(LABELERS) * len(TOUCHES) ** 2


def running(a: Column, merge: Callable[[Column, Column], Column], zero: Column) -> Column:
    """Running fold of an array, in blocks so that long arrays are not copied per element."""
    def inside(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.array(start), lambda acc, x: F.concat(acc, F.array(merge(F.element_at(acc, -1), x))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda i: F.slice(a, i * BLOCK + 1, BLOCK))
    starts = inside(F.transform(blocks, lambda b: F.aggregate(b, zero, merge)), zero)
    folded = F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), lambda b, s: F.slice(inside(b, s), 2, BLOCK)))
    return F.when(F.size(a) > 0, folded).otherwise(F.slice(a, 1, 0))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)
    def value(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1))
        return F.when(i % 2 == 1, d).otherwise(F.translate(d, "0123456789", "0246813579")).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def accepted(kind: str, hit: Column) -> Column:
    """The base check of a match."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
        return hit.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(hit, "[ -]+", "")
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return hit.startswith("+") & F.length(F.regexp_replace(hit, "[^0-9]+", "")).between(9, 15)
    return F.lit(True)


def votes(kind: str, hit: Column, left: Column, right: Column, base: bool) -> list[Column]:
    """The labelers' votes as 1, 0 and -1, in their order."""
    def vote(yes: Column, no: Column | None = None) -> Column:
        out = F.when(yes, 1)
        return (out if no is None else out.when(no, -1)).otherwise(0)

    left_touch, right_touch = touch(left, False), touch(right, True)
    edge = vote((left_touch != "word") & (right_touch != "word"), (left_touch == "word") | (right_touch == "word"))
    context = [vote(F.lower(left).rlike(CUES[kind])), -vote(F.lower(left).rlike(COUNTER)), edge]
    digits = F.regexp_replace(hit, "[^0-9]+", "")
    if kind == "email":
        strict = F.lit(1) if base else vote(F.lit(False), ~F.lower(hit).rlike(r"[(\[](?:at|dot)[)\]]"))
        layout = vote(hit.rlike(r"^[A-Za-z0-9][^@]*@.*\.[A-Za-z]{2,}$|[(\[]dot[)\]] ?[A-Za-z]{2,}$"))
        return [strict, layout, vote(F.lower(hit).rlike(rf"(?:\.|[)\]] ?)(?:{TLD})$"), F.lit(True)), *context]
    ok = accepted(kind, hit)
    if kind == "ip":
        return [vote(ok, ~ok), vote(~hit.rlike(r"(?:^|\.)0[0-9]")), vote(~hit.rlike(NO_HOST), hit.rlike(NO_HOST)), *context]
    if kind == "card":
        layout = vote(hit.rlike("^(?:[0-9]{4}[ -]?){3}[0-9]{4}$|^3[0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{5}$"))
        return [vote(ok, ~ok), layout, vote(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS)), *context]
    plus = hit.startswith("+")
    layout = vote(hit.rlike(r"^(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$"))
    return [vote(ok, plus & ~ok), layout, vote(plus & digits.rlike(f"^(?:{CALLING})"), plus), *context]


def touch(side: Column, first: bool) -> Column:
    """What a span touches on a side: nothing or white space, a word character, a sign."""
    return (F.when(side.rlike(r"^[\p{L}\p{N}_]" if first else r"[\p{L}\p{N}_]$"), "word")
            .when((side == "") | side.rlike(r"^\s" if first else r"\s$"), "open").otherwise("sign"))


def _matches(text: Column, kind: str, pattern: str) -> tuple[Column, Column]:
    """(matches, pieces around them): the pieces as their length and both ends."""
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.struct(
        F.length(p).alias("n"), F.right(p, F.lit(BEFORE)).alias("tail"), F.left(p, F.lit(AFTER)).alias("head")))
    able = text.rlike(NEEDS[kind])
    return F.when(able, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), F.when(able, pieces)


def _spans(kind: str, found: str, pieces: str, ends: str, base: bool) -> Column:
    """Spans of one pattern as structs, in order of their start."""
    def span(hit: Column, i: Column) -> Column:
        left, right, end = F.get(F.col(pieces), i)["tail"], F.get(F.col(pieces), i + 1)["head"], F.get(F.col(ends), i)
        return F.struct((end - F.length(hit)).alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"),
                        *(v.cast("int").alias(n) for n, v in zip(LABELERS, votes(kind, hit, left, right, base), strict=True)),
                        touch(left, False).alias("left"), touch(right, True).alias("right"), (accepted(kind, hit) if base else F.lit(True)).alias("ok"))

    return F.filter(F.transform(F.col(found), span), lambda s: s["ok"])


def find_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` replaced by ``spans``: all base spans and those proposals that
    overlap none, in order, with their votes and what they touch."""
    others = [c for c in docs.columns if c != "text"]
    patterns = [(k, p[k], base) for base, p in ((True, BASE), (False, WIDE)) for k in KINDS]
    columns = []
    for i, (kind, pattern, _) in enumerate(patterns):
        found, pieces = _matches(F.col("text"), kind, pattern)
        columns += [found.alias(f"f{i}"), pieces.alias(f"p{i}")]
    cutting = docs.select(*others, *columns)
    ends = [running(F.zip_with(F.slice(f"p{i}", 1, F.size(f"f{i}")), f"f{i}", lambda p, f: p["n"] + F.length(f)), lambda s, x: s + x, F.lit(0)).alias(f"e{i}")
            for i in range(len(patterns))]
    placed = cutting.select("*", *ends)
    groups = [F.coalesce(_spans(kind, f"f{i}", f"p{i}", f"e{i}", base), F.array()) for i, (kind, _, base) in enumerate(patterns)]
    half = len(KINDS)
    split = placed.select(*others, F.concat(*groups[:half]).alias("base"), F.concat(*groups[half:]).alias("wide"))
    ordered = split.select(*others, F.array_sort(F.concat("base", "wide")).alias("spans"), ((F.size("base") > 0) & (F.size("wide") > 0)).alias("both"))
    # a proposal goes if the base spans begun before it reach into it, or one begins before it ends
    reach = running(F.transform("spans", lambda s: F.when(s["base"], s["end"]).otherwise(0)), lambda s, x: F.greatest(s, x), F.lit(0))
    ahead = F.reverse(running(F.reverse(F.transform("spans", lambda s: F.when(s["base"], s["start"]).otherwise(2**31 - 1))), lambda s, x: F.least(s, x), F.lit(2**31 - 1)))
    bounds = ordered.select("*", F.when(F.col("both"), reach).alias("reach"), F.when(F.col("both"), ahead).alias("ahead"))
    free = F.filter("spans", lambda s, i: s["base"] | ((F.get("reach", i) <= s["start"]) & (F.get("ahead", i) >= s["end"])))
    return bounds.select(*others, F.when(F.col("both"), free).otherwise(F.col("spans")).alias("spans"))


def estimate(counts: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], float]:
    """Chance that a span with these votes is true, by expectation-maximisation over the
    vote patterns of one kind.  The beliefs count as that many observations, so that
    "true" keeps its meaning where the votes alone would not tell."""
    n = sum(counts.values())
    pseudo = STRENGTH * n
    patterns = np.array(list(counts), int).reshape(-1, len(LABELERS))
    often = np.array(list(counts.values()), float)
    start = np.array([BELIEFS[x] for x in LABELERS])  # labeler, true or false, vote
    shares, prior = start.copy(), 0.5
    at = 1 - patterns  # for, none, against
    for _ in range(ROUNDS):
        like = [np.log(c) + sum(np.log(shares[j, y, at[:, j]]) for j in range(len(LABELERS))) for y, c in ((0, prior), (1, 1 - prior))]
        true = 1 / (1 + np.exp(np.clip(like[1] - like[0], -700, 700)))
        for y, weight in ((0, true * often), (1, (1 - true) * often)):
            for j in range(len(LABELERS)):
                shares[j, y] = (np.bincount(at[:, j], weight, 3) + pseudo * start[j, y]) / (weight.sum() + pseudo)
        prior = (true @ often + 0.5 * pseudo) / (n + pseudo)
    return dict(zip(map(tuple, patterns.tolist()), true.tolist(), strict=True))


def feature_names(kind: int, labels: tuple[int, ...], left: str, right: str) -> list[str]:
    return [f"{kind}", *(f"{kind}{n}{v}" for n, v in zip(LABELERS, labels, strict=True)), f"{kind}left{left}", f"{kind}right{right}"]


def train(cells: list[tuple[int, tuple[int, ...], str, str, int]]) -> dict[str, float]:
    """Weights of the span classifier from (kind, votes, left, right, count): logistic
    regression on the estimated chances, by Newton steps."""
    weights: dict[str, float] = {}
    for kind in range(len(KINDS)):
        own = [c for c in cells if c[0] == kind]
        if not own:
            continue
        counts: dict[tuple[int, ...], int] = {}
        for _, labels, _, _, n in own:
            counts[labels] = counts.get(labels, 0) + n
        chance = estimate(counts)
        rows = [feature_names(*c[:4]) for c in own]
        names = sorted({f for r in rows for f in r})
        x = np.zeros((len(own), len(names)))
        for i, r in enumerate(rows):
            x[i, [names.index(f) for f in r]] = 1
        n = np.array([c[4] for c in own], float)
        n, y, w = n / n.sum(), np.array([chance[c[1]] for c in own]), np.zeros(len(names))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
            grad = x.T @ (n * (p - y)) + L2 * w
            w -= np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + L2 * np.eye(len(names)), grad)
        weights |= dict(zip(names, w.tolist(), strict=True))
    return weights


def score(weights: dict[str, float], s: Column) -> Column:
    """Margin of the span classifier; features never seen weigh nothing."""
    table = F.create_map(*(F.lit(x) for item in sorted(weights.items()) for x in item)) if weights else F.create_map(F.lit(""), F.lit(0.0))
    kind = s["kind"].cast("string")
    names = [kind, *(F.concat(kind, F.lit(n), s[n].cast("string")) for n in LABELERS), F.concat(kind, F.lit("left"), s["left"]), F.concat(kind, F.lit("right"), s["right"])]
    return sum((F.coalesce(F.try_element_at(table, n), F.lit(0.0)) for n in names), F.lit(0.0))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sure: float = SURE) -> DataFrame:
    """One row per row of ``docs``: the id and ``spans``, an array of (start, end, kind, base)
    in code points, end exclusive, ordered by start and then kind.

    Base spans are all there and may overlap each other; an added one overlaps no base span, and
    the classifier holds it for true with a chance of at least ``sure``.  Null and empty
    texts have no spans.  Null and repeated ids and rows keep a row each; other columns are
    ignored; an empty table gives no rows, and learns nothing."""
    found = cut(find_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))))
    keys = ["kind", *LABELERS, "left", "right"]
    cells = [(r["kind"], tuple(r[n] for n in LABELERS), r["left"], r["right"], r["n"])
             for r in found.select(F.inline("spans")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()]  # at most CELLS rows
    weights = train(sorted(cells))
    limit = float(np.log(sure / (1 - sure)))
    kept = F.filter("spans", lambda s: s["base"] | (score(weights, s) >= limit))
    spans = F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"))))
    names = F.array(*(F.lit(k) for k in KINDS))
    return found.select(F.col("id").alias(id_col), F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("kind"), s["base"].alias("base"))).alias("spans"))


def span_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
