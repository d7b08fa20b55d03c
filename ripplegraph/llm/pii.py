"""Personal data by weak supervision, in DataFrame expressions only.

Base spans (email, ip, card, phone) are exact: leftmost, non-overlapping per kind, then checked.
Further candidates (loose phone numbers, identity numbers, spelled-out addresses, secrets) come from
wider patterns. Five labelers vote yes (1), no (-1) or nothing (0) on every candidate: the strict
form (regex), a gazetteer of cue words before it, the punctuation before it, the characters touching
it, and its mix of characters. Expectation-maximisation over the counts of vote patterns estimates
each labeler's reliability without any labels; a logistic span classifier is then trained on the
posteriors, over votes, kind and length, and its weights become a column expression. Base spans
always stay and count as certain; the classifier decides on the others, which must not overlap them.

Spans are found without Python: split() gives the text between matches, regexp_extract_all() the
matches, and running lengths give positions in code points. Patterns are written so that Java's
matcher never recurses over a long run (separators between digits are first marked by one character).

Only the counts of patterns of votes and features reach the driver; there are at most
4 kinds * 3**5 votes * 4 lengths of them, whatever the input.

Long lists of spans are put together in groups, so texts of any length and number of spans are worked on whole.

Defined cases: null text counts as empty and stays null under redaction; no rows, or no candidates:
prior weights, no further spans. Each row is answered by itself, so repeated rows repeat answers.
Columns that this module adds replace columns of the same names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("number", "identity", "secret", "spoken")
KINDS = BASE_KINDS + MORE_KINDS
LABELERS = ("strict", "cue", "punctuation", "touching", "mixture")
SPAN = "struct<start:int,rank:int,kind:string,end:int,score:double>"

_LOCAL = r"A-Za-z0-9._%+\x03-"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Patterns of the base kinds in a form equal to the stated ones: possessive where nothing can be
#: given back, and starts inside a run that has already failed are skipped.
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++\x03[A-Za-z0-9\x03-]*+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9\x01]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Wider patterns of the further kinds.
WIDE = {
    "number": r"(?<![0-9+)(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+",
    "spoken": r"(?i)(?<![a-z0-9._-])[a-z0-9._-]++ ?[\[(](?:at)[\])] ?[a-z0-9-]{1,63} ?[\[(](?:dot)[\])] ?[a-z]{2,12}(?![a-z])",
}
STRICT = {
    "number": r"^(?:\([2-9][0-9]{2}\) |[2-9][0-9]{2}-)[2-9][0-9]{2}-[0-9]{4}$",
    "identity": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "secret": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?:sk|pk|ghp|AKIA)[A-Za-z0-9_-]{16,})$",
    "spoken": r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|uk)$",
}
# The gazetteer, cue words that stand before a span, by kind, in English, German, French, Spanish and Japanese.
GAZETTEER = {
    "number": "phone tel call mobile fax contact telefon anruf handy kontakt téléphone appel portable teléfono llamar móvil contacto 電話 携帯",
    "identity": "ssn social identity tax id ausweis steuer identité sécurité identidad fiscal seguro 番号",
    "secret": "token secret password passwd key bearer credential passwort kennwort schlüssel geheim jeton clé contraseña clave llave 鍵 暗号",
    "spoken": "mail contact write reach schreib kontakt écri courriel correo escrib 連絡",
}
#: Up to two words may stand between a cue and its span.
CUES = {kind: rf"(?iU)(?:{'|'.join(words.split())})\W{{0,5}}(?:\w+\W{{1,3}}){{0,2}}$" for kind, words in GAZETTEER.items()}


def _found(text: Column, pattern: str) -> Column:
    """array<struct<start,end,match>> of a pattern's matches; positions in code points, end exclusive."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    # one gap more than matches: the last one meets none
    pairs = F.filter(F.zip_with(between, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match"))), lambda p: p["match"].isNotNull())

    def step(at: Column, item: Column) -> tuple[Column, Column]:
        start = at + item["gap"]
        end = start + F.length(item["match"])
        return end, F.struct(start.alias("start"), end.alias("end"), item["match"].alias("match"))

    return _running(pairs, step, "struct<start:int,end:int,match:string>")


def _running(items: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str, group: int = 64) -> Column:
    """One result per item, each from the item and a number carried on from the item before (0 at first).

    Groups of results are put together first and joined at the end, so that a long list is not copied for every item.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, item: Column) -> Column:
        at, out = step(acc["at"], item)
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(out.cast(kind))).alias("out"))

    def all_of(known: Column) -> Column:
        def many(acc: Column, g: Column) -> Column:
            some = F.aggregate(F.slice(known, g * group + 1, F.lit(group)), F.struct(acc["at"].alias("at"), none.alias("out")), one, lambda x: F.array(x))
            return F.aggregate(some, acc, lambda whole, x: F.struct(x["at"].alias("at"), F.concat(whole["out"], F.array(x["out"])).alias("out")))

        groups = F.sequence(F.lit(0), F.floor((F.size(known) - 1) / group).cast("int"))
        return F.flatten(F.aggregate(groups, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out")), many)["out"])

    # the list of items is bound to a name, so that it is found once
    return F.get(F.transform(F.array(items), lambda known: F.when(F.size(known) > 0, all_of(known)).otherwise(none)), F.lit(0))


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,match:string>>")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = digits.substr(-i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _base(text: Column) -> dict[str, Column]:
    dotted = F.regexp_replace(F.translate(text, "\x03", "\x04"), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", "\x03")
    joined = F.regexp_replace(F.translate(text, "\x01", "\x02"), r"(?<=[0-9])[ -](?=[0-9])", "\x01")
    size = lambda s: F.length(_digits(s["match"]))
    return {
        "email": F.when(text.contains("@"), _found(dotted, EMAIL)).otherwise(_none()),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(_found(text, IP), lambda s: s["match"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))).otherwise(_none()),
        "card": F.when(
            text.rlike(r"[0-9](?:[ -]?[0-9]){13}"), F.filter(F.filter(_found(joined, CARD), lambda s: size(s).between(14, 19)), lambda s: _luhn(_digits(s["match"])))
        ).otherwise(_none()),
        "phone": F.when(text.contains("+"), F.filter(_found(text, PHONE), lambda s: size(s).between(10, 15))).otherwise(_none()),
    }


def _candidates(text: Column) -> Column:
    """array of further candidates with their votes and length class."""

    def judge(kind: str) -> Callable[[Column], Column]:
        def judged(s: Column) -> Column:
            before = text.substr(F.greatest(s["start"] - 31, F.lit(1)), F.least(s["start"], F.lit(32)))
            around = F.concat(text.substr(F.greatest(s["start"], F.lit(1)), F.least(s["start"], F.lit(1))), F.lit(" "), text.substr(s["end"] + 1, F.lit(1)))
            m = s["match"]
            length = s["end"] - s["start"]
            return F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.lit(kind).alias("kind"),
                F.when(m.rlike(STRICT[kind]), 1).otherwise(-1 if kind == "secret" else 0).alias("strict"),
                F.when(before.rlike(CUES[kind]), 1).otherwise(0).alias("cue"),
                F.when(before.rlike(r"[:=] ?[\"']?$"), 1).otherwise(0).alias("punctuation"),
                F.when(around.rlike(r"[\p{L}\p{N}]"), -1).otherwise(0).alias("touching"),
                F.when(m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.length(_digits(m)) * 5 >= length), 1).when(F.lit(kind == "secret"), -1).otherwise(0).alias("mixture"),
                F.when(length < 16, 0).when(length < 32, 1).when(length < 64, 2).otherwise(3).alias("size"),
            )

        return judged

    out = []
    for kind, pattern in WIDE.items():
        kind_struct = "array<struct<start:int,end:int,kind:string,strict:int,cue:int,punctuation:int,touching:int,mixture:int,size:int>>"
        gate = {"number": r"[0-9]{3}[) .-]+[0-9]{3}[ .-][0-9]{4}", "identity": r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "secret": r"[A-Za-z0-9_+/-]{20}", "spoken": r"(?i)[\[(]at[\])]"}[kind]
        out.append(F.when(text.rlike(gate), F.transform(_found(text, pattern), judge(kind)).cast(kind_struct)).otherwise(F.array().cast(kind_struct)))
    return F.concat(*out)


def _features(kind: Column, votes: list[Column], size: Column) -> list[Column]:
    num = lambda c: c.cast("double")
    return [*map(num, votes), *(num(kind == k) for k in WIDE), *(num(size == i) for i in range(4))]


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 60) -> tuple[float, list[list[list[float]]], list[float]]:
    """Prior, P(vote | class) per labeler and the posterior of every pattern, from (votes, count) rows."""
    n = len(LABELERS)
    prior = 0.5
    like = [[[0.45, 0.35, 0.20], [0.15, 0.35, 0.50]] for _ in range(n)]  # [labeler][no, yes][vote -1, 0, 1]
    post: list[float] = [0.5] * len(patterns)
    total = sum(c for _, c in patterns)
    for _ in range(rounds if total else 0):
        for i, (votes, _) in enumerate(patterns):
            yes, no = math.log(prior), math.log(1 - prior)
            for j, v in enumerate(votes):
                yes += math.log(like[j][1][v + 1])
                no += math.log(like[j][0][v + 1])
            post[i] = 1 / (1 + math.exp(min(700, no - yes)))
        mass = sum(p * c for p, (_, c) in zip(post, patterns, strict=True))
        prior = min(0.95, max(0.05, (mass + 1) / (total + 2)))
        for j in range(n):
            for cls in (0, 1):
                seen = [0.5, 0.5, 0.5] if cls else [0.6, 0.5, 0.4]
                for p, (votes, c) in zip(post, patterns, strict=True):
                    seen[votes[j] + 1] += c * (p if cls else 1 - p)
                like[j][cls] = [x / sum(seen) for x in seen]
    return prior, like, post


def train_classifier(rows: list[tuple[tuple[float, ...], float, float]], rounds: int = 200, rate: float = 1.0, ridge: float = 1e-3) -> list[float]:
    """Weights (the last is the bias) of a logistic model on (features, target, count) rows."""
    if not rows:
        return []
    size, total = len(rows[0][0]), sum(c for *_, c in rows)
    w = [0.0] * (size + 1)
    for _ in range(rounds):
        grad = [ridge * x for x in w]
        for x, target, count in rows:
            z = w[-1] + sum(a * b for a, b in zip(w, x, strict=False))
            g = (1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) - target) * count / total
            for j, v in enumerate(x):
                grad[j] += g * v
            grad[-1] += g
        w = [a - rate * g for a, g in zip(w, grad, strict=True)]
    return w


def fit(docs: DataFrame, text_col: str = "text") -> list[float]:
    """Weights of the span classifier, from all candidates of all documents."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cands = docs.select(F.explode(_candidates(text)).alias("c")).select("c.*")
    keys = [*LABELERS, "kind", "size"]
    counted = cands.groupBy(*keys).agg(F.count("*").alias("n"))
    table = counted.select(F.array(*[F.col(x) for x in LABELERS]).alias("votes"), F.array(*_features(F.col("kind"), [F.col(x) for x in LABELERS], F.col("size"))).alias("x"), "n")
    rows = sorted(((tuple(r["votes"]), tuple(r["x"]), float(r["n"])) for r in table.collect()))
    _, _, post = expectation_maximisation([(v, n) for v, _, n in rows])
    return train_classifier([(x, p, n) for (_, x, n), p in zip(rows, post, strict=True)])


def _certain(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.lit(1.0).alias("score")))


def detect(docs: DataFrame, weights: list[float], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs plus `spans`: all spans by start, then kind; base spans have score 1."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(*[_certain(spans, r, k) for r, (k, spans) in enumerate(_base(text).items())])
    out = docs.withColumn("spans", base.cast(f"array<{SPAN}>"))
    if not weights:
        return out.withColumn("spans", F.array_sort("spans"))

    def scored(c: Column) -> Column:
        x = _features(c["kind"], [c[v] for v in LABELERS], c["size"])
        z = F.lit(weights[-1])
        for w, f in zip(weights, x, strict=False):
            z = z + F.lit(w) * f
        rank = F.lit(len(BASE_KINDS))
        for i, k in enumerate(WIDE):
            rank = F.when(c["kind"] == k, len(BASE_KINDS) + i).otherwise(rank)
        return F.struct(c["start"].alias("start"), rank.alias("rank"), c["kind"].alias("kind"), c["end"].alias("end"), (1 / (1 + F.exp(-z))).alias("score"))

    apart = lambda s: ~F.exists(F.col("spans"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    more = F.filter(F.transform(_candidates(text), scored), lambda s: (s["score"] >= threshold) & apart(s))
    return out.withColumn("spans", F.array_sort(F.concat("spans", more.cast(f"array<{SPAN}>"))))


def redact(detected: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace every detected span by its kind in square brackets; overlapping spans become one."""
    text = F.col(text_col)

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        piece = F.concat(text.substr(at + 1, s["start"] - at), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        end = F.greatest(at, s["end"])
        return end, F.struct(F.when(s["start"] < at, "").otherwise(piece).alias("piece"), end.alias("end"))

    own = "pieces"
    while own in detected.columns:
        own += "_"
    cut = detected.withColumn(own, _running(F.col("spans"), step, "struct<piece:string,end:int>"))
    rest = text.substr(F.element_at(own, -1)["end"] + 1, F.length(text))
    whole = F.concat(F.array_join(F.transform(own, lambda p: p["piece"]), ""), rest)
    return cut.withColumn(text_col, F.when(F.size("spans") > 0, whole).otherwise(text)).drop("spans", own)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str) -> Column:
    """Number of detected spans of a kind."""
    return F.size(F.filter("spans", lambda s: s["kind"] == kind))
