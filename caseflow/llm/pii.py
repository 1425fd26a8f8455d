"""Personal data: overlapping candidates, boosted trees over format and context, calibrated thresholds.

High-recall patterns propose spans of each kind, which may overlap. Those that a strict rule of the
kind confirms (its base) always stay, and only they divide the text: where a strict match fails its
check, spans inside it are proposed too. Further spellings that pass the kind's check
(of digits, parts or domain) are judged by gradient-boosted trees on how a candidate is written and
what stands around it. The trees learn over all documents. Positive are confirmed spans, as they are
and rewritten into the further spellings (at and dot written out, another separator, no leading plus)
where they stand. Negative are candidates that fail the check, of those that overlap one. They stand for
what passes it by chance: of digits without meaning one in ten passes a card's, so nine that fail count
as one. Further spellings that are found are unlabelled. A candidate is added where its probability reaches the kind's
threshold, set on documents that gave no counts so that most candidates above it are positive.

Features have few values, so all candidates of all documents fall together into a table of at most a
few thousand rows of counts. The driver fits the trees to that table and writes them as expressions;
no function of Python runs in a task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import text_of
from caseflow.llm.quality_rules import let
from caseflow.sources.sinks import staged

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
# A pattern that begins with a run of characters is tried at the start of the run only (or where the
# last match ended): that finds the same matches, and long runs cost their length.
_RUN = r"(?:\G|(?<!{0}))"
BASE = {
    "email": _RUN.format(_LOCAL) + _LOCAL + r"++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _RUN.format("[0-9]") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A phone number led by a plus begins at the plus.
_LED = r"(?<![0-9+(]|\+[0-9]{1,3}[\x20.-]|\+[0-9]{1,3}[\x20.-]\()"
# Further spellings: at and dot written out, digits in groups with other separators, no leading plus.
GENEROUS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+"
    r"(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Fa-f.:])(?:[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f.:])",
    "card": r"(?<![0-9])[0-9]{3,6}+(?:[\x20./-][0-9]{2,7}+){2,4}+(?![0-9])",
    "phone": _LED + r"\(?[0-9]{2,4}+\)?[\x20.-][0-9]{2,4}+[\x20.-][0-9]{3,4}+(?![0-9])",
}
# Where numbers stand side by side, a span is tried from every group, in every number of groups, so that
# spans overlap: per kind the stretches that are looked through (all the text, if none), and the forms tried in them.
STRETCHES = {
    "ip": r"[0-9]++(?:\.[0-9]++){3,}+",
    "card": r"[0-9](?:[\x20./-]?[0-9]){12,}+",
    "phone": r"[+(]{0,2}[0-9](?:[\x20().+-]{0,3}[0-9]){8,}+",
}
_GROUP = r"[\x20().-]{1,3}[0-9]{2,8}"
FORMS = {
    "email": (GENEROUS["email"].replace("(?<![A-Za-z0-9])", f"(?<!{_LOCAL})"),),
    "ip": (r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",),
    "card": (
        r"(?<![0-9])[0-9]{13,19}(?![0-9])",
        *[rf"(?<![0-9])[0-9]{{2,8}}(?:[\x20./-][0-9]{{2,8}}){{{n}}}(?![0-9])" for n in (1, 2, 3, 4)],
    ),
    # a form ends before a number that goes on with a point
    "phone": (
        r"\+[0-9]{9,15}(?![0-9])",
        *[rf"\+[0-9]{{1,5}}(?:{_GROUP}){{{n}}}(?![0-9]|\.[0-9])" for n in (1, 2, 3, 4)],
        *[rf"{_LED}\(?[0-9]{{2,5}}(?:{_GROUP}){{{n}}}(?![0-9]|\.[0-9])" for n in (1, 2, 3, 4)],
    ),
}
SPANS = "array<struct<start:int,stop:int,found:string,before:string,after:string>>"
NEAR = 24  # characters of context
# Words before a candidate that announce its kind.
HINTS = {
    "email": "mail|contact|write|courriel|correo",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|master|credit|karte|carte|tarjeta",
    "phone": "tel|phone|call|fax|mobile|telefon|llama",
}
# How many candidates pass a kind's check by chance for one that fails it, where that is known.
CHANCE = {"card": 1 / 9}
FEATURES = ("digits", "groups", "marks", "hint", "left", "right", "shape")


def spans(text: Column, pattern: str, overlap: bool = False) -> Column:
    """Non-overlapping matches from the left: array of (start, stop, found, before, after); code points.

    With ``overlap`` the match of every place, whatever else it overlaps. Lengths of the stretches
    between matches give the places. Running sums are kept in blocks, so that a text with very many
    matches does not copy its list of spans for each.
    """
    first, group = 0, 0
    if overlap:  # matches of no length, each with what it sees; the first is not at the start, where nothing is split off
        text, pattern = F.concat(F.lit("\n"), text), f"(?=({pattern})((?s:.{{0,{NEAR}}})))"
        first, group = -1, 1
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    empty = F.array().cast(SPANS)

    def placed(pieces: Column) -> Column:
        def put(state: Column, x: Column) -> Column:
            start = state["at"] + F.length(x["gap"])
            stop = start + F.length(x["found"])
            own = F.struct(
                start.alias("start"), stop.alias("stop"), x["found"].alias("found"),
                F.right(x["gap"], F.lit(NEAR)).alias("before"), F.left(x["next"], F.lit(NEAR)).alias("after"),
            )
            at = start if overlap else stop
            return F.struct(at.alias("at"), F.concat(state["out"], F.array(own)).alias("out"))

        def block(state: Column, b: Column) -> Column:
            inner = F.aggregate(b, F.struct(state["at"].alias("at"), empty.alias("out")), put)
            return let(
                inner,
                lambda i: F.struct(i["at"].alias("at"), F.concat(state["out"], i["out"]).alias("out")),
            )

        def rows(z: Column) -> Column:
            n = F.size(z)
            firsts = F.sequence(F.lit(1), n, F.lit(256))
            blocks = F.transform(firsts, lambda i: F.slice(z, i, F.lit(256)))
            return F.aggregate(blocks, F.struct(F.lit(first).alias("at"), empty.alias("out")), block)["out"]

        if overlap:
            following = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        else:
            following = F.slice(pieces, F.lit(2), F.size(pieces) - 1)
        zipped = F.arrays_zip(
            F.slice(pieces, F.lit(1), F.size(pieces) - 1).alias("gap"),
            found.alias("found"),
            following.alias("next"),
        )
        return let(zipped, rows)

    return F.when(F.size(found) == 0, empty).otherwise(let(F.split(text, pattern, -1), placed))


def luhn(found: Column) -> Column:
    """Every second digit from the right doubled, less 9 if above 9; the sum ends in 0."""
    digits = F.reverse(F.regexp_replace(found, "[^0-9]", ""))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def confirmed(kind: str, found: Column) -> Column:
    digits = F.length(F.regexp_replace(found, "[^0-9]", ""))
    if kind == "email":
        return found.rlike(f"^{_LOCAL}+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)++$")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return found.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.when(digits.between(13, 19), found.rlike("^[0-9](?:[\\x20-]?[0-9])++$") & luhn(found)).otherwise(False)
    return digits.between(9, 15) & found.rlike("^\\+")


def passes(kind: str, found: Column) -> Column:
    """The kind's check, whatever the spelling."""
    digits = F.length(F.regexp_replace(found, "[^0-9]", ""))
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(found, r"[(\[]at[)\]]", "@"), r"[(\[]dot[)\]]", ".")
        return F.regexp_replace(plain, " ", "").rlike(f"^{_LOCAL}+@(?:[A-Za-z0-9-]+\\.)+[A-Za-z]{{2,}}$")
    if kind == "ip":
        return confirmed("ip", found) | found.rlike("^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$")
    if kind == "card":
        return F.when(digits.between(13, 19), luhn(found)).otherwise(False)
    return digits.between(9, 15)


def rewritten(kind: str, found: Column) -> list[Column]:
    """A confirmed span in further spellings; null where it has none."""
    if kind == "email":
        local, domain = F.substring_index(found, "@", 1), F.substring_index(found, "@", -1)
        spelt = ((" (at) ", " (dot) "), ("(at)", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "))
        return [F.concat(local, F.lit(at), F.replace(domain, F.lit("."), F.lit(dot))) for at, dot in spelt]
    if kind == "card":
        digits = F.regexp_replace(found, "[^0-9]", "")
        return [F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", f"$1{mark}") for mark in ("/", ".")]
    if kind == "phone":
        own = F.regexp_replace(found, r"^\+[0-9]{1,3}[\x20.-]?", "")
        plain = F.regexp_replace(own, "[()]", "")
        ways = [own, *[F.regexp_replace(plain, "[\\x20.-]+", mark) for mark in (".", "-", " ")]]
        return [F.when(passes(kind, x), x) for x in ways]
    return []


def looks(kind: str, x: Column) -> dict[str, Column]:
    """Features of a candidate: small whole numbers."""
    found, before, after = x["found"], x["before"], x["after"]
    digits = F.length(F.regexp_replace(found, "[^0-9]", ""))
    return {
        "digits": F.least(digits, F.lit(20)),
        "groups": F.least(F.size(F.split(found, "[^A-Za-z0-9]+")), F.lit(8)),
        "marks": F.when(found.rlike("[()\\[\\]]"), 2).otherwise(0) + F.when(found.rlike("[./:@]"), 1).otherwise(0),
        "hint": F.lower(before).rlike(f"(?:{HINTS[kind]})[^A-Za-z0-9]*$").cast("int"),
        "left": F.when(before.rlike("[A-Za-z0-9]$"), 2).when(before.rlike("[^\\sA-Za-z0-9]$"), 1).otherwise(0),
        "right": F.when(after.rlike("^[A-Za-z0-9]"), 2).when(after.rlike("^[^\\sA-Za-z0-9]"), 1).otherwise(0),
        # the last group has three or four digits, and groups before it three: as phone numbers are written
        "shape": F.when(found.rlike("(?:^|[^0-9])[0-9]{3}[^0-9]+[0-9]{3}[^0-9]+[0-9]{4}$"), 2)
        .when(found.rlike("[0-9]{4}[^0-9]+[0-9]{4}$"), 1)
        .otherwise(0),
    }


@dataclass(frozen=True)
class Tree:
    """Depth two: feature and cut of the root, then of both sides; four leaves."""

    cuts: tuple[tuple[str, int], ...]
    leaves: tuple[float, ...]

    def column(self, x: dict[str, Column]) -> Column:
        (f, a), (g, b), (h, c) = self.cuts
        left = F.when(x[g] <= b, F.lit(self.leaves[0])).otherwise(F.lit(self.leaves[1]))
        right = F.when(x[h] <= c, F.lit(self.leaves[2])).otherwise(F.lit(self.leaves[3]))
        return F.when(x[f] <= a, left).otherwise(right)

    def values(self, table: np.ndarray) -> np.ndarray:
        column = {n: table[:, i] for i, n in enumerate(FEATURES)}
        (f, a), (g, b), (h, c) = self.cuts
        left = np.where(column[g] <= b, self.leaves[0], self.leaves[1])
        return np.where(column[f] <= a, left, np.where(column[h] <= c, self.leaves[2], self.leaves[3]))


@dataclass(frozen=True)
class Model:
    start: float
    trees: tuple[Tree, ...]
    threshold: float | None  # on the sum of the trees; None: nothing is added

    def values(self, table: np.ndarray) -> np.ndarray:
        return self.start + sum((t.values(table) for t in self.trees), np.zeros(len(table)))

    def total(self, x: dict[str, Column]) -> Column:
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + tree.column(x)
        return total


def _split(table, grad, hess, rows) -> tuple[str, int]:
    """The cut that gains most over the rows; ties take the first feature and value."""
    best, cut = -1.0, (FEATURES[0], 0)
    for i, name in enumerate(FEATURES):
        values = np.unique(table[rows, i])
        for value in values[:-1] if len(values) > 1 else values:
            low = rows & (table[:, i] <= value)
            high = rows & ~low
            gain = sum(grad[m].sum() ** 2 / (hess[m].sum() + 1.0) for m in (low, high))
            if gain > best + 1e-12:
                best, cut = gain, (name, int(value))
    return cut


def boost(table: np.ndarray, yes: np.ndarray, no: np.ndarray, rounds: int = 20, rate: float = 0.3) -> Model:
    """Gradient boosting of the logistic loss on counted rows."""
    total = yes + no
    start = float(np.log((yes.sum() + 1) / (no.sum() + 1)))
    value, trees = np.full(len(table), start), []
    for _ in range(rounds if len(table) > 1 else 0):
        p = 1 / (1 + np.exp(-value))
        grad, hess = yes - total * p, total * p * (1 - p)
        everything = np.ones(len(table), bool)
        root = _split(table, grad, hess, everything)
        low = table[:, FEATURES.index(root[0])] <= root[1]
        cuts, leaves = [root], []
        for side in (low, ~low):
            cut = _split(table, grad, hess, side) if side.any() else root
            cuts.append(cut)
            below = table[:, FEATURES.index(cut[0])] <= cut[1]
            for part in (side & below, side & ~below):
                leaves.append(float(rate * grad[part].sum() / (hess[part].sum() + 1.0)))
        trees.append(Tree(tuple(cuts), tuple(leaves)))
        value = value + trees[-1].values(table)
    return Model(start, tuple(trees), None)


def calibrated(model: Model, table: np.ndarray, yes: np.ndarray, no: np.ndarray, precision: float) -> Model:
    """The lowest threshold above which ``precision`` of the held-back candidates is confirmed.

    The share is estimated with half a candidate more on either side, so few candidates must be the surer.
    """
    value, chosen = model.values(table), None
    for cut in sorted(np.unique(value), reverse=True):
        above = value >= cut
        if yes[above].sum() + 0.5 >= precision * (yes[above].sum() + no[above].sum() + 1.0):
            chosen = float(cut) - 1e-9
        elif chosen is not None:
            break
    return Model(model.start, model.trees, chosen)


def _where(rule: Callable[[str, Column], Column], kind: str, holds: bool = True) -> Callable[[Column], Column]:
    return lambda x: rule(kind, x["found"]) if holds else ~rule(kind, x["found"])


def _chosen(model: Model, kind: str, more: Column) -> Column:
    """Of the candidates, in order of place, those that the trees take: of overlapping ones the likeliest, then the longest."""
    shape = "struct<rank:double,size:int,start:int,stop:int,found:string>"
    none = F.array().cast(f"array<{shape}>")
    if model.threshold is None:
        return none

    def ranked(x: Column) -> Column:
        rank = -F.round(model.total(looks(kind, x)), 9)
        return F.struct(rank.alias("rank"), (x["start"] - x["stop"]).alias("size"), x["start"], x["stop"], x["found"])

    def best(group: Column) -> Column:
        def take(kept: Column, x: Column) -> Column:
            clash = F.exists(kept, lambda y: (y["start"] < x["stop"]) & (x["start"] < y["stop"]))
            return F.when(clash, kept).otherwise(F.concat(kept, F.array(x)))

        return F.when(F.size(group) < 2, group).otherwise(F.aggregate(F.array_sort(group), none, take))

    def state(reach: Column, group: Column, out: Column) -> Column:
        return F.struct(reach.alias("reach"), group.alias("group"), out.alias("out"))

    def sweep(s: Column, x: Column) -> Column:
        # a group is a run of candidates each of which overlaps one before it
        return F.when(
            x["start"] < s["reach"], state(F.greatest(s["reach"], x["stop"]), F.concat(s["group"], F.array(x)), s["out"])
        ).otherwise(state(x["stop"], F.array(x), F.concat(s["out"], best(s["group"]))))

    def swept(taken: Column) -> Column:
        groups = F.aggregate(taken, state(F.lit(-1), none, none), sweep, lambda s: F.concat(s["out"], best(s["group"])))
        return F.when(F.size(taken) < 2, taken).otherwise(groups)

    passing = F.transform(F.filter(more, _where(passes, kind)), ranked)
    return let(F.filter(passing, lambda x: -x["rank"] >= model.threshold).cast(f"array<{shape}>"), swept)


def _cleared(text: Column, kind: str, strict: Column) -> Column:
    """The text with every confirmed span of the kind made blank lines, which no spelling crosses."""

    def put(gap: Column, x: Column) -> Column:
        own = F.when(confirmed(kind, x["found"]), F.repeat(F.lit("\n"), F.length(x["found"]))).otherwise(x["found"])
        return F.concat(gap, F.coalesce(own, F.lit("")))

    return F.array_join(F.zip_with(F.split(text, BASE[kind], -1), strict, put), "")


def _further(text: Column, kind: str) -> Column:
    """Spans of the further spellings of a kind, which may overlap, in a text cleared of its confirmed spans."""

    def within(x: Column) -> Column:
        def moved(y: Column) -> Column:
            return F.struct(
                (y["start"] + x["start"]).alias("start"), (y["stop"] + x["start"]).alias("stop"), y["found"],
                F.right(F.concat(x["before"], F.ltrim(y["before"], F.lit("\n"))), F.lit(NEAR)).alias("before"),
                F.left(F.concat(y["after"], x["after"]), F.lit(NEAR)).alias("after"),
            )

        return F.transform(F.concat(*[spans(x["found"], form, overlap=True) for form in FORMS[kind]]), moved)

    if kind not in STRETCHES:
        return F.concat(spans(text, GENEROUS[kind]), *[spans(text, form, overlap=True) for form in FORMS[kind]])
    return F.concat(spans(text, GENEROUS[kind]), F.flatten(F.transform(spans(text, STRETCHES[kind]), within)))


def _distinct(found: Column) -> Column:
    """In order of place, each place once."""
    same = lambda a, b: (a["start"] == b["start"]) & (a["stop"] == b["stop"])
    return let(F.array_sort(found), lambda z: F.filter(z, lambda x, i: (i == 0) | ~same(x, F.get(z, F.greatest(i - 1, F.lit(0))))))


def _spellings(kind: str, base: Column) -> Column:
    """Confirmed spans, and each rewritten into the further spellings of its kind."""

    def every(x: Column) -> Column:
        ways = [F.when(w.isNotNull(), x.withField("found", w)) for w in rewritten(kind, x["found"])]
        return F.array(x, *ways)

    return F.array_compact(F.flatten(F.transform(base, every)))


def _apart(found: Column) -> Column:
    """Of candidates in order of place, where some overlap, the longest of those that begin first."""
    order = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("at"), (-x["stop"]).alias("end"), x.alias("x"))))
    ahead = lambda z, i: F.get(z, F.greatest(i - 1, F.lit(0)))["end"]
    kept = let(order, lambda z: F.filter(z, lambda x, i: (i == 0) | (x["at"] >= -ahead(z, i))))
    return F.transform(kept, lambda x: x["x"])


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, and per kind arrays of spans: ``base_<kind>`` (confirmed), ``more_<kind>`` (all other candidates)."""
    text = F.col("text")
    rows = docs.select(docs[id_col].alias("doc_id"), text_of(text_col).alias("text"))
    none = F.array().cast(SPANS)
    # a text without the sign that every match of a kind has is not searched further
    strict_sign = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike("[0-9][\\x20-]?[0-9]"),
        "phone": text.rlike(r"\+[0-9]"),
    }
    wide_sign = {
        "email": strict_sign["email"] | text.rlike(r"[(\[]at[)\]]"),
        "ip": text.rlike("[0-9][.:][0-9A-Fa-f]|[A-Fa-f]:[0-9A-Fa-f]"),
        "card": text.rlike("[0-9][\\x20./-]?[0-9]"),
        "phone": text.rlike("[0-9][\\x20().-]{0,3}[0-9]"),
    }

    def searched(kind: str) -> Callable[[Column], Column]:
        def both(strict: Column) -> Column:
            cleared = F.when(F.size(strict) == 0, text).otherwise(_cleared(text, kind, strict))
            if kind in ("card", "phone"):  # a piece of a confirmed address is no number of its own
                cleared = let(cleared, lambda x: F.when(strict_sign["ip"], _cleared(x, "ip", spans(x, BASE["ip"]))).otherwise(x))
            wide = F.when(wide_sign[kind], let(cleared, lambda x: _further(x, kind))).otherwise(none)
            return F.struct(strict.alias("strict"), wide.alias("wide"))

        return both

    columns = {}
    for kind in KINDS:
        strict = F.when(strict_sign[kind], spans(text, BASE[kind])).otherwise(none)
        columns[kind] = let(strict, searched(kind))
    rows = rows.select("doc_id", *[c.alias(n) for n, c in columns.items()])
    kept = {}
    for kind in KINDS:
        strict = F.col(f"{kind}.strict")
        kept[f"base_{kind}"] = F.filter(strict, _where(confirmed, kind))
        more = F.concat(F.filter(strict, _where(confirmed, kind, False)), F.col(f"{kind}.wide"))
        if kind == "card":  # a short number is no candidate
            more = F.filter(more, lambda x: F.length(F.regexp_replace(x["found"], "[^0-9]", "")) >= 13)
        kept[f"more_{kind}"] = _distinct(more)
    return rows.select("doc_id", *[c.alias(n) for n, c in kept.items()])


def learn(found: DataFrame, precision: float = 0.9, held_back: int = 4) -> dict[str, Model]:
    """One model per kind from the candidates of all documents."""
    tables = None
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(held_back)) == 0
    for kind in KINDS:
        base, more = F.col(f"base_{kind}"), F.col(f"more_{kind}")
        failed = F.filter(more, _where(passes, kind, False))
        both = F.concat(
            F.transform(_spellings(kind, base), lambda x: F.struct(x.alias("x"), F.lit(1).alias("y"))),
            F.transform(_apart(failed), lambda x: F.struct(x.alias("x"), F.lit(0).alias("y"))),
        )
        rows = found.filter((F.size(base) > 0) | (F.size(more) > 0)).select(part.alias("held"), F.explode(both).alias("c"))
        seen = rows.select("held", F.col("c.y").alias("y"), *[v.alias(n) for n, v in looks(kind, F.col("c.x")).items()])
        counts = seen.groupBy("held", "y", *FEATURES).count().withColumn("kind", F.lit(kind))
        tables = counts if tables is None else tables.unionByName(counts)
    sums: dict[str, dict[tuple, list[float]]] = {kind: {} for kind in KINDS}
    for row in tables.collect():  # at most the combinations of feature values
        entry = sums[row["kind"]].setdefault(tuple(row[n] for n in FEATURES), [0.0] * 4)
        entry[2 * int(row["held"]) + row["y"]] += row["count"] * (1.0 if row["y"] else CHANCE.get(row["kind"], 1.0))
    models = {}
    for kind, own in sums.items():
        table = np.array(sorted(own), dtype=int).reshape(-1, len(FEATURES))
        counts = np.array([own[tuple(int(v) for v in x)] for x in table]).reshape(-1, 4)
        model = boost(table, counts[:, 1], counts[:, 0])
        models[kind] = calibrated(model, table, counts[:, 3], counts[:, 2], precision)
    return models


def find_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.9
) -> DataFrame:
    """Per document: doc_id, and per kind ``base_<kind>`` and ``added_<kind>``, arrays of (start, stop, found).

    Places are code points, the stop exclusive. Of candidates that overlap, the likeliest is added;
    added spans overlap no span of their own kind. Null or empty text has no spans. A kind adds none if
    no threshold reaches ``precision``; at 0.9 that takes four confirmed spans held back, if all above it are. Repeated rows: one result each. Empty table: no
    rows.
    """
    found = staged(candidates(docs, id_col, text_col))
    models = learn(found, precision)
    columns = {}
    for kind in KINDS:
        slim = lambda x: F.struct(x["start"], x["stop"], x["found"])
        chosen = _chosen(models[kind], kind, F.col(f"more_{kind}"))
        columns[f"base_{kind}"] = F.transform(f"base_{kind}", slim)
        columns[f"added_{kind}"] = F.transform(chosen, slim)
    return found.select("doc_id", *[c.alias(n) for n, c in columns.items()])
