"""Personal data: pattern spans, and candidates chosen by boosted trees.

The base kinds are exact patterns.  Beyond them, generators of high recall propose spans
(obfuscated addresses, any grouping of digits, account numbers, long internet addresses); each
candidate gets format and context features, boosted trees score it, and a threshold calibrated on
held-out examples selects what is added.  Candidates may overlap one another, and lie outside base spans.

Everything on the way from a text to its spans or its redacted form is an expression over one row:
no shuffle, no Python on executors.  The trees are fitted on the driver from :data:`EXAMPLES`
generated examples (a fixed, bounded sample, made from templates), whose features come from the same
expressions; they are then an expression themselves.

Running sums over a text's matches are taken in blocks (:func:`scan`), and candidates are looked for
in the text with its base spans covered, so that a text's cost is in proportion to its length and its
matches.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, texts

KINDS = ("email", "ip", "card", "phone", "account")
#: Base patterns.  A run that fails from its start fails from any later start too, so runs are only
#: entered at their start or where the last match ended; repeated groups are possessive, which
#: changes no match and keeps the engine's stack flat on long texts.
BASE = {
    "email": r"(?=[A-Za-z0-9._%+-])(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: Generators of candidates.
GENERATORS = {
    "address": r"(?<![A-Za-z0-9._%+\-\ue000])[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\)|\{at\}|@)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\[dot\]|\(dot\)|\{dot\})\x20?[A-Za-z0-9-]{1,63}){1,6}",
    "digits": r"(?<![0-9A-Za-z.\ue000])[+(]?[0-9](?:[\x20().\-/_]{0,2}[0-9]){5,30}(?![0-9A-Za-z\ue000])",
    "iban": r"(?<![A-Za-z0-9\ue000])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "long_ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])",
}
GATES = {"address": r"\[at\]|\(at\)|\{at\}|@", "digits": r"[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "long_ip": r"[0-9A-Fa-f]:"}
#: Context words, by what they speak for (fixed values).
CONTEXT = {
    "says_phone": r"(?i)\b(?:tel|telephone|phone|call|mobile|cell|fax|whatsapp|sms|telefon|téléphone|teléfono|handy)\b",
    "says_card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\b",
    "says_account": r"(?i)\b(?:ssn|social|security|passport|iban|account|tax|konto|compte|cuenta|licen[cs]e)\b",
    "says_mail": r"(?i)\b(?:mail|e-mail|email|contact|write|reach)\b",
    "says_other": r"(?i)\b(?:order|invoice|version|isbn|issn|price|page|ref|item|total|sku|build|id|no|vol|pp|date|year|chapter|serial|eur|usd)\b",
}
ONE = "struct<start:int,stop:int,s:string,before:string,after:string>"
SPAN = f"array<{ONE}>"
EXAMPLES = 4000


#: Steps of a scan that share one growing array: appending copies it, so it is kept short.
STEPS = 128


def scan(n: Column, first: Column, kind: str, step) -> Column:
    """Items of a running state over 0 .. n - 1 (n at least 1), in time in proportion to n.

    ``step(state, k)`` gives struct(state, item: an array of ``kind``); the items of all steps are one
    array.  Steps are taken in blocks, whose items are joined at the end.
    """
    empty = F.array().cast(f"array<{kind}>")

    def inner(state: Column, block: Column) -> Column:
        ks = F.sequence(block * STEPS, F.least(n, (block + 1) * STEPS) - 1)
        add = lambda acc, k: let(step(acc["state"], k), lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], x["item"]).alias("out")))
        return F.aggregate(ks, F.struct(state.alias("state"), empty.alias("out")), add)

    def outer(acc: Column, block: Column) -> Column:
        return let(inner(acc["state"], block), lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor((n - 1) / STEPS).cast("int"))
    return F.aggregate(blocks, F.struct(first.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")), outer, lambda acc: F.flatten(acc["out"]))


def spans(text: Column, pattern: str) -> Column:
    """Matches with their places in code points and what stands around them.

    The texts between matches give the places: a match starts where the stretches and matches
    before it end.
    """

    def place(z: Column) -> Column:
        def step(at: Column, k: Column) -> Column:
            gap, s = F.get(z["g"], k), F.get(z["m"], k)
            start = at + F.char_length(gap)
            stop = start + F.char_length(s)
            after = F.get(z["g"], k + 1)
            one = F.struct(
                start.alias("start"), stop.alias("stop"), s.alias("s"), F.right(gap, F.lit(40)).alias("before"), F.left(after, F.lit(4)).alias("after")
            )
            return F.struct(stop.alias("state"), F.array(one).alias("item"))

        return F.when(F.size(z["m"]) == 0, F.array().cast(SPAN)).otherwise(scan(F.size(z["m"]), F.lit(0), ONE, step))

    return let(_cut(text, pattern), place)


def _cut(text: Column, pattern: str) -> Column:
    """struct(m: matches, g: the texts around them)."""
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))


#: Stands for each character that a base span covers (a private-use character).
COVER = "\ue000"


def covered(text: Column, found: Column) -> Column:
    """``text`` with the base spans covered, where there are any: the patterns run again, each on what the ones before it left."""

    def cover(t: Column, kind: str) -> Column:
        def join(z: Column) -> Column:
            parts = F.transform(F.sequence(F.lit(0), F.size(z["m"])), lambda k: F.concat(F.get(z["g"], k), let(F.coalesce(F.get(z["m"], k), F.lit("")), lambda m: F.when(_passes(kind, m), F.repeat(F.lit(COVER), F.char_length(m))).otherwise(m))))
            return F.array_join(parts, "")

        return let(_cut(t, BASE[kind]), join)

    def unless_none(kind: str):
        return lambda t: F.when(F.exists(found, lambda x: x["kind"] == kind), cover(t, kind)).otherwise(t)

    out = text
    for kind in BASE:
        out = let(out, unless_none(kind))
    return F.when(F.size(found) == 0, text).otherwise(out)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))),
        F.lit(0),
        lambda acc, x: acc + F.coalesce(x, F.lit(0)),
    )
    return total % 10 == 0


def _filter(found: Column, keep) -> Column:
    return F.filter(found, lambda x: keep(x["s"]))


def _named(found: Column, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"], F.lit(KINDS.index(kind) + 1).alias("rank"), s["stop"], F.lit(kind).alias("kind")))


def _described(found: Column, generator: int) -> Column:
    whole = F.transform(found, lambda x: F.struct(x["start"], x["stop"], x["s"], x["before"], x["after"], _digits(x["s"]).alias("d")))
    return F.transform(
        whole, lambda x: F.struct(x["start"], x["stop"], x["s"], F.array(*(f.cast("double") for f in features(x, generator))).alias("x"))
    )


def _n_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _passes(kind: str, s: Column) -> Column:
    """The checks on a match of a base pattern; an empty one fails."""
    return {
        "email": lambda: s != "",
        "ip": lambda: s.rlike(OCTETS),
        "card": lambda: let(_digits(s), lambda d: F.char_length(d).between(14, 19) & luhn(d)),
        "phone": lambda: F.char_length(_digits(s)).between(10, 15),
    }[kind]()


def base_spans(text: Column) -> dict[str, Column]:
    """For each base kind, its spans after the checks on digits."""
    none = F.array().cast(SPAN)
    out = {}
    for kind, pattern in BASE.items():
        gate = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike("[0-9]")
        out[kind] = F.when(gate, _filter(spans(text, pattern), lambda s, kind=kind: _passes(kind, s))).otherwise(none)
    return out


FEATURES = (
    "generator", "n_digits", "length", "n_groups", "first_group", "last_group", "plus", "paren", "dots", "slashes", "dashes", "blanks",
    "letters", "luhn", "octets", "dateish", "spelled_at", *CONTEXT, "letter_before", "point_before", "letter_after", "money_after",
)


def features(x: Column, generator: int) -> list[Column]:
    """Numbers that describe a candidate's form and surroundings, in the order of FEATURES."""
    s, before, after = x["s"], x["before"], x["after"]
    n = lambda pattern: (F.char_length(s) - F.char_length(F.regexp_replace(s, pattern, ""))).cast("int")
    flag = lambda c: c.cast("int")
    digits = x["d"]
    return [
        F.lit(generator),
        F.char_length(digits),
        F.char_length(s),
        F.size(F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0))),
        F.char_length(F.regexp_extract(s, "([0-9]+)", 1)),
        F.char_length(F.regexp_extract(s, "([0-9]+)[^0-9]*$", 1)),
        n(r"[^+]"),
        n(r"[^()]"),
        n(r"[^.]"),
        n(r"[^/]"),
        n(r"[^-]"),
        n(r"[^ ]"),
        n(r"[^A-Za-z]"),
        flag(F.char_length(digits).between(12, 19) & luhn(digits)),
        flag(s.rlike(OCTETS)),
        flag(s.rlike(r"^(?:(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2})")),
        flag(s.rlike(r"\[at\]|\(at\)|\{at\}")),
        *(flag(before.rlike(p)) for p in CONTEXT.values()),
        flag(before.rlike(r"[A-Za-z]$")),
        flag(before.rlike(r"[.,:#$€£]\x20?$")),
        flag(after.rlike(r"^[A-Za-z]")),
        flag(after.rlike(r"^\x20?[%$€£]")),
    ]


def candidates(text: Column) -> Column:
    """All proposals: struct(start, stop, s, x: features as doubles)."""
    none = F.array().cast("array<struct<start:int,stop:int,s:string,x:array<double>>>")
    found = []
    for number, (name, pattern) in enumerate(GENERATORS.items()):
        own = _described(spans(text, pattern), number)
        found.append(F.when(text.rlike(GATES[name]), own).otherwise(none))
    return F.concat(*found)


# the model


def _examples(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, stop, label) made from templates; personal forms are labelled 1."""
    pick = random.Random(seed)
    d = lambda k: "".join(pick.choice("0123456789") for _ in range(k))
    word = lambda: "".join(pick.choice("abcdefghilmnorstuvw") for _ in range(pick.randint(2, 8)))

    def luhned(k: int) -> str:
        body = d(k - 1)
        return next(body + c for c in "0123456789" if sum(int(x) if i % 2 == 0 else (2 * int(x) - 9 if int(x) > 4 else 2 * int(x)) for i, x in enumerate(reversed(body + c))) % 10 == 0)

    def groups(s: str, sep: str) -> str:
        return sep.join(s[i : i + 4] for i in range(0, len(s), 4))

    personal = [
        (lambda: f"({d(3)}) {d(3)}-{d(4)}", ("phone", "call", "")),
        (lambda: f"{d(3)}-{d(3)}-{d(4)}", ("phone", "tel", "fax", "")),
        (lambda: f"{d(3)}.{d(3)}.{d(4)}", ("tel", "mobile")),
        (lambda: f"0{d(3)} {d(7)}", ("telefon", "mobile", "call")),
        (lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", ("tel", "téléphone", "")),
        (lambda: f"{d(3)}-{d(2)}-{d(4)}", ("ssn", "social security", "")),
        (lambda: groups(luhned(16), pick.choice((".", "_", "/"))), ("card", "visa", "")),
        (lambda: luhned(13), ("card", "visa", "credit card")),
        (lambda: pick.choice(("DE", "FR", "ES", "GB")) + d(2) + " " + groups(d(18), " "), ("iban", "account", "")),
        (lambda: f"{word()} [at] {word()} [dot] com", ("mail", "")),
        (lambda: f"{word()}.{word()}(at){word()}.org", ("contact", "")),
        (lambda: ":".join("%04x" % pick.randrange(65536) for _ in range(8)), ("ip", "")),
    ]
    other = [
        (lambda: f"{pick.randint(1900, 2029)}-{pick.randint(1, 12):02d}-{pick.randint(1, 28):02d}", ("date", "", "on")),
        (lambda: f"{pick.randint(1, 28)}/{pick.randint(1, 12)}/{pick.randint(1900, 2029)}", ("date", "", "on")),
        (lambda: f"{d(1)}.{d(2)}.{d(4)}", ("version", "build", "")),
        (lambda: d(pick.choice((7, 8, 9, 10, 12, 16, 16, 16, 18, 20))), ("order", "invoice", "", "", "item")),
        (lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", ("isbn", "")),
        (lambda: f"{d(2)}.{d(3)}.{d(3)}", ("price", "total", "eur", "")),
        (lambda: f"{pick.randint(1, 9)}{d(5)}.{d(2)}", ("price", "total", "usd", "")),
        (lambda: f"{d(3)}-{d(4)}", ("pp", "ref", "serial", "")),
        (lambda: f"{d(4)}-{d(4)} {d(2)}", ("pp", "vol", "serial")),
        (lambda: f"{pick.randint(1900, 2020)} - {pick.randint(1900, 2029)}", ("year", "from", "")),
        (lambda: f"{d(2)}:{d(2)}:{d(2)}", ("at", "")),
        (lambda: f"{word()} @ {d(2)}.{d(2)}", ("price", "")),
        (lambda: f"{d(3)}.{d(3)}.{d(3)}.{d(3)}9", ("version", "")),
    ]
    out = []
    for i in range(n):
        label = i % 2
        make, hints = pick.choice(personal if label else other)
        body, hint = make(), pick.choice(hints)
        left = " ".join([word() for _ in range(pick.randint(0, 6))] + ([hint + pick.choice(("", ":", " no"))] if hint else []))
        left = left + " " if left else ""
        right = pick.choice(("", ".", " ", ",")) + " ".join(word() for _ in range(pick.randint(0, 4)))
        out.append((left + body + (" " + right if right[:1].isalpha() else right), len(left), len(left) + len(body), label))
    return out


class Trees:
    """Gradient-boosted depth-two trees for a binary label, with Platt calibration."""

    def __init__(self, rounds: int = 40, rate: float = 0.3, penalty: float = 2.0, precision: float = 0.99):
        self.rounds, self.rate, self.penalty, self.precision = rounds, rate, penalty, precision
        self.trees: list[tuple] = []

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[int, float, float]:
        best = (0, float("inf"), -1.0)
        whole = g.sum() ** 2 / (h.sum() + penalty)
        for f in range(x.shape[1]):
            cuts, at = np.unique(x[:, f], return_inverse=True)
            if len(cuts) < 2:
                continue
            gs, hs = np.bincount(at, g).cumsum()[:-1], np.bincount(at, h).cumsum()[:-1]
            gain = gs**2 / (hs + penalty) + (g.sum() - gs) ** 2 / (h.sum() - hs + penalty) - whole
            k = int(gain.argmax())
            if gain[k] > best[2]:
                best = (f, float((cuts[k] + cuts[k + 1]) / 2), float(gain[k]))
        return best

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for f, c, sides in self.trees:
            for mask, (f2, c2, low, high) in zip((x[:, f] < c, x[:, f] >= c), sides):
                out += mask * np.where(x[:, f2] < c2, low, high)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        own = np.arange(len(x)) % 4 != 0
        tx, ty, margin = x[own], y[own], np.zeros(own.sum())
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = ty - p, p * (1 - p)
            f, c, _ = self._split(tx, g, h, self.penalty)
            sides = []
            for mask in (tx[:, f] < c, tx[:, f] >= c):
                f2, c2, _ = self._split(tx[mask], g[mask], h[mask], self.penalty) if mask.any() else (0, float("inf"), 0.0)
                leaf = []
                for part in (mask & (tx[:, f2] < c2), mask & (tx[:, f2] >= c2)):
                    leaf.append(float(self.rate * g[part].sum() / (h[part].sum() + self.penalty)))
                sides.append((f2, c2, *leaf))
            self.trees.append((f, c, tuple(sides)))
            margin = self.margin(tx)
        self._calibrate(self.margin(x[~own]), y[~own])
        return self

    def _calibrate(self, m: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling and the lowest threshold of the wanted precision, on held-out examples."""
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * m + b)))
            a, b = a + 0.5 * float(((y - p) * m).mean()), b + 0.5 * float((y - p).mean())
        self.scale = (a, b)
        p = 1 / (1 + np.exp(-(a * m + b)))
        order = np.argsort(-p)
        good = np.cumsum(y[order]) / np.arange(1, len(y) + 1) >= self.precision
        self.threshold = float(max(0.5, p[order][np.flatnonzero(good)[-1]])) if good.any() else 1.0
        chosen = p >= self.threshold
        self.held_out = {"precision": float(y[chosen].mean()) if chosen.any() else 1.0, "recall": float(chosen[y == 1].mean())}

    def expression(self, x: Column) -> Column:
        """The calibrated probability as an expression over an array of features."""
        total = F.lit(self.scale[1])
        for f, c, sides in self.trees:
            low, high = (F.when(x[f2] < F.lit(c2), F.lit(self.scale[0] * lo)).otherwise(F.lit(self.scale[0] * hi)) for f2, c2, lo, hi in sides)
            total = total + F.when(x[f] < F.lit(c), low).otherwise(high)
        return 1 / (1 + F.exp(-total))


_FITTED: dict[tuple[int, int], Trees] = {}


def model(spark: SparkSession, examples: int = EXAMPLES, seed: int = 11) -> Trees:
    """The trees, fitted once in a process on a bounded sample of generated examples."""
    if (examples, seed) not in _FITTED:
        made = json.dumps([dict(zip(("text", "start", "stop", "label"), e)) for e in _examples(examples, seed)])
        rows = (
            spark.range(1)
            .select(F.explode(F.from_json(F.lit(made), "array<struct<text:string,start:int,stop:int,label:int>>")).alias("e"))
            .select("e.*")
            .select("start", "stop", "label", F.explode(candidates(F.col("text"))).alias("c"))
            .select((F.col("label") * ((F.col("c.start") < F.col("stop")) & (F.col("c.stop") > F.col("start"))).cast("int")).alias("y"), "c.x")
            .orderBy(F.xxhash64("x"), "y")
            .collect()
        )
        _FITTED[examples, seed] = Trees().fit(np.array([r.x for r in rows], float), np.array([r.y for r in rows], float))
    return _FITTED[examples, seed]


def _kind(c: Column) -> Column:
    """The kind of a chosen candidate, by its form."""
    at = {name: i for i, name in enumerate(FEATURES)}
    x = c["x"]
    return (
        F.when(x[0] == 0, "email")
        .when(x[0] == 3, "ip")
        .when(x[0] == 2, "account")
        .when(x[at["octets"]] == 1, "ip")
        .when((x[at["luhn"]] == 1) & (x[at["n_digits"]] >= 12), "card")
        .when((x[at["n_digits"]] == 9) & (x[at["first_group"]] == 3) & (x[at["last_group"]] == 4), "account")
        .otherwise("phone")
    )


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """Spans of personal data in each row's text.

    ``base`` and ``spans``: arrays of struct(start, rank, stop, kind) in order (start, then the
    kind's place in KINDS), in code points with ``stop`` exclusive; ``base`` has the exact patterns,
    ``spans`` these and the chosen candidates.  Texts of any length are searched whole, in time in
    proportion to them and their matches.  Spans of one start (ties) stand by their kind, then their end.
    A null or empty text has none; null ids and repeated
    rows each have their row; an empty table gives no rows.  ``more``: other columns to keep.
    """
    trees = model(docs.sparkSession)
    step = docs.select(
        docs[id_col].cast("long").alias("_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"), F.struct(*(docs[c] for c in more), F.lit(1).alias("_")).alias("_more")
    )
    own = base_spans(F.col("_text"))
    named = [_named(v, k) for k, v in own.items()]
    step = step.select("*", F.array_sort(F.concat(*named)).alias("base"))
    # candidates are looked for where no base span lies
    step = step.select("*", covered(F.col("_text"), F.col("base")).alias("_open"))
    chosen = F.filter(candidates(F.col("_open")), lambda c: trees.expression(c["x"]) >= F.lit(trees.threshold))
    added = F.transform(chosen, lambda c: F.struct(c["start"], _order(_kind(c)).alias("rank"), c["stop"], _kind(c).alias("kind")))
    once = lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1)))
    return step.select("_id", "_text", "_more", "base", let(F.array_sort(F.concat("base", added)), once).alias("spans"))


def spell(found: Column) -> Column:
    """``kind:start:end`` for each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact_text(text: Column, found: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans become one.

    Where spans are many, pieces are taken from the text's characters, since finding a place in a
    string takes as long as the place is far.
    """

    def rebuilt(piece) -> Column:
        def step(at: Column, k: Column) -> Column:
            s = F.get(found, k)
            before = F.when(s["start"] > at, piece(at, s["start"] - at)).otherwise(F.lit(""))
            item = F.when(s["start"] >= at, F.array(before, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))).otherwise(F.array().cast("array<string>"))
            # the end of the last span is followed by the rest of the text
            last = F.when(k == F.size(found) - 1, F.array(piece(F.greatest(at, s["stop"]), F.lit(1 << 30)))).otherwise(F.array().cast("array<string>"))
            return F.struct(F.greatest(at, s["stop"]).alias("state"), F.concat(item, last).alias("item"))

        return F.array_join(scan(F.size(found), F.lit(0), "string", step), "")

    by_place = rebuilt(lambda at, n: F.substring(text, at + 1, n))
    by_character = let(F.split(text, ""), lambda chars: rebuilt(lambda at, n: F.array_join(F.slice(chars, at + 1, n), "")))
    return F.when(F.size(found) == 0, text).when(F.size(found) <= STEPS, by_place).otherwise(by_character)


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, counts of the base kinds, and the spans spelled out (``base``, ``spans``); cases as in :func:`find`."""
    found = find(docs, id_col=id_col, text_col=text_col)
    return found.select(F.col("_id").alias("doc_id"), *map(_n_of, BASE), spell(F.col("base")).alias("base"), spell(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced; a null text stays null, other columns stay as they are."""
    names = docs.columns
    found = find(docs, id_col=id_col, text_col=text_col, more=tuple(names))
    out = [redact_text(F.col("_text"), F.col("spans")).alias(c) if c == text_col else F.col("_more")[c].alias(c) for c in names]
    keep_null = F.col("_more")[text_col].isNull()
    return found.select(*(F.when(~keep_null, o).alias(c) if c == text_col else o for c, o in zip(names, out)))
