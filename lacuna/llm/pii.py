"""Personal data by candidate gradient boosting, with Spark functions alone.

Generators with high recall propose spans, which may overlap. Each candidate gets a small code from its format (kind,
length, share of digits, separators) and context (neighbours, cue words, other candidates). One grouped count over all
texts gives, for each code, how many candidates a strict check confirms (weak labels: digit sums, ranges, known
prefixes) and how many it refutes; there are at most ``CELLS`` codes, so the counts fit the driver at any input size.
Trees are boosted on these counts, and scores are calibrated by isotonic regression; the threshold of each kind is the
lowest calibrated probability at which the kept candidates reach ``precision``. The trees become nested CASE
expressions, applied on the rows. The base spans always stay; the model adds spans.

Defined cases: a null text counts as empty; repeated rows and ids stay apart; other columns are ignored; an empty table
gives no rows; a kind without candidates has no threshold and adds nothing; spans of equal start are ordered by NAMES.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.spans import cut, let, scan, spans_of, with_blocks
from lacuna.llm.common import keyed, written

#: The base patterns, with start guards and possessive loops that keep the same matches in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators of further candidates.
LOCAL = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
NUMBER = r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SPELLED = r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]{2,64}(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[a-z]{2,24}|\.[a-z]{2,24})"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "local", "number", "iban", "spelled")
#: Names of spans: what looks like a base kind to the model but fails its check has a name of its own.
NAMES = (*KINDS, *(f"{k}_like" for k in BASE))
CUES = r"(?i)(?:tel|phone|call|fax|mail|contact|ssn|social|iban|account|card|ip|address)[^\n]{0,12}$"
#: Sizes of the features: kind, length, digits, separators, left, right, cue, company.
SIZES = (len(KINDS), 4, 4, 3, 3, 3, 2, 2)
CELLS = math.prod(SIZES)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    at = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * (i % 2 + 1))
    return F.aggregate(at, F.lit(0), lambda a, d: a + F.coalesce(F.when(d > 9, d - 9).otherwise(d), F.lit(0))) % 10 == 0


def digits_of(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]+", "")


def base_valid(kind: str, v: Column) -> Column:
    d = digits_of(v)
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(x.try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.length(d).between(14, 19) & luhn(d)
    return F.length(d).between(10, 15) if kind == "phone" else F.lit(True)


def strictly_valid(kind: str, v: Column) -> Column:
    """The weak label of a candidate."""
    d = digits_of(v)
    if kind == "email":
        return F.rlike(v, F.lit(r"\.[A-Za-z]{2,24}$")) & ~F.rlike(v, F.lit(r"\.\.|^\.|\.@"))
    if kind == "ip":
        return base_valid(kind, v) & ~F.rlike(v, F.lit(r"^0|\.0[0-9]"))
    if kind == "card":
        return base_valid(kind, v) & F.rlike(d, F.lit("^[2-6]"))
    if kind == "local":
        return F.rlike(d, F.lit("^[2-9][0-9]{2}[2-9]"))
    if kind == "number":
        return ~F.rlike(d, F.lit("^(?:000|666|9)|^...00|0000$"))
    if kind == "iban":
        return (F.length(F.regexp_replace(v, " ", "")).between(15, 34)) & (F.length(d) >= 8)
    return base_valid(kind, v)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``uid, doc_id, row, base, found``: the base spans, and every candidate with its code, its label and whether it is a base span; ``row`` holds the input's columns. Narrow."""
    t = F.col("text")
    df = keyed(docs, id_col, text_col, F.struct("*").alias("row")).withColumns({"at": t.contains("@"), "number": F.rlike(t, F.lit("[0-9]{2}|[0-9][\x20.-][0-9]"))})
    digits = F.col("number")
    raw = {
        "email": spans_of(t, EMAIL, F.col("at")), "ip": spans_of(t, IP, digits & t.contains(".")), "card": spans_of(t, CARD, digits),
        "phone": spans_of(t, PHONE, digits & t.contains("+")), "local": spans_of(t, LOCAL, digits), "number_": spans_of(t, NUMBER, digits & t.contains("-")),
        "iban": spans_of(t, IBAN, digits), "spelled": spans_of(t, SPELLED, F.rlike(t, F.lit(r"(?i)[\[(]\x20?at\x20?[\])]"))),
    }
    df = df.withColumns({f"raw_{k.strip('_')}": v for k, v in raw.items()})

    def kept(kind: str) -> Column:
        return F.filter(f"raw_{kind}", lambda x: base_valid(kind, x["v"])) if kind in BASE else F.col(f"raw_{kind}")

    df = df.withColumns({f"ok_{k}": kept(k) for k in BASE})
    n_base = sum(F.size(f"ok_{k}") for k in BASE)

    def described(blocks: Column, kind: str) -> Column:
        def one(x: Column) -> Column:
            v = x["v"]
            d = F.length(digits_of(v))
            before = lambda n: cut(blocks, F.greatest(x["s"] - n, F.lit(0)), F.least(x["s"], F.lit(n)))
            right = cut(blocks, x["e"], 1)
            side = lambda c: F.when(F.rlike(c, F.lit(r"[\p{L}\p{N}]")), 2).when(F.rlike(c, F.lit(r"[^\s,;:()]")), 1).otherwise(0)
            parts = [
                F.lit(KINDS.index(kind)), F.when(F.length(v) < 11, 0).when(F.length(v) < 15, 1).when(F.length(v) < 21, 2).otherwise(3),
                F.least(F.floor(d * 4 / F.length(v)), F.lit(3)).cast("int"), F.least(F.floor(F.length(F.regexp_replace(v, "[A-Za-z0-9]+", "")) / 2), F.lit(2)).cast("int"),
                F.when(x["s"] == 0, 0).otherwise(side(before(1))), side(right),
                F.rlike(before(24), F.lit(CUES)).cast("int"), (n_base > 1).cast("int"),
            ]
            code = F.lit(0)
            for part, size in zip(parts, SIZES, strict=True):
                code = code * size + part
            return F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), v.alias("v"), code.cast("int").alias("code"), F.coalesce(strictly_valid(kind, v), F.lit(False)).alias("label"), (F.coalesce(base_valid(kind, v), F.lit(False)) if kind in BASE else F.lit(False)).alias("base"))

        of = F.filter(f"raw_{kind}", lambda x: F.length(digits_of(x["v"])).between(9, 21)) if kind == "card" else F.col(f"raw_{kind}")
        return F.transform(of, one)

    def plain(kind: str) -> Column:
        return F.transform(f"ok_{kind}", lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), x["v"].alias("v")))

    some = sum(F.size(f"raw_{k}") for k in KINDS) > 0
    every = with_blocks(t, some, lambda b: F.concat(*(described(b, k) for k in KINDS)))
    return df.select("uid", "doc_id", "row", F.concat(*map(plain, BASE)).alias("base"), every.alias("found"))


class Boosted:
    """Trees over the cells, each a root split and one split on either side; probabilities by isotonic steps."""

    def __init__(self, counts: dict[int, tuple[int, int]], rounds: int = 16, rate: float = 0.4, precision: float = 0.85):
        self.trees: list = []
        cells = [(self.features(c), n, y, c) for c, (n, y) in sorted(counts.items())]
        total, hits = sum(n for _, n, _, _ in cells), sum(y for _, _, y, _ in cells)
        self.start = math.log((hits + 1) / (total - hits + 1))
        scores = [self.start] * len(cells)
        for _ in range(rounds if cells else 0):
            grads = []
            for (f, n, y, _), s in zip(cells, scores, strict=True):
                p = 1 / (1 + math.exp(-s))
                grads.append((f, y - n * p, n * p * (1 - p)))
            tree = self.grown(grads, rate)
            if tree is None:
                break
            self.trees.append(tree)
            scores = [s + self.value(tree, f) for s, (f, *_) in zip(scores, cells, strict=True)]
        self.cuts = self.thresholds(cells, scores, precision)

    @staticmethod
    def features(code: int) -> tuple[int, ...]:
        out = []
        for size in reversed(SIZES):
            out.append(code % size)
            code //= size
        return tuple(reversed(out))

    @staticmethod
    def best(grads: list) -> tuple | None:
        """The split of most gain: feature, value; on the kind ``=``, else ``<=``."""
        found = None
        g0, h0 = sum(g for _, g, _ in grads), sum(h for *_, h in grads)
        for i, v in ((i, v) for i, size in enumerate(SIZES) for v in range(size - (i > 0))):
            side = [(g, h) for f, g, h in grads if (f[i] == v if i == 0 else f[i] <= v)]
            if not side or len(side) == len(grads):
                continue
            g, h = sum(x for x, _ in side), sum(x for _, x in side)
            gain = g * g / (h + 1) + (g0 - g) ** 2 / (h0 - h + 1) - g0 * g0 / (h0 + 1)
            if gain > 1e-6 and (found is None or gain > found[0] + 1e-9):
                found = (gain, i, v)
        return found and found[1:]

    def grown(self, grads: list, rate: float) -> tuple | None:
        root = self.best(grads)
        if root is None:
            return None
        leaf = lambda part: rate * sum(g for _, g, _ in part) / (sum(h for *_, h in part) + 1)
        sides = []
        for want in (True, False):
            part = [x for x in grads if self.goes(root, x[0]) is want]
            split = self.best(part)
            sides.append((split, *(leaf([x for x in part if self.goes(split, x[0]) is w]) for w in (True, False))) if split else (None, leaf(part), 0.0))
        return root, *sides

    @staticmethod
    def goes(split: tuple[int, int], f: tuple[int, ...]) -> bool:
        return f[split[0]] == split[1] if split[0] == 0 else f[split[0]] <= split[1]

    def value(self, tree: tuple, f: tuple[int, ...]) -> float:
        root, left, right = tree
        split, a, b = left if self.goes(root, f) else right
        return a if split is None or self.goes(split, f) else b

    @staticmethod
    def thresholds(cells: list, scores: list[float], precision: float) -> dict[int, float]:
        """For each kind the lowest score whose calibrated probability reaches ``precision``."""
        cuts = {}
        for kind in range(len(KINDS)):
            steps: list[list[float]] = []  # score, candidates, hits; pooled while they fall
            for s, (_, n, y, _) in sorted((s, c) for s, c in zip(scores, cells, strict=True) if c[0][0] == kind):
                steps.append([s, n, y])
                while len(steps) > 1 and steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]:
                    _, n1, y1 = steps.pop()
                    steps[-1] = [steps[-1][0], steps[-1][1] + n1, steps[-1][2] + y1]
            cut = next((s for s, n, y in steps if (y + 0.5) / (n + 1) >= precision), None)
            if cut is not None:
                cuts[kind] = cut - 1e-9
        return cuts

    def score(self, code: Column) -> Column:
        parts, below = [], 1
        for size in reversed(SIZES):
            parts.append(F.pmod(F.floor(code / below), F.lit(size)))
            below *= size
        parts.reverse()
        test = lambda split: parts[split[0]] == split[1] if split[0] == 0 else parts[split[0]] <= split[1]
        leaf = lambda side: F.lit(side[1]) if side[0] is None else F.when(test(side[0]), side[1]).otherwise(side[2])
        total = F.lit(self.start)
        for root, left, right in self.trees:
            total = total + F.when(test(root), leaf(left)).otherwise(leaf(right))
        return total

    def selected(self) -> set[int]:
        """The codes whose candidates are redacted, for a look at what was learned."""
        every = product(*map(range, SIZES))
        out = set()
        for code, f in enumerate(every):
            if f[0] in self.cuts and self.start + sum(self.value(t, f) for t in self.trees) >= self.cuts[f[0]]:
                out.add(code)
        return out


def fit(found: DataFrame, **options: float) -> Boosted:
    """Learns from the candidates of all rows: at most CELLS rows reach the driver."""
    one = found.select(F.explode_outer("found").alias("c")).where("c is not null").groupBy("c.code").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c.label").cast("long")).alias("y"))
    return Boosted({r["code"]: (r["n"], r["y"]) for r in one.collect()}, **options)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Boosted | None = None, rows: bool = False) -> DataFrame:
    """``doc_id, spans``, with ``rows`` also ``row``: one row for each input row; spans are ``struct<kind, start, end,
    value>`` by start, then kind; ``row`` holds the input's columns.

    The texts are searched once: the coded candidates are written to the shared folder, and what is learned from them is
    applied to them.
    """
    found = written(candidates(docs, id_col, text_col).select("doc_id", *(["row"] if rows else []), "base", "found"), "candidates")
    model = model or fit(found)
    cuts = F.create_map(*(F.lit(x) for kv in (model.cuts or {-1: 0.0}).items() for x in kv))

    def added(c: Column) -> Column:
        return ~c["base"] & F.coalesce(model.score(c["code"]) >= F.element_at(cuts, c["k"]), F.lit(False))

    kind = lambda c: F.when(c["k"] < len(BASE), c["k"] + len(KINDS)).otherwise(c["k"])
    more = F.transform(F.filter("found", added), lambda c: F.struct(c["s"].alias("s"), kind(c).alias("k"), c["e"].alias("e"), c["v"].alias("v")))
    name = F.array(*map(F.lit, NAMES))
    shaped = lambda x: F.struct(F.element_at(name, x["k"] + 1).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), x["v"].alias("value"))
    return found.select("doc_id", *(["row"] if rows else []), F.transform(F.array_sort(F.concat("base", more)), shaped).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each group of overlapping spans replaced by [KIND] of the first."""

    def step(b: Column, p: Column, x: Column) -> tuple[Column, Column]:
        new = F.array(cut(b, p, x["start"] - p), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.greatest(x["end"], p), F.when(x["start"] < p, F.array().cast("array<string>")).otherwise(new)

    walked = let(spans, lambda xs: with_blocks(text, F.size(xs) > 0, lambda b: scan(xs, F.lit(0), lambda p, x: step(b, p, x), "array<string>")))
    whole = let(walked, lambda w: F.concat(F.array_join(w["o"], ""), F.substring(text, w["c"] + 1, F.lit(2147483647))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Boosted | None = None) -> DataFrame:
    """The input's columns, with all spans of the text replaced by their kinds; null texts stay null."""
    found = find_pii(docs, id_col, text_col, model, rows=True)
    clean = redacted(F.col("row")[text_col].cast("string"), F.col("spans"))
    return found.select(*(clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
