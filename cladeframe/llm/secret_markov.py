"""Secret scans: fixed rules, and runs that a Markov model of random strings explains better.

Two first-order models over characters are trained on labelled runs: what the fixed rules
find is labelled random, the other runs of at least ``TRAIN`` characters are ordinary
identifiers and words.  Every run of at least ``RUN`` characters with a letter and a digit
is scored by its log-likelihood ratio; one above ``LEAST`` is an added span.  Where a fixed
rule has found a part of a run, the parts beside it are scored, each by itself and whatever
its length.  A model is 66 x 66 cells, so its size never grows.

The whole scan is a projection of built-in functions: no join, no shuffle.  Spans are found
by cutting a text at the matches; the sizes of the pieces and of the matches, in code
points, add up to the places.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules of the base scan, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # runs are maximal, so the length may stand in the pattern
RULES = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
ADDED = "markov"
KINDS = (*(r[0] for r in RULES), ADDED)

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
STATES = len(SYMBOLS) + 1  # and the start, 0
TRAIN, RUN = 12, 20
LEAST = 10.0
#: Added to every cell: the random model tends to uniform where it has seen little.
SMOOTH_RANDOM, SMOOTH_ORDINARY = 0.5, 0.05

_CLASS = "[A-Za-z0-9+/_-]"
ORDINARY_RUN = f"(?<!{_CLASS}){_CLASS}{{{TRAIN},}}"
MIXED_RUN = rf"(?<!{_CLASS})(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z]){_CLASS}{{{RUN},}}"

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _found(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Matches of one rule as spans, first to last; ``value`` is the group's text."""
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.filter(F.arrays_zip(gaps.alias("g"), whole.alias("s"), values.alias("v")), lambda x: x["s"].isNotNull())
    none = F.array().cast(_SPAN)
    walked = F.aggregate(
        rows, F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["g"] + x["s"]).alias("at"),
            F.concat(a["out"], F.array(F.struct(
                (a["at"] + x["g"]).alias("start"), F.lit(kind).alias("kind"),
                (a["at"] + x["g"] + x["s"]).alias("end"), x["v"].alias("value"),
            ))).alias("out"),
        ),
    )["out"]
    return F.when(text.rlike(pattern), F.filter(walked, lambda s: F.char_length(s["value"]) >= least)).otherwise(none)


def base_spans(text: Column) -> Column:
    """All spans of the fixed rules."""
    return F.concat(*(_found(text, p, k, group, least) for k, (_, p, group, least) in enumerate(RULES)))


def _states(run: Column) -> Column:
    return F.transform(F.split(run, ""), lambda c: F.instr(F.lit(SYMBOLS), c))


def _steps(run: Column) -> Column:
    """One cell number for each character: state before it and state at it."""
    before = F.concat(F.array(F.lit(0)), _states(run))
    cells = F.zip_with(before, _states(run), lambda a, b: a * STATES + b)
    return F.filter(cells, lambda x: x.isNotNull())


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio of each cell, random over ordinary."""

    ratios: tuple[float, ...]

    def score(self, run: Column) -> Column:
        table = F.lit(list(self.ratios))
        return F.aggregate(_steps(run), F.lit(0.0), lambda a, x: a + F.get(table, x))


def train(samples: DataFrame) -> Model:
    """A model from labelled runs ``(run, random)``; nulls are left out, every row counts once.

    Only the counts of the cells, at most 66 x 66 for each label, come to the driver.
    Without samples both models are uniform and every ratio is 0.
    """
    steps = samples.filter("run IS NOT NULL AND random IS NOT NULL").select("random", F.explode(_steps(F.col("run"))).alias("cell"))
    rows = steps.groupBy("random", "cell").agg(F.count("*").alias("n")).collect()
    counts = {(r["random"], r["cell"]): r["n"] for r in rows}
    ratios = []
    for a in range(STATES):
        cells = range(a * STATES, (a + 1) * STATES)
        logs = []
        for label, smooth in ((True, SMOOTH_RANDOM), (False, SMOOTH_ORDINARY)):
            total = sum(counts.get((label, c), 0) for c in cells) + smooth * (STATES - 1)
            logs.append([math.log((counts.get((label, c), 0) + smooth) / total) for c in cells])
        ratios += [x - y for x, y in zip(*logs, strict=True)]
    return Model(tuple(ratios))


def samples(docs: DataFrame) -> DataFrame:
    """Labelled runs of whole texts: values of the fixed rules, and runs outside their matches."""
    text = F.col("text").cast("string")
    blanked = text
    for _, pattern, _, _ in RULES:
        blanked = F.regexp_replace(blanked, pattern, " ")
    runs = docs.select(base_spans(text).alias("spans"), F.when(text.rlike(_any()), blanked).otherwise(text).alias("rest"))
    random = runs.filter(F.size("spans") > 0).select(F.explode("spans.value").alias("run"), F.lit(True).alias("random"))
    ordinary = runs.select(F.explode(F.regexp_extract_all("rest", F.lit(ORDINARY_RUN), F.lit(0))).alias("run"), F.lit(False).alias("random"))
    return random.union(ordinary)


def _any() -> str:
    return "|".join(f"(?:{p})" for _, p, _, _ in RULES)


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _beside(run: Column, base: Column) -> Column:
    """The parts of a run that no base span covers, as spans: the whole run where none meets it."""
    cuts = F.filter(base, lambda b: _overlap(b, run))
    starts = F.concat(F.array(run["start"]), F.filter(F.transform(cuts, lambda b: b["end"]), lambda e: e < run["end"]))
    free = F.filter(F.array_distinct(starts), lambda p: ~F.exists(cuts, lambda b: (b["start"] <= p) & (p < b["end"])))

    def part(p: Column) -> Column:
        end = F.array_min(F.concat(F.array(run["end"]), F.filter(F.transform(cuts, lambda b: b["start"]), lambda s: s > p)))
        value = F.substring(run["value"], p - run["start"] + 1, end - p)
        return F.struct(p.alias("start"), run["kind"].alias("kind"), end.alias("end"), value.alias("value"))

    return F.when(F.exists(base, lambda b: _overlap(b, run)), F.transform(free, part)).otherwise(F.array(run))


def scan(docs: DataFrame, model: Model | None = None, into: str = "spans") -> DataFrame:
    """``docs`` and their spans, base and added, in a new column ``into`` by start, then kind.

    The column is ``array<struct<start, kind, end, value>>``; one of that name is replaced.
    Without a model one is trained on ``docs`` themselves.  Null and empty texts have no
    spans, rows are neither lost nor joined, and doc_id is not read.
    """
    model = model or train(samples(docs))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.withColumn(into, base_spans(text))
    mixed = _found(text, MIXED_RUN, len(RULES), 0, RUN)
    parts = F.flatten(F.transform(mixed, lambda s: _beside(s, F.col(into))))
    added = F.filter(parts, lambda s: model.score(s["value"]) >= LEAST)
    return found.withColumn(into, F.array_sort(F.concat(into, F.when(text.rlike(MIXED_RUN), added).otherwise(F.array().cast(_SPAN)))))


def shown(found: Column, base_only: bool = False) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    kept = F.filter(found, lambda s: s["kind"] < len(RULES)) if base_only else found
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, found: Column, mark: str = "<secret>") -> Column:
    """The text with ``mark`` in the place of every span; overlapping spans share one."""
    done = F.aggregate(
        found, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))),
    )
    return F.when(F.size(found) > 0, done).otherwise(text)
