"""Boundaries between cues that cut a phrase in two: rules as data, the risk of each boundary, and breaks moved to safe places.

A rule looks at the words around a boundary and has a weight; the risk of a boundary is the sum of the weights of the
rules that hold, and a little more where the text goes on in lower case. Rules are data (``Rule``), so that the same ones are
column expressions over neighbouring rows (``assessed``) and tests of any place between two words (``rebroken``).

Runs of risky boundaries are regions; a region ends where a boundary is safe, or hard (another speaker, or a long pause).
Within a region the number of cues stays, and breaks move where all of its cues and breaks together cost least. Regions
are short, so the search is bounded by the region, not by the document.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.operators.folds import Cue, per_document, spread_words


@dataclass(frozen=True)
class Rule:
    """Holds if each of its conditions does: last word (``tail``) and next one (``head``) in a set, both as ``seam`` or the last two as
    ``phrase`` (words joined by a space), or like a pattern as they are written; ``open``: no punctuation ends the left side."""

    name: str
    weight: int
    tail: frozenset[str] | None = None
    head: frozenset[str] | None = None
    seam: frozenset[str] | None = None
    phrase: frozenset[str] | None = None
    tail_like: str | None = None
    head_like: str | None = None
    open: bool = True


def words(text: str) -> frozenset[str]:
    return frozenset(text.split())


def phrases(text: str) -> frozenset[str]:
    return frozenset(p.strip() for p in text.split(","))


ARTICLES = words("a an the my your his her its our their this these those some any every each no")
PREPOSITIONS = words("about after against among around at before behind below between by during for from in into near of off on onto over since through to toward under until upon with within without")
CONJUNCTIONS = words("and or but nor because although while if unless whether than as")
SUBJECTS = words("i we he she they who")
AUXILIARIES = words("am is are was were be been have has had do does did can could will would shall should may might must isn't aren't wasn't don't doesn't didn't can't won't")
UNITS = words("percent miles mile feet foot inches inch pounds dollars seconds second minutes minute hours hour days day weeks months years degrees meters kilometers times people")
MULTIPLIERS = words("hundred thousand million billion trillion")
MONTHS = words("january february march april may june july august september october november december")
NUMBER = r"^[0-9][0-9.,]*$"
#: The weights of these kinds of break, of a lower-case start after one, and the risk from which a boundary is unstable.
RULES = (
    Rule("function_word", 32, tail=ARTICLES | PREPOSITIONS | CONJUNCTIONS),
    Rule("subject", 26, tail=SUBJECTS),
    Rule("predicate", 32, tail=AUXILIARIES),
    Rule("multiword", 36, phrase=phrases("such as, because of, according to, as well, kind of, sort of, a lot, more than, less than, instead of, due to, out of, in order, next to")),
    Rule("value_and_unit", 30, tail_like=NUMBER, head=UNITS),
    Rule("value_and_multiplier", 40, tail_like=NUMBER, head=MULTIPLIERS),
    Rule("month_and_year", 42, tail=MONTHS, head_like=r"^[12][0-9]{3}[.,;:!?]*$"),
    Rule("dependent_phrase", 30, head=PREPOSITIONS | words("than")),
    Rule("relative_clause", 30, head=words("that which who whom whose")),
    Rule("degree", 34, seam=phrases("so much, so many, so far, so long, too much, too many, very much")),
    Rule("same_as", 36, seam=phrases("same as")),
    Rule("particle", 32, seam=phrases("turn on, turn off, pick up, give up, set up, find out, come back, go back, look at, look for, figure out, end up, show up, take off, carry on")),
    Rule("lexical_unit", 34, seam=phrases("each other, at least, at all, of course, no one, one another, at most, right now, ice cream")),
    Rule("gerund", 36, tail=words("about by for from in of on without before after"), head_like=r"^[a-z]+ing[.,;:!?]*$"),
    Rule("name", 38, tail_like=r"^[A-Z][a-z]+$", head_like=r"^[A-Z][a-z]+"),
)
LOWER_CASE, UNSTABLE = 4, 20
#: How far breaks move, pauses that they don't cross, lengths of cues, and what these and breaks cost.
SHIFT, PAUSE_MS, SOFT_WORDS, HARD_WORDS, LEAST_WORDS, MOST_MS = 9, 1800, 18, 22, 3, 8000
SHORT, LONG, LATE_MS, TERMINAL, CLAUSE, OPENING, MOVED, KEPT, MOST_PAUSE, PAUSE_UNIT, WORTH = 7.0, 5.0, 500.0, 24.0, 5.0, 10.0, 0.8, 1.5, 6.0, 100.0, 8.0
OPENERS = words("although and because but however if now or so that then unless when while")
BARE = r"^[^A-Za-z0-9]+|[^A-Za-z0-9'’]+$"


def bare(word: str) -> str:
    return re.sub(BARE, "", word.lower())


def found(left: Sequence[str], right: Sequence[str], rules: Sequence[Rule] = RULES) -> list[Rule]:
    """The rules that hold between two lists of written words; none where a side has no word or the left ends a sentence."""
    if not left or not right or re.search(r"[.!?][\"')\]]*$", left[-1]):
        return []
    tail, head, before = bare(left[-1]), bare(right[0]), bare(left[-2]) if len(left) > 1 else ""
    closed = bool(re.search(r"[,;:][\"')\]]*$", left[-1]))

    def holds(r: Rule) -> bool:
        return (
            not (r.open and closed) and (r.tail is None or tail in r.tail) and (r.head is None or head in r.head)
            and (r.seam is None or f"{tail} {head}" in r.seam) and (r.phrase is None or f"{before} {tail}" in r.phrase)
            and (r.tail_like is None or bool(re.search(r.tail_like, left[-1]))) and (r.head_like is None or bool(re.search(r.head_like, right[0])))
        )

    return [r for r in rules if holds(r)]


def risk(left: Sequence[str], right: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    total = sum(r.weight for r in found(left, right, rules))
    return total + LOWER_CASE if total and right[0][:1].islower() else total


def assessment(left: Column, right: Column, rules: Sequence[Rule] = RULES) -> Column:
    """struct(reasons, risk) of the boundary between two texts."""
    pieces = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    plain = lambda w: F.regexp_replace(F.lower(w), BARE, "")
    a, b = pieces(left), pieces(right)
    last, first, before = F.try_element_at(a, F.lit(-1)), F.get(b, 0), F.coalesce(F.try_element_at(a, F.lit(-2)), F.lit(""))
    at = F.struct(last.alias("last"), first.alias("first"), plain(last).alias("tail"), plain(first).alias("head"), plain(before).alias("before"))

    def judged(x: Column) -> Column:
        closed = x["last"].rlike(r"[,;:][\"')\]]*$")

        def holds(r: Rule) -> Column:
            tests = [
                r.tail is not None and x["tail"].isin(*sorted(r.tail)), r.head is not None and x["head"].isin(*sorted(r.head)),
                r.seam is not None and F.concat_ws(" ", x["tail"], x["head"]).isin(*sorted(r.seam)), r.phrase is not None and F.concat_ws(" ", x["before"], x["tail"]).isin(*sorted(r.phrase)),
                r.tail_like is not None and x["last"].rlike(r.tail_like), r.head_like is not None and x["first"].rlike(r.head_like), r.open and ~closed,
            ]
            out = F.lit(True)
            for t in tests:
                out = out if t is False else out & t
            return out

        whole = x["last"].isNotNull() & x["first"].isNotNull() & ~F.coalesce(x["last"].rlike(r"[.!?][\"')\]]*$"), F.lit(False))
        weighed = F.array(*[F.when(holds(r), F.struct(F.lit(r.name).alias("rule"), F.lit(r.weight).alias("weight"))) for r in rules])
        kept = F.when(whole, F.filter(weighed, lambda w: w.isNotNull())).otherwise(F.slice(weighed, 1, 0))
        lower = F.when(x["first"].rlike(r"^\p{Ll}"), LOWER_CASE).otherwise(0)
        total = lambda k: F.aggregate(k, F.lit(0), lambda t, w: t + w["weight"])
        bound = F.transform(F.array(kept), lambda k: F.struct(F.transform(k, lambda w: w["rule"]).alias("reasons"), (total(k) + F.when(total(k) > 0, lower).otherwise(0)).alias("risk")))
        return bound[0]

    return F.transform(F.array(at), judged)[0]


def assessed(cues: DataFrame, keys: Sequence[str], order: str = "idx", label: str | None = None) -> DataFrame:
    """(keys, order, reasons, risk, unstable, hard) of the boundary after each cue but the last."""
    w = Window.partitionBy(*keys).orderBy(order)
    ahead = cues.withColumns({"_text": F.lead("text").over(w), "_start": F.lead("start_ms").over(w), "_last": F.lead(order).over(w).isNull(), **({"_label": F.lead(label).over(w)} if label else {})})
    told = ahead.where(~F.col("_last")).withColumn("_a", assessment(F.col("text"), F.col("_text")))
    hard = F.col("_start") - F.col("end_ms") > PAUSE_MS
    if label:
        hard = hard | F.coalesce(F.col(label) != F.col("_label"), F.lit(False))
    return told.select(*keys, order, "_a.reasons", "_a.risk", (F.col("_a.risk") >= UNSTABLE).alias("unstable"), F.coalesce(hard, F.lit(False)).alias("hard"))


def cue_cost(part: Sequence[Cue]) -> float | None:
    """What a cue of these words costs; None if it is empty or too long."""
    n, ms = len(part), part[-1]["end_ms"] - part[0]["start_ms"] if part else 0
    if not 0 < n <= HARD_WORDS:
        return None
    return max(0, LEAST_WORDS - n) * SHORT + max(0, n - SOFT_WORDS) * LONG + max(0, ms - MOST_MS) / LATE_MS


def break_cost(region: Sequence[Cue], at: int, origin: int) -> tuple[float, int]:
    """What a break before word ``at`` costs that stood at ``origin``, and its risk."""
    texts = [w["text"] for w in region[max(0, at - 2) : at + 1]]
    left, right = texts[:-1], texts[-1:]
    danger, last = risk(left, right), left[-1]
    cost = danger + abs(at - origin) * MOVED - (KEPT if at == origin else 0.0)
    cost -= TERMINAL if re.search(r"[.!?][\"')\]]*$", last) else CLAUSE if re.search(r"[,;:][\"')\]]*$", last) else 0.0
    cost -= OPENING if bare(right[0]) in OPENERS else 0.0
    return cost - min(MOST_PAUSE, max(0, region[at]["start_ms"] - region[at - 1]["end_ms"]) / PAUSE_UNIT), danger


def best_places(region: Sequence[Cue], origins: Sequence[int]) -> tuple[list[int], float, int] | None:
    """The breaks, one near each of ``origins``, with which cues and breaks cost least; their cost and risk."""
    states: dict[int, tuple[float, list[int], int]] = {0: (0.0, [], 0)}
    for origin in origins:
        reached: dict[int, tuple[float, list[int], int]] = {}
        for at in range(max(1, origin - SHIFT), min(len(region) - 1, origin + SHIFT) + 1):
            own, danger = break_cost(region, at, origin)
            for before, (cost, places, total) in states.items():
                part = cue_cost(region[before:at]) if before < at else None
                if part is not None and (at not in reached or cost + part + own < reached[at][0]):
                    reached[at] = (cost + part + own, [*places, at], total + danger)
        states = reached
    ends = [(cost + last, places, total) for at, (cost, places, total) in states.items() if (last := cue_cost(region[at:])) is not None]
    return (lambda b: (b[1], b[0], b[2]))(min(ends, key=lambda e: e[0])) if ends else None


def as_they_are(region: Sequence[Cue], origins: Sequence[int]) -> tuple[float, int]:
    """Cost and risk of the breaks that a region has; cues beyond the limits cost without end."""
    told = [break_cost(region, at, at) for at in origins]
    parts = [cue_cost(region[a:b]) for a, b in pairwise([0, *origins, len(region)])]
    return (float("inf") if None in parts else sum(parts) + sum(c for c, _ in told)), sum(d for _, d in told)


def rebroken(cues: list[Cue], label: str | None = None) -> list[Cue]:
    """Cues with the breaks of each risky region where they cost least, if that is worth it and lowers the risk."""
    texts = [c["text"].split() for c in cues]
    hard = [b["start_ms"] - a["end_ms"] > PAUSE_MS or bool(label and a[label] and b[label] and a[label] != b[label]) for a, b in pairwise(cues)]
    risky = [not hard[i] and risk(texts[i], texts[i + 1]) >= UNSTABLE for i in range(len(cues) - 1)]
    out, i = [], 0
    while i < len(cues):
        j = i
        while j < len(risky) and risky[j]:
            j += 1
        if j > i and j < len(risky) and not hard[j] and len(texts[j]) <= 4:
            j += 1  # a short tail may give its words to the safe cue after it
        part = cues[i : j + 1]
        spread = [spread_words(c) for c in part]
        region = [w for ws in spread for w in ws]
        origins = [sum(len(ws) for ws in spread[: k + 1]) for k in range(len(part) - 1)]
        best = best_places(region, origins) if origins and all(spread) else None
        now = as_they_are(region, origins) if best else None
        if best and best[0] != origins and best[2] < now[1] and now[0] - best[1] >= WORTH:
            for k, (a, b) in enumerate(pairwise([0, *best[0], len(region)])):
                out.append(part[k] | {"start_ms": region[a]["start_ms"], "end_ms": region[b - 1]["end_ms"], "text": " ".join(w["text"] for w in region[a:b])})
        else:
            out += part
        i = j + 1
    return out


def normalized(cues: DataFrame, label: str | None = None) -> DataFrame:
    """``cues`` (doc_id, idx, start_ms, end_ms, text) with ``rebroken`` boundaries; words keep their order, and cues their number."""
    return per_document(cues, lambda rows: rebroken(rows, label), [label] if label else [])
