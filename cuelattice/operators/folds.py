"""Ordered passes over the cues of one document, where a row depends on what became of the rows before it.

``per_document`` hands each document's cues, in order, to a small function, many documents a task; memory is
bounded by the longest document. Cues are dictionaries with start_ms, end_ms and text.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUES = "doc_id string, idx long, start_ms long, end_ms long, text string"
SENTENCE_END = re.compile(r"[.!?。！？]['\"”’)\]]*$")
#: Words that go on with a sentence rather than begin one.
CONTINUES = frozenset("a an and as at because but by for from have in into is it its of on or than that the this to was were which with".split())

Cue = dict[str, object]
Pass = Callable[[list[Cue]], list[Cue]]


def per_document(cues: DataFrame, fold: Pass, extra: Sequence[str] = ()) -> DataFrame:
    """``fold`` over each document's cues in order of start, end and idx; idx is given anew, ``extra`` columns stay.

    A task sorts its documents and passes over them one after the other, so that memory is bounded by the longest.
    """
    columns = ["start_ms", "end_ms", "text", *extra]

    def folded(doc: str, rows: list[Cue]) -> pd.DataFrame:
        found = pd.DataFrame(fold(rows), columns=columns)
        found.insert(0, "idx", range(len(found)))
        found.insert(0, "doc_id", doc)
        return found.astype({"text": object, "doc_id": object} | {c: object for c in extra})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, rows = None, []
        for batch in batches:
            for key, part in batch.groupby("doc_id", sort=False, dropna=False):
                if key != doc and rows:
                    yield folded(doc, rows)
                    rows = []
                doc = key
                rows += [r | {"text": r["text"] or ""} for r in part[columns].to_dict("records")]
        if rows:
            yield folded(doc, rows)

    kept = cues.select("doc_id", "idx", *columns)
    types = dict(kept.dtypes)
    schema = ", ".join([CUES, *[f"{c} {types[c]}" for c in extra]])
    return kept.repartition("doc_id").sortWithinPartitions("doc_id", "start_ms", "end_ms", "idx").mapInPandas(run, schema)


def monotone(cues: list[Cue], least_ms: int = 1) -> list[Cue]:
    """A timeline without overlaps: they are cut in the middle, but leave both cues ``least_ms`` where they can."""
    rows = [c | {"end_ms": max(c["start_ms"], c["end_ms"])} for c in cues]
    for a, b in pairwise(rows):
        if a["end_ms"] > b["start_ms"]:
            low, high = a["start_ms"] + least_ms, b["end_ms"] - least_ms
            if low <= high:
                cut = min(max(low, (a["end_ms"] + b["start_ms"]) // 2), high)
            else:
                cut = max(a["start_ms"], min(b["start_ms"], b["end_ms"]))
            a["end_ms"], b["start_ms"] = min(a["end_ms"], cut), max(b["start_ms"], cut)
            b["end_ms"] = max(b["end_ms"], b["start_ms"])
    return rows


def compact(text: str) -> str:
    return re.sub(r"[\W_]+", "", text.lower())


def without_echoes(cues: list[Cue], within_ms: int = 1500) -> list[Cue]:
    """Neighbours that repeat each other become one; words that end a cue and begin the next are said once."""
    out: list[Cue] = []
    for cue in cues:
        cue = dict(cue)
        while out and cue["start_ms"] - out[-1]["end_ms"] <= within_ms:
            last = out[-1]
            a, b = compact(last["text"]), compact(cue["text"])
            if b in a:
                cue = last | {"end_ms": max(last["end_ms"], cue["end_ms"])}
                out.pop()
            elif a in b:
                cue = cue | {"start_ms": min(last["start_ms"], cue["start_ms"])}
                out.pop()
            else:
                cue["text"] = after_shared(last["text"].split(), cue["text"].split())
                break
        out.append(cue)
    return out


def after_shared(before: list[str], after: list[str], least: int = 2) -> str:
    """``after`` without the most words that it shares with the end of ``before``, if they are ``least`` or more."""
    low = [[compact(w) for w in x] for x in (before, after)]
    for n in range(min(len(before), len(after)), least - 1, -1):
        if low[0][-n:] == low[1][:n]:
            return " ".join(after[n:])
    return " ".join(after)


def merged(a: Cue, b: Cue) -> Cue:
    return {"start_ms": a["start_ms"], "end_ms": max(a["end_ms"], b["end_ms"]), "text": f"{a['text']} {b['text']}".strip()}


def joined_fragments(cues: list[Cue], gap_ms: int = 500, most_ms: int = 8000, most_words: int = 22) -> list[Cue]:
    """Joins a cue to the one before where that lacks a sentence end and this goes on with it, within limits."""
    out: list[Cue] = []
    for cue in cues:
        if out:
            both, words = merged(out[-1], cue), cue["text"].split()
            goes_on = bool(words) and (words[0].lower().strip(",.") in CONTINUES or words[0][:1].islower())
            if (
                goes_on and not SENTENCE_END.search(out[-1]["text"]) and cue["start_ms"] - out[-1]["end_ms"] <= gap_ms
                and both["end_ms"] - both["start_ms"] <= most_ms and len(both["text"].split()) <= most_words
            ):
                out[-1] = both
                continue
        out.append(dict(cue))
    return out


def joined_short(cues: list[Cue], most_words: int = 18) -> list[Cue]:
    """Joins cues of few words to a near neighbour: under 5 words within 200 ms, under 3 within 500."""
    out: list[Cue] = []
    for cue in cues:
        if out:
            gap, sizes = cue["start_ms"] - out[-1]["end_ms"], [len(x["text"].split()) for x in (out[-1], cue)]
            near = (gap < 200 and min(sizes) < 5) or (gap < 500 and min(sizes) < 3)
            if near and sum(sizes) <= most_words and not SENTENCE_END.search(out[-1]["text"]):
                out[-1] = merged(out[-1], cue)
                continue
        out.append(dict(cue))
    return out


def spread_words(cue: Cue) -> list[Cue]:
    """A cue's words with times in proportion to their length, a unit for each four characters begun."""
    words = cue["text"].split()
    units = [-(-len(w) // 4) for w in words]
    each, at, out = (cue["end_ms"] - cue["start_ms"]) / max(1, sum(units)), cue["start_ms"], []
    for w, n in zip(words, units, strict=True):
        until = min(at + int(each * n), cue["end_ms"])
        out.append({"start_ms": at, "end_ms": until, "text": w})
        at = until
    return out


def grouped_words(cues: list[Cue], most_words: int = 16, most_ms: int = 6500) -> list[Cue]:
    """Words gathered into cues until a sentence ends or a limit is met."""
    out: list[Cue] = []
    full = True
    for word in (w for c in cues for w in spread_words(c)):
        if full or len(out[-1]["text"].split()) >= most_words or word["end_ms"] - out[-1]["start_ms"] > most_ms:
            out.append(dict(word))
        else:
            out[-1] = merged(out[-1], word)
        full = bool(SENTENCE_END.search(word["text"]))
    return out


def best_breaks(cues: list[Cue], soft: int = 12, hard: int = 18) -> list[Cue]:
    """Words re-broken where lengths and breaks cost least over the whole document, by dynamic programming.

    A cue costs for words beyond ``soft`` or short of four, and may not exceed ``hard``; a break costs unless
    it follows a sentence end, less after a comma or before a pause.
    """
    words = [w for c in cues for w in spread_words(c)]
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(words) + 1):
        last = words[end - 1]
        pause = words[end]["start_ms"] - last["end_ms"] if end < len(words) else 1000
        seam = 0.0 if SENTENCE_END.search(last["text"]) or end == len(words) else 1.0 if last["text"].endswith((",", ";", ":")) else 3.0
        seam -= 0.5 if pause >= 300 else 0.0
        options = []
        for start in range(max(0, end - hard), end):
            n = end - start
            options.append((best[start][0] + seam + max(0, n - soft) * 0.8 + max(0, 4 - n) * 1.5 + 0.5, start))
        best.append(min(options))
    out, end = [], len(words)
    while end:
        start = best[end][1]
        out.append({"start_ms": words[start]["start_ms"], "end_ms": words[end - 1]["end_ms"], "text": " ".join(w["text"] for w in words[start:end])})
        end = start
    return out[::-1]


def similarity(left: Column, right: Column) -> Column:
    """Ratcliff-Obershelp ratio of the letters and digits of two texts; 1 if both have none, 0 if one has."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = [(compact(x or ""), compact(y or "")) for x, y in zip(a, b, strict=True)]
        return pd.Series([difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() if x and y else float(x == y) for x, y in pairs])

    return ratio(left, right)


def chained(chunks: DataFrame, overlap_ms: int) -> DataFrame:
    """Cues of overlapping chunks (doc_id, chunk, idx, ...) as one timeline.

    Chunks' times follow each other; where two overlap, they are laid over each other at the shift with most
    equal texts and cut in its middle; if fewer than two agree, the earlier one ends where the later begins.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole: list[Cue] = []
        for _, part in pdf.sort_values(["chunk", "idx"]).groupby("chunk"):
            rows = part[["start_ms", "end_ms", "text"]].to_dict("records")
            whole = laid_over(whole, rows, overlap_ms)
        out = pd.DataFrame(whole, columns=["start_ms", "end_ms", "text"]).astype({"text": object})
        out.insert(0, "idx", range(len(out)))
        out.insert(0, "doc_id", pdf["doc_id"].iloc[0])
        return out.astype({"doc_id": object})

    return chunks.groupBy("doc_id").applyInPandas(run, CUES)


#: What a longer overlap is worth, in equal texts a place, and the equal texts that an alignment needs.
LONGER, LEAST_EQUAL = 1 / 10_000, 2


def best_shift(tail: Sequence[str], head: Sequence[str]) -> int:
    """How far ``head`` reaches into ``tail`` where the two agree best; 0 where they don't.

    Only places of equal texts are looked at: each votes for the shift that lays it on its equal.
    """
    places: dict[str, list[int]] = {}
    for j, text in enumerate(head):
        places.setdefault(text, []).append(j)
    votes = Counter(len(tail) - i + j for i, text in enumerate(tail) for j in places.get(text, ()))
    worth = {shift: n / shift + shift * LONGER for shift, n in votes.items() if n >= LEAST_EQUAL}
    return min(worth, key=lambda shift: (-worth[shift], shift), default=0)


def laid_over(left: list[Cue], right: list[Cue], overlap_ms: int) -> list[Cue]:
    """Two sequences as one: see ``chained``."""
    if not left or not right or left[-1]["end_ms"] <= right[0]["start_ms"]:
        return left + right
    tail = [c for c in left if c["end_ms"] > left[-1]["end_ms"] - overlap_ms]
    head = [c for c in right if c["start_ms"] < right[0]["start_ms"] + overlap_ms]
    shift = best_shift([c["text"] for c in tail], [c["text"] for c in head])
    if not shift:
        return [c for c in left if c["start_ms"] < right[0]["start_ms"]] + right
    in_tail, in_head = max(0, len(tail) - shift), max(0, shift - len(tail))
    half = min(len(tail) - in_tail, len(head) - in_head) // 2
    return left[: len(left) - len(tail) + in_tail + half] + right[in_head + half :]


def boundary_scores(reference: Sequence[int], found: Sequence[int], within_ms: int) -> dict[str, float]:
    """Precision, recall and F1 of change points, each matched once to the first free one in reach."""
    free, hits = sorted(found), 0
    for r in sorted(reference):
        near = next((f for f in free if abs(f - r) <= within_ms), None)
        if near is not None:
            free.remove(near)
            hits += 1
    p, q = hits / len(found) if found else 0.0, hits / len(reference) if reference else 0.0
    return {"hits": hits, "precision": p, "recall": q, "f1": 2 * p * q / (p + q) if p + q else 0.0}


def boundary_f1(points: DataFrame, within_ms: int) -> DataFrame:
    """Scores of each key of ``points`` (key, side, at_ms; sides reference and found)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = {s: x["at_ms"].tolist() for s, x in pdf.groupby("side")}
        row = boundary_scores(sides.get("reference", []), sides.get("found", []), within_ms)
        return pd.DataFrame([{"key": pdf["key"].iloc[0]} | row])

    return points.groupBy("key").applyInPandas(run, "key long, hits long, precision double, recall double, f1 double")


def best_assignment(counts: dict[tuple[str, str], int]) -> int:
    """Most rows that one-to-one pairs of labels can explain, over all ways to pair (by subsets of the right labels)."""
    left, right = sorted({a for a, _ in counts}), sorted({b for _, b in counts})
    if len(right) > len(left):
        left, right, counts = right, left, {(b, a): n for (a, b), n in counts.items()}
    best = {0: 0}
    for a in left:
        step = dict(best)
        for used, n in best.items():
            for j, b in enumerate(right):
                if not used >> j & 1:
                    step[used | 1 << j] = max(step.get(used | 1 << j, 0), n + counts.get((a, b), 0))
        best = step
    return max(best.values())


def label_error(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of rows that no one-to-one mapping of predicted to true labels explains, per key.

    ``pairs`` has the keys, ``truth`` and ``predicted``; only counts of label pairs reach the mapping.
    """
    counts = pairs.groupBy(*keys, "truth", "predicted").agg(F.count(F.lit(1)).alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = {(str(r.truth), str(r.predicted)): int(r.n) for r in pdf.itertuples()}
        total, right = sum(table.values()), best_assignment(table)
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in keys} | {"total": total, "explained": right, "error_rate": 1 - right / total}])

    types = dict(pairs.dtypes)
    return counts.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", total long, explained long, error_rate double")
