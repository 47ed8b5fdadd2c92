"""License scan: ordered signature rules behind a keyword prefilter.

Every rule whose keyword a text contains yields detections with their place.  One that
lies within a detection of a better tier, or within a longer one of its own tier, is
suppressed.  Three base phrases are counted besides, word by word, and always keep
their labels.  DataFrame operations only.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicelake.llm.common import free_name
from choicelake.llm.license_rules import CONFIDENCE, SEPARATOR, WORD, rules

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_RULE = "array<struct<keyword:string,rules:array<struct<id:int,label:string,tier:int,also:string,regex:string>>>>"
_SPAN = "struct<start:int,tier:int,shorter:int,id:int,`end`:int,label:string>"
RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "license_score", "license_spans")


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def word_count(low: Column) -> Column:
    """Runs of word characters of a lower-cased text; as blanks, separators are told apart fastest."""
    return F.regexp_count(F.translate(low, _SEPARATORS, " " * len(_SEPARATORS)), F.lit("[^ ]+")).cast("long")


def _phrase(words: str) -> tuple[str, int, list[str]]:
    parts = words.split(" ")
    return f"(?<!{WORD}){(SEPARATOR + '++').join(parts)}(?!{WORD})", len(parts), parts


def base_places(low: Column, n_words: Column) -> dict[str, tuple[Column, Column, Column]]:
    """Per phrase: how many places, and the first and last as numbers of words."""
    out = {}
    for phrase in BASE:
        pattern, size, parts = _phrase(phrase)
        gate = low.contains(parts[0])
        for part in parts[1:]:
            gate = gate & low.contains(part)
        count = F.when(gate, F.regexp_count(low, F.lit(pattern))).otherwise(0)
        cut = F.when(gate, F.split(low, pattern, -1))
        first = F.when(gate & (count > 0), word_count(F.get(cut, 0)))
        last = F.when(gate & (count > 0), n_words - word_count(F.element_at(cut, -1)) - size)
        out[phrase] = count, first, last
    return out


def _rule_table() -> Column:
    """The rules by keyword, in order within one."""
    by = sorted(rules(), key=lambda r: r["keyword"])
    table = [{"keyword": k, "rules": list(g)} for k, g in groupby(by, key=lambda r: r["keyword"])]
    return F.from_json(F.lit(json.dumps(table)), _RULE)


def _gate(low: Column) -> Column:
    keywords = sorted({r["keyword"] for r in rules()})
    # a keyword that holds another is covered by it
    least = [k for k in keywords if not any(o != k and o in k for o in keywords)]
    found = low.contains(least[0])
    for k in least[1:]:
        found = found | low.contains(k)
    return found


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Each value joined with all before it, in as many passes as the length has binary digits."""
    n = F.size(values)
    steps = F.when(n > 1, F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int") - 1)).otherwise(F.expr("cast(array() as array<int>)"))

    def double(so_far: Column, step: Column) -> Column:
        by = F.pow(F.lit(2), step).cast("int")
        return F.transform(so_far, lambda x, i: F.when(i >= by, join(F.get(so_far, i - by), x)).otherwise(x))

    return F.aggregate(steps, values, double)


def _matches(low: Column, rule: Column) -> Column:
    """The rule's detections; their places follow from the lengths of what is between and within them."""
    nothing = F.expr(f"cast(array() as array<{_SPAN}>)")

    def placed(hits: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(low, rule["regex"], -1), 1, F.size(hits)), hits, lambda x, y: F.length(x) + F.length(y))
        return F.zip_with(hits, _running(lengths, lambda x, y: x + y), lambda hit, end: F.struct(
            (end - F.length(hit)).alias("start"), rule["tier"].alias("tier"), (-end).alias("shorter"),
            rule["id"].alias("id"), end.alias("end"), rule["label"].alias("label"),
        ))

    hits = F.regexp_extract_all(low, rule["regex"], F.lit(0))
    return _let(hits, lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(nothing))


def _kept(spans: Column) -> Column:
    """Of all detections those that none of a better tier, or of their own and longer, holds.

    In order of start, tier, falling end and rule, whatever may hold a detection comes
    before it, and does if the furthest end before of its tier and better ones reaches its own.
    """
    tiers = sorted(CONFIDENCE)

    def furthest(span: Column) -> Column:
        return F.struct(*(F.when(span["tier"] <= t, span["end"]).otherwise(-1).alias(f"t{t}") for t in tiers))

    def further(x: Column, y: Column) -> Column:
        return F.struct(*(F.greatest(x[f"t{t}"], y[f"t{t}"]).alias(f"t{t}") for t in tiers))

    def reach(at: Column, span: Column) -> Column:
        found = at[f"t{tiers[0]}"]
        for t in tiers[1:]:
            found = F.when(span["tier"] >= t, at[f"t{t}"]).otherwise(found)
        return found

    def swept(ordered: Column) -> Column:
        return _let(_running(F.transform(ordered, furthest), further), lambda ends: F.filter(
            ordered, lambda span, i: (i == 0) | (reach(F.get(ends, i - 1), span) < span["end"])
        ))

    return _let(F.array_sort(spans), swept)


def detections(low: Column) -> Column:
    """The detections of a lower-cased text that are not suppressed, in order of their start."""
    groups = F.filter(_rule_table(), lambda g: low.contains(g["keyword"]))
    tried = F.flatten(F.transform(groups, lambda g: F.filter(g["rules"], lambda r: low.contains(r["also"]))))
    every = F.flatten(F.transform(tried, lambda r: _matches(low, r)))
    spans = F.when(_gate(low), _kept(every)).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))
    return F.transform(spans, lambda s: F.struct(
        s["id"].alias("id"), s["label"].alias("label"), s["tier"].alias("tier"), s["start"].alias("start"), s["end"].alias("end")
    ))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, license_score and license_spans.

    Columns of these names are replaced, unless one is the text; all others stay.  Null and empty
    texts have no words and no labels; no row moves, so repeated rows are scanned each.  Work grows
    with a text's length and, but for a logarithm, with its detections.  Spans are in characters.
    """
    docs = docs.drop(*(c for c in RESULTS if c != text))
    low, n_words, spans = (free_name(docs, x) for x in ("low", "words", "spans"))
    found = docs.withColumn(low, lowered(F.col(text)))
    found = found.withColumns({n_words: word_count(F.col(low)), spans: detections(F.col(low))})
    places = base_places(F.col(low), F.col(n_words))
    marks = {free_name(found, f"{what}{i}"): x for i, each in enumerate(places.values()) for what, x in zip(("n", "first", "last"), each)}
    found = found.withColumns(marks)
    count, first, last = ([F.col(list(marks)[3 * i + k]) for i in range(len(BASE))] for k in range(3))
    base = F.filter(F.array(*(F.when(n > 0, F.lit(name)) for n, name in zip(count, BASE.values()))), lambda x: x.isNotNull())
    tiers = F.transform(spans, lambda s: s["tier"])
    score = F.lit(0.0)
    for tier in sorted(CONFIDENCE, reverse=True):
        score = F.when(F.array_contains(tiers, tier), F.lit(CONFIDENCE[tier])).otherwise(score)
    total = sum(count[1:], count[0])
    return found.withColumns({
        "n_words": F.col(n_words),
        "n_base": total.cast("long"),
        "first_word": F.least(*first).cast("long"),
        "last_word": F.greatest(*last).cast("long"),
        "base_labels": F.array_join(F.array_sort(base), ","),
        "labels": F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.transform(spans, lambda s: s["label"])))), ","),
        "license_score": F.greatest(score, F.when(total > 0, F.lit(CONFIDENCE[3])).otherwise(F.lit(0.0))),
        "license_spans": F.col(spans),
    }).drop(low, n_words, spans, *marks)
