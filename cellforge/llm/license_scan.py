"""Licence scan by ordered signature rules, with DataFrame functions alone.

Each text is normalised once (lower case, single blanks), the rules whose keyword occurs are matched
(keywords come from the rules themselves, so no gate can miss one), and a detection that lies inside
one of at least its priority is suppressed. All of it happens within the document's row, so the plan
has no shuffle and a hot source or group of copies cannot skew it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_row, from_row
from .license_rules import rules
from .spans import matches, scan

WORD = r"0-9A-Za-z\x{80}-\x{10FFFF}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases that always count, with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def n_words(text: Column) -> Column:
    """Number of maximal runs of word characters."""
    each = F.regexp_replace(F.concat(F.lit("a"), text), f"[{WORD}]++[^{WORD}]*+", "x")  # the "a" joins a word that stands first
    return (F.length(each) - F.when(F.rlike(text, F.lit(f"^[{WORD}]")), 0).otherwise(1)).cast("long")


def _normal(text: Column) -> Column:
    words = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), f"[^{WORD}]+", " "))
    return F.concat(F.lit(" "), words, F.lit(" "))


def roots(keywords: list[str]) -> dict[str, list[str]]:
    """``keywords`` by a text that each of them holds: the shortest of the others within it, or "licen", or itself."""
    out: dict[str, list[str]] = {}
    for k in keywords:
        out.setdefault(min((r for r in (*keywords, "licen") if r in k), key=lambda r: (len(r), r)), []).append(k)
    return out


def _blanks(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def scan_licenses(docs: DataFrame, text: str = "text", out: str = "license") -> DataFrame:
    """``docs`` with a struct column ``out`` (a column of that name is replaced; other columns stay).

    Fields: ``n_words``; ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` of the fixed
    phrases; ``labels``, of phrases and kept detections; ``detections``, the kept spans over the
    normalised text as (start, end, label, priority); ``score``, 0 without a label, otherwise by the
    strongest detection. A null or empty text has no words, no labels and the score 0; repeated rows
    are scanned each for itself. A text of any length is scanned whole, in time that grows with it. Of detections over the same words the strongest
    stays, of equal ones the rule that is listed first.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(as_row(docs), body.alias("__body")).withColumn("__norm", _normal(F.col("__body")))
    norm = F.col("__norm")

    places = []
    for phrase, label in PHRASES:
        parts = F.split(norm, f" {phrase}(?= )", -1)
        places.append(
            F.when(
                F.contains(norm, F.lit(f" {phrase} ")),
                F.struct(
                    F.lit(label).alias("label"),
                    (F.size(parts) - 1).cast("long").alias("n"),
                    _blanks(F.element_at(parts, 1)).alias("first"),
                    (_blanks(norm) - _blanks(F.element_at(parts, -1)) - len(phrase.split(" "))).alias("last"),
                ),
            )
        )
    df = df.withColumn("__base", F.array_compact(F.array(*places)))

    by_keyword: dict[str, list[dict]] = {}
    for k, (label, keyword, pattern, priority) in enumerate(rules()):
        by_keyword.setdefault(keyword, []).append({"label": label, "pattern": f" {pattern}(?= )", "priority": priority, "rule": k})
    listed = [{"root": root, "words": [{"keyword": k, "rules": by_keyword[k]} for k in own]} for root, own in roots(list(by_keyword)).items()]
    table = F.from_json(F.lit(json.dumps(listed)), "array<struct<root:string,words:array<struct<keyword:string,rules:array<struct<label:string,pattern:string,priority:int,rule:int>>>>>>")  # folded to one literal
    words = F.flatten(F.transform(F.filter(table, lambda g: F.contains(norm, g["root"])), lambda g: g["words"]))
    tried = F.flatten(F.transform(F.filter(words, lambda g: F.contains(norm, g["keyword"])), lambda g: g["rules"]))
    df = df.withColumn("__rules", F.filter(tried, lambda r: F.rlike(norm, r["pattern"])))

    spans = f"transform({matches('__norm', 'r.pattern')}, m -> named_struct('start', m.start, 'stop', -m.stop, 'priority', -r.priority, 'rule', r.rule, 'label', r.label))"
    found = F.expr(f"flatten(transform(__rules, r -> {spans}))")
    df = df.withColumn("__found", F.array_sort(F.coalesce(found, F.expr("CAST(array() AS array<struct<start:int,stop:int,priority:int,rule:int,label:string>>)"))))
    # In order of start, longest first: the state holds the furthest end so far of each priority and above.
    kept = scan(
        "__found",
        "array_repeat(-1, 6)",
        "transform(s.s, (v, p) -> IF(p <= -x.priority, greatest(v, -x.stop), v))",
        "IF(s.s[-x.priority] >= -x.stop, NULL, named_struct('start', x.start, 'stop', -x.stop, 'label', x.label, 'priority', -x.priority))",
        "struct<start:int,stop:int,label:string,priority:int>",
    )
    kept = F.expr(f"filter({kept}, d -> d IS NOT NULL)")
    df = df.withColumn("__kept", kept)
    base_labels = F.array_sort(F.array_distinct(F.transform("__base", lambda b: b["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.transform("__kept", lambda d: d["label"])))
    strongest = F.coalesce(F.array_max(F.transform("__kept", lambda d: d["priority"])), F.lit(-1))
    made = (
        F.struct(
            n_words(F.col("__body")).alias("n_words"),
            F.coalesce(F.aggregate("__base", F.lit(0).cast("long"), lambda s, b: s + b["n"]), F.lit(0).cast("long")).alias("n_base"),
            F.array_min(F.transform("__base", lambda b: b["first"])).alias("first_word"),
            F.array_max(F.transform("__base", lambda b: b["last"])).alias("last_word"),
            F.array_join(base_labels, ",").alias("base_labels"),
            F.array_join(labels, ",").alias("labels"),
            F.col("__kept").alias("detections"),
            F.when(F.size("__base") > 0, F.lit(1.0)).otherwise((strongest + 1) / 6.0).cast("double").alias("score"),
        )
    )
    return df.select(*from_row(docs.columns, **{out: made}))


def op1_license_scan(docs: DataFrame) -> DataFrame:
    """One row per document of the contract's columns; nulls, empty and very long texts and repeated rows as stated in ``scan_licenses``, no rows give no rows."""
    x = scan_licenses(docs.select("doc_id", "text"))
    return x.select("doc_id", *(f"license.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")))
