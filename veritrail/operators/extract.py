"""Rule extraction: relations with spans in UTF-16 units, and what polarity suppresses."""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    id: str
    predicate: str
    pattern: re.Pattern


#: The default rules.
DEFAULT_RULES = (
    Rule("caused-direct", "CAUSED", re.compile(r"(?P<subject>[\w-]+(?:\s+[\w-]+){0,3}?)(?:\s*,[^,.;:!?]*,)?\s+(?P<verb>caused|led\s+to|resulted\s+in)\s+(?P<object>[\w-]+(?:\s+[\w-]+){0,3})", re.I | re.A)),
    Rule("influenced-direct", "INFLUENCED", re.compile(r"(?P<subject>[\w-]+(?:\s+[\w-]+){0,3}?)(?:\s*,[^,.;:!?]*,)?\s+(?P<verb>influenced|informed|shaped)\s+(?P<object>[\w-]+(?:\s+[\w-]+){0,3})", re.I | re.A)),
    Rule("precedent-for", "PRECEDENT_FOR", re.compile(r"(?P<subject>[\w-]+(?:\s+[\w-]+){0,3}?)(?:\s*,[^,.;:!?]*,)?\s+(?P<verb>set\s+(?:a\s+)?precedent\s+for|is\s+precedent\s+for)\s+(?P<object>[\w-]+(?:\s+[\w-]+){0,3})", re.I | re.A)),
)
#: Words that deny, hedge, question or report a relation.
POLARITY_CUES = (
    "not", "never", "no", "nor", "neither", "without", "nobody", "nothing", "none", "cannot",
    "hardly", "rarely", "seldom", "unable", "fails", "failed", "didn't",
    "doesn't", "wasn't", "weren't", "isn't", "aren't", "hasn't", "haven't", "denies", "denied",
    "refuted", "disproved", "rules out", "ruled out",
    "may", "might", "could", "possibly", "perhaps", "probably", "unclear", "unknown", "uncertain",
    "suspect", "suspected", "allegedly", "apparently", "seems", "seemed", "appears", "appeared",
    "likely", "unlikely", "presumably", "supposedly",
    "whether", "if", "unless", "would", "should", "assuming", "suppose", "hypothetically", "had",
    "believes", "believed", "thinks", "thought", "claims", "claimed", "alleges", "alleged",
)
#: Phrases that hold a cue and assert all the same.
PSEUDO_CUES = (
    "no one disputes", "nobody disputes", "no one denies", "nobody denies", "not rule out",
    "cannot be ruled out", "no doubt", "not only",
)
#: Words that begin a new clause; those that also begin a complement end a subject.
CONJUNCTIONS = "and|but|however|though|although|because|so|yet|while|whereas"
COMPLEMENTS = "that|which|who|whom|whose"
_CLAUSE = re.compile(rf"[.;:!?,]|\s+(?:{CONJUNCTIONS})\s+", re.I | re.A)
_SUBJECT = re.compile(rf"[.;:!?,]|\s+(?:{COMPLEMENTS}|{CONJUNCTIONS})\s+", re.I | re.A)
_CUES = [(cue, re.compile(rf"(?:^|[^a-z']){re.escape(cue)}(?![a-z'])")) for cue in POLARITY_CUES]


def _after_last(pattern: re.Pattern, text: str) -> int:
    return max((m.end() for m in pattern.finditer(text)), default=0)


def governing_clause(text: str, at: int) -> str:
    return text[_after_last(_CLAUSE, text[:at]) : at]


def suppressing_cue(text: str, verb_at: int) -> str | None:
    clause = governing_clause(text, verb_at).lower()
    for phrase in PSEUDO_CUES:
        clause = clause.replace(phrase, " ")
    return next((cue for cue, pattern in _CUES if pattern.search(clause)), None)


def _units(text: str, at: int) -> int:
    return at + sum(ord(c) > 0xFFFF for c in text[:at])


@functools.cache
def _verbs(rule: Rule) -> re.Pattern:
    """What a text must hold for a rule to match: one of its verbs, or anything where the pattern does not name them."""
    rest = rule.pattern.pattern.partition("(?P<verb>")[2]
    verbs, mark, _ = rest.partition(r")\s+(?P<object>")
    return re.compile(verbs if mark else "", rule.pattern.flags)


def extract_text(text: str | None, rules: tuple[Rule, ...] = DEFAULT_RULES) -> list[tuple]:
    """(rule, predicate, cue, subject span, object span, trigger span, subject, object); cue is null if asserted."""
    out = []
    for rule in (r for r in rules if _verbs(r).search(text)) if text else ():
        for m in rule.pattern.finditer(text):
            begin = m.start("subject") + _after_last(_SUBJECT, m["subject"])
            spans = [(_units(text, a), _units(text, b)) for a, b in ((begin, m.end("subject")), m.span("object"), m.span())]
            out.append((rule.id, rule.predicate, suppressing_cue(text, m.start("verb")), *spans, text[begin : m.end("subject")], m["object"]))
    return out


_SPAN = "struct<start:int,end:int>"
_FOUND = f"array<struct<rule:string,predicate:string,cue:string,subject:{_SPAN},object:{_SPAN},trigger:{_SPAN},subject_text:string,object_text:string>>"
_FIELDS = ("rule", "predicate", "cue", "subject", "object", "trigger", "subject_text", "object_text")
_PAIR = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_SHAPE = pa.list_(pa.struct([(name, _PAIR if name in ("subject", "object", "trigger") else pa.string()) for name in _FIELDS]))
#: Tasks for each core: texts are dealt out, since a compact table of many texts may be one task to scan.
SPREAD = 4


def _row(found: tuple) -> dict:
    return {name: {"start": x[0], "end": x[1]} if isinstance(x, tuple) else x for name, x in zip(_FIELDS, found, strict=True)}


def found_in(texts: pa.Array, rules: tuple[Rule, ...] = DEFAULT_RULES) -> pa.Array:
    """What each text says; one that repeats within the batch is read once."""
    coded = texts.dictionary_encode()
    said = pa.array([[_row(x) for x in extract_text(t, rules)] for t in coded.dictionary.to_pylist()], _SHAPE)
    return said.take(coded.indices)


def relations(records: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> tuple[DataFrame, DataFrame]:
    """(asserted, suppressed) of ``records`` (id, text): source, rule, predicate, spans, quotes; suppressed also the cue."""

    @F.arrow_udf(_FOUND)
    def found(texts: pa.Array) -> pa.Array:
        return found_in(texts, rules)

    # a text without any of the verbs never reaches Python
    verbs = "|".join(_verbs(rule).pattern for rule in rules)
    spoken = records.select("id", "text").where(F.col("text").rlike(f"(?i)(?:{verbs})"))
    dealt = spoken.repartition(SPREAD * records.sparkSession.sparkContext.defaultParallelism)
    flat = dealt.select(F.col("id").alias("source"), F.explode(found("text")).alias("r")).select("source", "r.*")
    return flat.where("cue is null").drop("cue"), flat.where("cue is not null").select("source", "rule", "predicate", "cue", "trigger")


def quote(text: Column, start: Column, end: Column) -> Column:
    """The text between two UTF-16 offsets."""
    units = F.encode(text, "UTF-16BE")
    return F.decode(F.substring(units, 2 * start + 1, 2 * (end - start)), "UTF-16BE")


def resolve_spans(spans: DataFrame, sources: DataFrame) -> DataFrame:
    """``spans`` (source, start, end as doubles or integers) with quote and reason, in a fixed order of reasons.

    ``sources``: id, text, purged.
    """
    held = sources.select(F.col("id").alias("source"), "text", "purged", F.lit(True).alias("_known"))
    both = spans.join(held, "source", "left")
    whole = (F.col("start") == F.floor("start")) & (F.col("end") == F.floor("end"))
    size = F.octet_length(F.encode("text", "UTF-16BE")) / 2
    reason = (
        F.when(F.col("_known").isNull(), "source_not_found")
        .when(F.col("purged"), "source_purged")
        .when(F.col("text").isNull(), "source_has_no_text")
        .when(~F.coalesce(whole, F.lit(False)), "span_not_integral")
        .when(F.col("end") < F.col("start"), "span_inverted")
        .when((F.col("start") < 0) | (F.col("end") > size), "span_out_of_bounds")
    )
    out = both.withColumn("reason", reason)
    text = quote(F.col("text"), F.col("start").cast("int"), F.col("end").cast("int"))
    return out.withColumn("quote", F.when(F.col("reason").isNull(), text)).drop("text", "purged", "_known")
