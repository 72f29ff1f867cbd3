"""URL rules found by their rarest literal token.

A rule is a regular expression together with the literal tokens that every match holds in whole. Each
rule is indexed under the one of them that is rarest in the URLs at hand. The tokens of a URL fetch
candidate rules from the index, and only those run their expressions. Rules are a configuration: they
are part of the plan, and their number does not follow the data.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

_SEPARATORS = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs over host and path joined; ``literals`` are whole tokens of every match (none: always a
    candidate); among rules that match, the greatest ``rank`` wins, then the first."""

    name: str
    pattern: str
    literals: tuple[str, ...]
    verdict: str
    rank: int = 0


def path_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host, its subdomains, and the paths that start with ``path``. Longer rules rank higher."""
    whole = re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+(?=[^0-9A-Za-z\x80-\U0010FFFF])", host + path)
    return Rule(host + path, rf"^(?:[^/]*\.)?{_quoted(host + path)}", tuple(whole), verdict, len(host + path))


def word_rule(word: str, verdict: str) -> Rule:
    """A rule for a word between separators anywhere in host or path."""
    return Rule(word, rf"(?<![0-9A-Za-z]){_quoted(word)}(?![0-9A-Za-z])", (word,), verdict, -1)


def _quoted(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z\x80-\U0010FFFF/])", r"\\\1", text)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _index(targets: DataFrame, rules: Sequence[Rule]) -> tuple[dict[str, list[int]], list[int]]:
    """Numbers of rules by their rarest literal in ``targets``; numbers of rules without literals."""
    literals = sorted({t for r in rules for t in r.literals})
    seen = targets.select(F.explode(F.split("target", _SEPARATORS)).alias("token")).filter(F.col("token").isin(literals))
    counts = {r["token"]: r["count"] for r in seen.groupBy("token").count().collect()} if literals else {}
    index: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        if rule.literals:
            index.setdefault(min(rule.literals, key=lambda t: (counts.get(t, 0), t)), []).append(i)
    return index, [i for i, r in enumerate(rules) if not r.literals]


def judge(pages: DataFrame, rules: Sequence[Rule], *, default: str = "allow", id: str = "page_id",
          url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, candidates`` of every row of ``pages``.

    ``rule`` is the name of the rule that decides (null: none, then the verdict is ``default``) and ``candidates``
    the number of expressions that ran. Null URLs and those without ``://`` have an empty host and path, which
    only rules without literals can match. Equal rows are judged each; an empty table gives an empty table. Every
    row is judged where it lies; nothing is shuffled but the token counts.
    """
    parts = pages.select(F.col(id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    parts = parts.withColumn("target", F.concat("host", "path"))
    index, always = _index(parts, rules)
    numbers = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<int>")
    fetched = numbers(always)
    if index:
        known = F.create_map(*[c for token, found in index.items() for c in (F.lit(token), numbers(found))])
        by_token = F.transform(F.array_distinct(F.split("target", _SEPARATORS)), lambda t: F.element_at(known, t))
        fetched = F.array_distinct(F.concat(fetched, F.flatten(F.filter(by_token, lambda r: r.isNotNull()))))
    of = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i + 1)
    found = parts.withColumn("fetched", fetched)
    if rules:
        hits = F.filter("fetched", lambda i: F.regexp_like(F.col("target"), of([r.pattern for r in rules], i)))
        found = found.withColumn("hits", hits)
        best = F.array_max(F.transform("hits", lambda i: F.struct(of([r.rank for r in rules], i).alias("rank"), (-i).alias("first"))))
        found = found.withColumn("decides", F.when(F.size("hits") > 0, -best["first"]))
        decided = F.col("decides").isNotNull()  # element_at takes a null index for one that is there
        name = F.when(decided, of([r.name for r in rules], F.col("decides")))
        verdict = F.when(decided, of([r.verdict for r in rules], F.col("decides")))
    else:
        name = verdict = F.lit(None).cast("string")
    return found.select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.lit(default)).alias("verdict"),
        F.size("fetched").alias("candidates"))
