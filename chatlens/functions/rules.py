"""Ordered keyword rule sets and the tagging expression built from them (SCL-3/4/11, SRC-14, UDF-2).

A rule set is an ordered list ``(label, keywords)``; a text gets the first label
(in rule order) with any keyword contained in the lower-cased text, else the
fallback label. Keywords are lower-cased once here, on the driver, so the
per-row work is one ``lower(text)`` plus substring tests on the JVM.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import DEFAULT_TOPIC_RULES, FALLBACK_LABEL, PURPOSE_RULES


@dataclass(frozen=True)
class RuleSet:
    """Ordered ``(label, keywords)`` rules; order is semantic (first match wins)."""

    rules: tuple[tuple[str, tuple[str, ...]], ...]
    fallback: str = FALLBACK_LABEL
    warnings: tuple[str, ...] = field(default=(), compare=False)

    @staticmethod
    def of(rules, fallback: str = FALLBACK_LABEL) -> "RuleSet":
        """Build from a list of pairs or an (ordered) mapping label -> keywords.

        Keyword values follow the semantics of iterating them: a list gives its
        items, a plain string gives its characters, a mapping gives its keys.
        A keyword that is not a string is an error, as it cannot be lower-cased.
        """
        items = rules.items() if isinstance(rules, dict) else rules
        out = []
        for label, kws in items:
            if isinstance(kws, str):
                seq = list(kws)
            elif isinstance(kws, dict):
                seq = list(kws.keys())
            elif isinstance(kws, (list, tuple)):
                seq = list(kws)
            else:
                raise ValueError(f"keywords of rule {label!r} are not iterable: {kws!r}")
            for kw in seq:
                if not isinstance(kw, str):
                    raise ValueError(f"keyword {kw!r} of rule {label!r} is not a string")
            out.append((str(label), tuple(seq)))
        return RuleSet(tuple(out), fallback)

    @staticmethod
    def from_json(text: str | None, default: "RuleSet | None" = None) -> "RuleSet":
        """User-edited JSON object label -> keywords; invalid JSON falls back to the default set."""
        default = default or default_topic_rules()
        if text is None:
            return default
        try:
            data = json.loads(text)
        except (ValueError, TypeError):
            return RuleSet(default.rules, default.fallback, ("invalid rules JSON; default rules used",))
        if not isinstance(data, dict):
            raise ValueError("rules JSON must be an object label -> keyword list")
        return RuleSet.of(data, default.fallback)

    @property
    def labels(self) -> list[str]:
        return [label for label, _ in self.rules]

    def lowered(self) -> list[tuple[str, list[str]]]:
        """Rules with keywords lower-cased (Python semantics) and exact duplicates dropped."""
        out = []
        for label, kws in self.rules:
            seen, uniq = set(), []
            for kw in kws:
                k = kw.lower()
                if k not in seen:
                    seen.add(k)
                    uniq.append(k)
            out.append((label, uniq))
        return out

    def pruned(self) -> list[tuple[str, list[str]]]:
        """``lowered()`` without keywords that can never decide the label.

        A keyword that contains another keyword of the same rule or of an earlier
        rule is redundant: any text containing it also contains the shorter one,
        which already matched. Dropping those is exact and saves substring scans
        (default topics 272 -> 249, purposes 62 -> 49).
        """
        earlier, out = [], []
        for label, kws in self.lowered():
            keep = []
            for k in sorted(kws, key=len):
                if not any(b in k for b in earlier) and not any(b in k for b in keep):
                    keep.append(k)
            kept = set(keep)
            out.append((label, [k for k in kws if k in kept]))
            earlier.extend(keep)
        return out

    def to_json(self) -> str:
        return json.dumps({label: list(kws) for label, kws in self.rules}, ensure_ascii=False)


def default_topic_rules() -> RuleSet:
    return RuleSet.of(DEFAULT_TOPIC_RULES)


def purpose_rules() -> RuleSet:
    return RuleSet.of(PURPOSE_RULES)


def sql_string(s: str) -> str:
    """Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def minimal_keywords(keywords: list[str]) -> list[str]:
    """Lower-cased keywords without duplicates and without those containing another one (same any-match)."""
    keep = []
    for k in sorted(dict.fromkeys(kw.lower() for kw in keywords), key=len):
        if not any(b in k for b in keep):
            keep.append(k)
    kept = set(keep)
    return [k for k in dict.fromkeys(kw.lower() for kw in keywords) if k in kept]


def any_keyword_sql(lowered_col: str, keywords: list[str]) -> str:
    """SQL text: true if any (already lower-cased) keyword occurs in the lower-cased column."""
    if not keywords:
        return "false"
    return f"exists(array({', '.join(sql_string(k) for k in keywords)}), k -> contains({lowered_col}, k))"


def tag_sql(lowered_col: str, rules: "RuleSet") -> str:
    """SQL text: first matching label in rule order, else the fallback (one CASE WHEN ladder)."""
    whens = [f"WHEN {any_keyword_sql(lowered_col, kws)} THEN {sql_string(label)}"
             for label, kws in rules.pruned() if kws]
    fallback = sql_string(rules.fallback)
    return f"(CASE {' '.join(whens)} ELSE {fallback} END)" if whens else fallback
