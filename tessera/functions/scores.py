"""Column arithmetic of ranking, evaluation and text budgets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the composite score.
WEIGHTS = {"risk": 0.35, "centrality": 0.25, "surface_area": 0.20, "uncertainty": 0.20}
#: What each kind of change adds to a group's risk.
RISK_WEIGHTS = {"schema": 0.3, "api": 0.25, "auth": 0.35, "migration": 0.3}
#: Weights of the evaluation criteria.
CRITERIA = {
    "group_coherence": 0.25, "entrypoint_accuracy": 0.20, "review_ordering": 0.15,
    "risk_reasonableness": 0.15, "language_detection": 0.15, "file_accounting": 0.10,
}
SURFACE_LINES = 1000
# Prefixes of provider keys, with the marks that replace them; longer prefixes first.
KEY_MARKS = {
    "sk-ant-": "[REDACTED_ANTHROPIC_KEY]",
    "sk-proj-": "[REDACTED_OPENAI_KEY]",
    "sk-": "[REDACTED_API_KEY]",
    "AIza": "[REDACTED_GEMINI_KEY]",
}
LEAST_KEY, ERROR_BYTES = 10, 500
# The colours between which a risk is drawn.
GREEN, PEACH, RED = (166, 227, 161), (250, 179, 135), (243, 139, 168)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def composite_score(parts: Mapping[str, Column], weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Weighted mean of the clamped parts; 0 if all weights are 0."""
    total = sum(weights.values())
    if total == 0:
        return F.lit(0.0)
    raw = F.lit(0.0)
    for name, weight in weights.items():
        raw = raw + F.lit(weight) * clamp(parts[name])
    return clamp(raw / F.lit(total))


def risk_score(schema: Column, api: Column, auth: Column, migration: Column) -> Column:
    flags = {"schema": schema, "api": api, "auth": auth, "migration": migration}
    total = F.lit(0.0)
    for name, flag in flags.items():
        total = total + F.when(flag, F.lit(RISK_WEIGHTS[name])).otherwise(0.0)
    return clamp(total)


def surface_area(additions: Column, deletions: Column, most: int = SURFACE_LINES) -> Column:
    """Logarithm of the changed lines relative to that of `most`."""
    return clamp(F.log1p((additions + deletions).cast("double")) / F.log1p(F.lit(float(max(most, 1)))))


def risk_level(risk: Column) -> Column:
    return F.when(risk >= 0.7, "high").when(risk >= 0.4, "medium").otherwise("low")


def ratio(part: Column, whole: Column) -> Column:
    """0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def threshold_score(actual: Column, limit: Column) -> Column:
    """1 within the limit, then falling to 0 over the rest of the unit range."""
    span = F.greatest(F.lit(1.0) - limit, F.lit(2.220446049250313e-16))
    return F.when(actual <= limit, 1.0).otherwise(clamp(F.lit(1.0) - (actual - limit) / span))


# Weights of a repository's scores, by whether a limit on the
# density of groups is given and whether there are expectations to check.
REPOSITORY_WEIGHTS = {
    (False, False): {"group_count": 0.35, "infra_ratio": 0.25, "singleton_ratio": 0.20, "file_accounting": 0.20},
    (False, True): {"group_count": 0.20, "infra_ratio": 0.15, "singleton_ratio": 0.15, "file_accounting": 0.10, "golden": 0.40},
    (True, False): {"group_count": 0.20, "group_density": 0.20, "infra_ratio": 0.20, "singleton_ratio": 0.20, "file_accounting": 0.20},
    (True, True): {"group_count": 0.15, "group_density": 0.15, "infra_ratio": 0.10, "singleton_ratio": 0.10, "file_accounting": 0.10, "golden": 0.40},
}


def repository_overall(limited: Column, checked: Column) -> Column:
    """Weighted sum of the score columns of one row, by the profile that applies."""
    out = F.lit(None).cast("double")
    for (dense, golden), weights in REPOSITORY_WEIGHTS.items():
        total = sum((F.lit(w) * F.col(c) for c, w in weights.items()), F.lit(0.0))
        out = F.when((limited == F.lit(dense)) & (checked == F.lit(golden)), total).otherwise(out)
    return out


def file_accounting(total: Column, expected: Column, placed: Column, groups: Column, least: Column, most: Column) -> Column:
    """1 less a half for each wrong count of files - expected, or placed in groups and infrastructure - and a quarter for too few or many groups."""
    lost = F.when(total != expected, 0.5).otherwise(0.0) + F.when(placed != total, 0.5).otherwise(0.0) + F.when(groups.between(least, most), 0.0).otherwise(0.25)
    return F.greatest(F.lit(0.0), F.lit(1.0) - lost)


def overall(criteria: Mapping[str, Column]) -> Column:
    return sum((F.lit(w) * criteria[c] for c, w in CRITERIA.items()), F.lit(0.0))


def estimated_tokens(text: Column) -> Column:
    """A token for each 4 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("bigint")


def first_bytes(text: Column, most: int) -> Column:
    """At most so many UTF-8 bytes, cut at a character's border."""
    head = F.substring(F.encode(text, "UTF-8"), 1, most)
    return F.when(F.octet_length(text) <= most, text).otherwise(_whole_characters(head))


def _whole_characters(head: Column) -> Column:
    """Bytes without an unfinished character at their end."""
    out = head
    for drop in (1, 2, 3):
        shorter = F.substring(head, F.lit(1), F.octet_length(head) - drop)
        out = F.when(F.is_valid_utf8(out.cast("string")), out).otherwise(shorter)
    return out.cast("string")


def truncated(text: Column, tokens: int) -> Column:
    """Text cut to a token budget of 4 bytes each, back to the last line break, with a note."""
    cut = first_bytes(text, tokens * 4)
    back = F.when(cut.contains("\n"), F.regexp_replace(cut, r"\n[^\n]*\z", "")).otherwise(cut)
    note = f"\n\n... [truncated: input exceeded {tokens} token budget]"
    return F.when(F.octet_length(text) <= tokens * 4, text).otherwise(F.concat(back, F.lit(note)))


def redacted_keys(text: Column) -> Column:
    """The first 500 bytes with everything that begins like a provider's key and is long enough replaced."""
    out = first_bytes(text, ERROR_BYTES)
    for prefix, mark in KEY_MARKS.items():
        out = F.regexp_replace(out, rf"{prefix}[\p{{L}}\p{{N}}_-]{{{LEAST_KEY - len(prefix)},}}", mark)
    return out


def normalized_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for empty, unequal or zero vectors."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.when(usable, dot(a, b) / norm).otherwise(0.0)


def content_key(path: Column, content: Column) -> Column:
    """SHA-256 of path, NUL and content."""
    return F.sha2(F.concat(F.encode(path, "UTF-8"), F.unhex(F.lit("00")), F.encode(content, "UTF-8")), 256)


def heat_colour(risk: Column) -> Column:
    """Green over peach to red as rgb(r, g, b)."""
    x = clamp(risk)

    def channel(i: int) -> Column:
        low = F.floor(F.lit(GREEN[i]) + (PEACH[i] - GREEN[i]) * (x / 0.5) + 0.5)
        high = F.floor(F.lit(PEACH[i]) + (RED[i] - PEACH[i]) * ((x - 0.5) / 0.5) + 0.5)
        return F.when(x <= 0.5, low).otherwise(high).cast("string")

    return F.concat(F.lit("rgb("), F.concat_ws(", ", channel(0), channel(1), channel(2)), F.lit(")"))
