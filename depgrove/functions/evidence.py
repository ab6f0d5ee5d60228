"""Confidence arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from depgrove.schemas import COMPONENT_TYPES, EXTRACTION_METHODS, TIER_SCORES, TIERS


def tier(confidence: Column) -> Column:
    """Name of the confidence tier; what lies below the last cut counts as ``threshold``."""
    out = F.when(confidence >= TIERS[0][1], TIERS[0][0])
    for name, cut in TIERS[1:-1]:
        out = out.when(confidence >= cut, name)
    return out.otherwise(TIERS[-1][0])


def tier_rank(name: Column) -> Column:
    """1 for the strongest tier; null for an unknown name."""
    return F.array_position(F.array(*[F.lit(t) for t, _ in TIERS]), name)


def tier_score(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for item in TIER_SCORES.items() for x in item])[name]


def at_least_tier(confidence: Column, least: str) -> Column:
    """Scores outside 0.4 to 1 never pass."""
    return confidence.between(0.4, 1.0) & (tier_rank(tier(confidence)) <= [t for t, _ in TIERS].index(least) + 1)


def source_passes(source_type: Column, wanted: str | None) -> Column:
    """Filter by source type: code and markdown accept both, both accepts only both; blank is markdown."""
    value = F.coalesce(F.nullif(source_type, F.lit("")), F.lit("markdown"))
    accepted = {"code": ["code", "both"], "markdown": ["markdown", "both"], "both": ["both"]}
    return value.isin(accepted[wanted]) if wanted in accepted else F.lit(True)


def check_source_type(wanted: str | None) -> None:
    if wanted not in (None, "", "code", "markdown", "both"):
        raise ValueError(f"unknown source type {wanted!r}: use code, markdown or both")


def valid_edge(src: Column, dst: Column, confidence: Column) -> Column:
    return (src != "") & (dst != "") & (src != dst) & confidence.between(0.0, 1.0)


def noisy_or(a: Column, b: Column) -> Column:
    return 1.0 - (1.0 - a) * (1.0 - b)


def similarity_to_confidence(similarity: Column, low: float = 0.35) -> Column:
    """Linear from (low, 0.5) to (1, 0.75)."""
    return 0.5 + (F.least(F.greatest(similarity, F.lit(low)), F.lit(1.0)) - low) / (1 - low) * 0.25


def known_component_type(value: Column) -> Column:
    return F.when(value.isin(*COMPONENT_TYPES), value).otherwise(F.lit("unknown"))


def edge_id(src: Column, dst: Column, kind: Column) -> Column:
    return F.concat_ws("\u0000", src, dst, kind)


def provenance_error(source_file: Column, method: Column, evidence: Column, modified: Column) -> Column:
    """Name of the first field that breaks the rules of provenance, null for a sound edge.

    An edge without any of the four fields is sound; blank and null are the same.
    """
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    time = F.coalesce(modified, F.lit(0))
    none = blank(source_file) & blank(method) & blank(evidence) & (time == 0)
    out = F.when(none, F.lit(None).cast("string")).when(blank(source_file) | source_file.startswith("/"), "source_file")
    return out.when(~blank(method) & ~method.isin(*EXTRACTION_METHODS), "extraction_method").when(blank(evidence), "evidence").when(time <= 0, "last_modified")


def valid_location(file: Column, line: Column) -> Column:
    """A relative file and a line from 0 on."""
    return F.coalesce((file != "") & ~file.startswith("/") & (line >= 0), F.lit(False))
