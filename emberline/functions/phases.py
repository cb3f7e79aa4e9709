"""Phases such as ``2_day_vote_pk``: day, time of day, kind, group."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def phase_day(phase: Column) -> Column:
    """The number before the first underscore, null where there is none."""
    return F.split_part(phase, F.lit("_"), F.lit(1)).try_cast("int")


def phase_time(phase: Column) -> Column:
    return F.when(phase.contains("_day_"), "day").when(phase.contains("_night_"), "night")


def sample_type(phase: Column) -> Column:
    """The kind of sample a phase gives; the first that fits."""
    return (
        F.when(phase.contains("_day_speech"), "speech")
        .when(phase.contains("_day_vote"), "vote")
        .when(phase.contains("night_skill"), "action")
        .when(phase.contains("state_reconstruction"), "state_recon")
    )


def is_pk(phase: Column) -> Column:
    return phase.endswith("_pk")


def training_group(phase: Column, order: list[tuple[str, str]], default: str) -> Column:
    """The group of the first (substring, group) whose substring the phase contains, in lower case."""
    out = F.lit(default)
    for part, group in reversed(order):
        out = F.when(F.lower(phase).contains(part), group).otherwise(out)
    return out


# The orders in which the three training paths look at a phase.
GROUPS_BY_ACTION = [("night_skill", "action"), ("vote", "vote"), ("speech", "speech"), ("state_reconstruction", "state_recon")]
GROUPS_BY_SPEECH = [("speech", "speech"), ("vote", "vote"), ("state_reconstruction", "state_recon"), ("night_skill", "action")]
GROUPS_BY_MEETING = [("meeting", "meeting"), ("task", "task"), ("vote", "meeting"), ("speech", "meeting"), ("night_skill", "task")]


def bucket(phase: Column, category: Column) -> Column:
    """The bucket of a sample of the task/meeting game."""
    meeting = F.lower(phase).contains("meeting")
    return (
        F.when(F.lower(phase).contains("task"), "task_action")
        .when(meeting & (category == "VOTE"), "meeting_vote")
        .when(meeting & (category == "SPEAK"), "meeting_speech")
        .otherwise("other")
    )
