"""What submissions, agents and observers add to the log: an event a step, with the data that the step leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registers import recovery

#: Names of what events are about.
SUBMISSION, AGENT, OBSERVER = "ec8a_submission", "agent", "observer_registration"


def _event(kind: Column | str, entity_type: str, entity: Column, at: Column, when: Column | None = None, actor: Column | None = None, **data: Column) -> Column:
    """A step's event, null where it was not taken; its data keep fields that are null."""
    body = F.to_json(F.struct(*(c.alias(k) for k, c in data.items())), {"ignoreNullFields": "false"})
    row = F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("event_type"), F.lit(entity_type).alias("entity_type"), entity.cast("string").alias("entity_id"),
        (actor if actor is not None else F.lit(None)).cast("string").alias("actor_id"), at.alias("event_at"), body.alias("event_data"),
    )
    return row if when is None else F.when(when, row)


def _steps(rows: DataFrame, *events: Column) -> DataFrame:
    """All events of each row, in one pass over rows."""
    return rows.select(F.inline(F.array_compact(F.array(*events))))


def of_submissions(rows: DataFrame, now: Column) -> DataFrame:
    """event_type, entity_type, entity_id, actor_id, event_at, event_data of the steps that submissions have taken by now.

    rows: id, election, pu, image_sha256, source_type, party, submitted_at; extracted_at, confidence, backend, arithmetic_ok
    once read; retried_at, previous_error once asked for again; started_at of an extraction that has not ended (see
    registers.recovery); reviewed_at, reviewer, decision (approved or rejected) and reason once reviewed.
    """
    c = F.col
    place = {"election_id": c("election"), "pu_code": c("pu").cast("string")}
    stuck = F.when(c("extracted_at").isNull() & c("started_at").isNotNull(), recovery(c("started_at"), now))
    age = {"age_seconds": F.unix_timestamp(now) - F.unix_timestamp("started_at")}
    return _steps(
        rows,
        _event("submission.created", SUBMISSION, c("id"), c("submitted_at"), **place, image_sha256=c("image_sha256"), source=c("source_type"), party=c("party")),
        _event("submission.extracted", SUBMISSION, c("id"), c("extracted_at"), c("extracted_at").isNotNull(), **place, image_sha256=c("image_sha256"), confidence=c("confidence"), backend=c("backend"), arithmetic_ok=c("arithmetic_ok")),
        _event("submission.retry_requested", SUBMISSION, c("id"), c("retried_at"), c("retried_at").isNotNull(), previous_error=c("previous_error"), **place),
        _event("submission.recovery_requeued", SUBMISSION, c("id"), now, stuck == "queued", **age),
        _event("submission.recovery_giveup", SUBMISSION, c("id"), now, stuck == "failed", **age),
        _event(F.concat(F.lit("submission."), c("decision")), SUBMISSION, c("id"), c("reviewed_at"), c("decision").isin("approved", "rejected"), c("reviewer"), **place, reason=F.when(c("decision") == "rejected", c("reason"))),
    )


def of_agents(rows: DataFrame) -> DataFrame:
    """Events of agents that a roster brought in: phone, party, pu_code, language, actor, loaded_at."""
    c = F.col
    return _steps(rows, _event("agent.provisioned", AGENT, c("phone"), c("loaded_at"), None, c("actor"), party=c("party"), pu_code=c("pu_code"), language=c("language")))


def of_observers(rows: DataFrame) -> DataFrame:
    """Events of decisions on observers: registration_id, organisation, decision (approved or rejected), reason, reviewer, decided_at."""
    c = F.col
    agent = F.when(c("decision") == "approved", F.concat(F.lit("observer-"), c("registration_id").cast("string")))
    return _steps(rows, _event(F.concat(F.lit("observer."), c("decision")), OBSERVER, c("registration_id"), c("decided_at"), c("decision").isin("approved", "rejected"), c("reviewer"), observer_org=c("organisation"), reason=c("reason"), agent_id=agent))


def agents_of_observers(rows: DataFrame) -> DataFrame:
    """agent_id, role, name, organisation of the observers that were approved, one each."""
    c = F.col
    return rows.filter("decision = 'approved'").select(F.concat(F.lit("observer-"), c("registration_id").cast("string")).alias("agent_id"), F.lit("observer").alias("role"), "name", "organisation")
