"""Query registrations, grouped like the plans they call."""

from slotbook.queries import access, admission, effects, places, reports, sequences, streaming, timelines  # noqa: F401
