"""Streaming forms of the stateful operators."""

from tesserae.streaming.leases import lease_events
from tesserae.streaming.streams import admitted_stream, drain, first_of_day

__all__ = ["admitted_stream", "drain", "first_of_day", "lease_events"]
