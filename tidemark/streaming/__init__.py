"""Running projections: offset store, delivery semantics, recovery, management and telemetry on Structured Streaming."""
