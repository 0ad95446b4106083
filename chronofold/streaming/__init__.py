"""streaming of the event-ledger engine."""
