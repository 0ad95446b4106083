"""sources of the event-ledger engine."""
