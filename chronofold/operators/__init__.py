"""operators of the event-ledger engine."""
