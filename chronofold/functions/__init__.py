"""functions of the event-ledger engine."""
