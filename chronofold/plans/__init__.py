"""plans of the event-ledger engine."""
