"""sources of tallyweave."""
