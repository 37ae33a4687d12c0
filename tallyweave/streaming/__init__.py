"""streaming of tallyweave."""
