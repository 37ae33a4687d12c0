"""operators of tallyweave."""
