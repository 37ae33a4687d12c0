"""functions of tallyweave."""
