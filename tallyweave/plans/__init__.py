"""plans of tallyweave."""
