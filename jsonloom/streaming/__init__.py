"""The operations that carry state, for Structured Streaming."""
