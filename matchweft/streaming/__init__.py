"""The same stages on Structured Streaming."""
