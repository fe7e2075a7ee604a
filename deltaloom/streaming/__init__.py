"""The engine, its subscription client and Structured Streaming."""
