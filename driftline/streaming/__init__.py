"""Structured Streaming: event ingestion with an error side output, completed bins and the keyed navigation filter."""
