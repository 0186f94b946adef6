"""Structured Streaming forms of the incremental parts (scored-log sink with resume)."""
