"""Readers of filings' payloads and logs, and sinks."""
