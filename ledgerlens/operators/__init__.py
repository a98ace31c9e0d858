"""DataFrame-to-DataFrame operators over facts, points, chunks, claims and events."""
