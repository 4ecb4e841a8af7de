"""Table sources (scans) and sinks."""
