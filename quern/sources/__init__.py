"""Sources and sinks of records, vectors, pairs and reports."""
