"""Sources and sinks: CSV contact files, configuration documents, the key store."""
