"""Sources and sinks: snapshot tables, file trees, generations."""
