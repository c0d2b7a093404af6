"""Sources and sinks: raw-table readers, source-shape adapters, driver tables."""
