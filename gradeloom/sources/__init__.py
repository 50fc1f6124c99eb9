"""Sources and sinks: CSV with null markers, JSON lines with torn records, report sheets, prepared datasets."""
