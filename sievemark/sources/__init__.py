"""Sources and sinks: tables, file inventories, decoders and publication."""
