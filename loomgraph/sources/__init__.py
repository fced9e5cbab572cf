"""Sources and sinks: question files, roleset catalogs, resumable predictions."""
