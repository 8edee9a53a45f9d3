"""Sources and sinks: JSON lines, raw claim sets, corpora, artefact listings, reports and configuration."""
