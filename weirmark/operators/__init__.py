"""DataFrame-to-DataFrame operators: enrichment, rollups, detectors, reports."""
