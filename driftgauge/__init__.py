"""driftgauge: Spark jobs for building and judging detectors over labelled text."""
