"""Table operators: cues, signals, synchronisation, reports."""
