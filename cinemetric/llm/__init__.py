"""Training-data pipeline operators: deduplication, decontamination, quality
and toxicity scoring, licence and secret scans, mixing and token counts."""
