"""Text-provenance analytics over Spark tables: scoring, marker counts, similarity gates, locks and reports."""
