"""tesserae: evidence-grounded research data on Spark."""
