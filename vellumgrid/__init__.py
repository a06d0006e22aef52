"""Evidence-grade document and holdings analytics on Spark."""
