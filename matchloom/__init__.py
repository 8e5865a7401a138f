"""Record linkage and analytics on Spark."""
