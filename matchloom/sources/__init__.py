"""Sources and sinks: tab-separated records, ground truth, candidate and match lists, models."""
