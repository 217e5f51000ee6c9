"""The incremental forms of the daily mean and of the risk scores."""
