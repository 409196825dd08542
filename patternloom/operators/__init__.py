"""DataFrame operators: clustering, extraction, statistics, anomalies, scores, correlations."""
