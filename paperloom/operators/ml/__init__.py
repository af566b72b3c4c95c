"""Preparation, models, clustering, anomaly detection and metrics."""
