"""DataFrame operators: features, labels, smoothing, regions, overlays, metrics."""
