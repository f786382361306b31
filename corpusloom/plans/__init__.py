"""Physical building blocks (skew handling, ordering) and the composed jobs."""
