"""DataFrame-in, DataFrame-out operators of the diagnosis pipeline."""
