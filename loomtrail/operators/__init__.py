"""DataFrame-in, DataFrame-out process-mining operators."""
