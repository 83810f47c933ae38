"""The folds over live samples: the same code as in batch, its state kept per video by Spark."""
