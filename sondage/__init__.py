"""Dataset characterisation, quality advice and model recommendation on Spark."""
