"""The training loop, the model, and estimators."""
