"""Oblivious-tree gradient boosting on Spark DataFrames: binning, encoding, training, scoring, metrics and persistence."""

__all__ = ["Classifier", "Params", "Regressor", "load"]


def __getattr__(name: str):
    """The public names, imported when first asked for: Python workers that need one module don't load the others."""
    if name not in __all__:
        raise AttributeError(name)
    from terrace.params import Params
    from terrace.plans import estimator

    return Params if name == "Params" else getattr(estimator, name)
