"""Relational operators of training: binning, encoding, objectives, sampling, histograms and split search."""
