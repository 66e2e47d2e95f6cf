"""Preparation, training, scoring and inspection of one regression per district."""
