"""Dataset and feature operators; each is a DataFrame in, DataFrame out."""
