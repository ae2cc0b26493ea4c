"""Composed plans: model training and scoring, registered queries and their SQL."""
