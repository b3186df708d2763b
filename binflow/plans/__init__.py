"""Composite jobs: forecasts, evaluations, redistribution plans, replay, territory."""
