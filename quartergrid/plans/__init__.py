"""Whole jobs: feature build, request planning, forecasting, evaluation, views."""
