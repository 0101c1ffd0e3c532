"""Learned channels: boosted trees, isolation trees, calibration, text score."""
