"""Scoring jobs: the layers fused into scores, findings and corpus reports."""
