"""Data quality: rules, profiles, scores and monitoring."""
