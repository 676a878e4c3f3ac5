"""The reports and data jobs, one module per subject."""
