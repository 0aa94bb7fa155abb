"""Multi-operator plans: feature pipelines, models, tuning, run log, scoring."""
