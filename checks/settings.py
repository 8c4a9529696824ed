"""Study settings shared by the registered queries and their reference SQL."""

START, END = "2024-01-01", "2024-01-31"
TRAIN_END, VALIDATION_END = "2024-01-19 00:00:00", "2024-01-25 00:00:00"
HORIZONS = (1, 3, 5)
STUDY = {"train": 2, "validation": 2, "holdout": 1, "fdr": 1.0}
CUTOFF = "2024-01-20 00:00:00"
