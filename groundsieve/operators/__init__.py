"""Table operators: quality control, joins, folds, profiles, metrics, calibration, models, grids."""
