"""Table-level operators: profiling, quality, matching, imputation, calibration."""
