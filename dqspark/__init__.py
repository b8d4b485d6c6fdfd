"""Table-quality operators for Spark: contracts, cleaning, typing, imputation, scoring, drift, review."""
