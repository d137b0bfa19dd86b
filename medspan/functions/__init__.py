"""Column functions: text normalisation, dose and form features, fixed word lists."""
