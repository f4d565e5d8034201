"""Training-data pipeline operators: text in, cleaned, packed and encoded training data out."""
