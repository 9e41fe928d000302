"""Column functions: text, dates, units, codings, parsing of model output, rewards."""
