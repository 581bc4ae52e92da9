"""Column functions: text keys, calendar, parsers and predicates."""
