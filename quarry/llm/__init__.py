"""Training-data operators: ten corpus-cleaning operators and their registered queries."""
