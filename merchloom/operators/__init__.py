"""DataFrame to DataFrame operators: merge, extraction, validation, export, catalogue upkeep."""
