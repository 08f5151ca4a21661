"""tidemark: DataFrame-first analytics for water levels, terrain and the series they are compared with."""
