"""Layer and catalog operators: DataFrame in, DataFrame out."""
