"""Operations for large training corpora, each a function from DataFrames to DataFrames."""
