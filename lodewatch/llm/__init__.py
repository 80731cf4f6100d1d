"""Operations for preparing training data, built on DataFrames. Nothing outside this folder imports it."""
