"""Operations on streams of values as operations on DataFrames."""
