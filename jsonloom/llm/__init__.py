"""Training-data operators: each module holds one operator over plain DataFrames; ``queries`` registers them."""
