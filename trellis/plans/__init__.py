"""From query text to DataFrames: parser, checks, expand order, compiler."""
