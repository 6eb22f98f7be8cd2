"""Column functions: scalars, series over a window, text."""
