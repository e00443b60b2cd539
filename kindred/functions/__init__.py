"""Column functions: vectors, boxes, clock times."""
