"""Column functions and text helpers."""
