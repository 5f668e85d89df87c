"""Column functions: complex numbers as structs, phases, radar geometry, NULL handling."""
