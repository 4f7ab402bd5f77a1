"""Column expressions: geometry, time, encodings. All run inside code generation."""
