"""Databases, versioned tables, constraints and index metadata."""
