"""Readers with declared schemas and writers that never pass rows through the driver."""
