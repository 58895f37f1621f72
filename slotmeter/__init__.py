"""Slot-level fidelity analytics as PySpark DataFrame plans."""
