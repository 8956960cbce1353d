"""Inputs and outputs: the files table, the driver tables as a fleet, the fact store."""
