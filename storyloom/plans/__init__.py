"""Whole runs: stages over checkpoints, and the driver tables read as stories."""
