"""Part of fathomgrid."""
