"""Analysis operators over positions, atoms and curves."""
