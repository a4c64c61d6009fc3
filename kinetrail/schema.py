"""Canonical schemas. Positions are tall, one row for each (frame, atom), with the box's diagonal on each row."""

FRAMES = "frame int, time double, bx double, by double, bz double, box array<array<double>>"
POSITIONS = "frame int, time double, atom long, x double, y double, z double, bx double, by double, bz double"
ATOMS = "atom long, residue_id int, residue_name string, atom_name string, mass double, charge double"
INDEX_GROUPS = "group string, atom long"
JUMPS = "frame int, atom long, jx int, jy int, jz int"
ENERGY = "time double, type string, unit string, value double"
XYZ = ("x", "y", "z")
BOX = ("bx", "by", "bz")
