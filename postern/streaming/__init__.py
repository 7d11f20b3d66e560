"""Empty on purpose: archives are finite, and all work on them is batch."""
