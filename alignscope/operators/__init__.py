"""Relational operators on activations, labels and tallies. All are plain DataFrame plans unless a docstring says otherwise."""
