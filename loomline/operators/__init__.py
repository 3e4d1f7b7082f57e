"""Operators on DataFrames; each is a declarative plan, parameters first checked, no action unless stated."""
