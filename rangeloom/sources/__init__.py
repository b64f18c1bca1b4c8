"""Readers that turn stored files into the tables the operators expect."""
