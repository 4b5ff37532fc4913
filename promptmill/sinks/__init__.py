"""Result, prepared-data and scratch tables."""
